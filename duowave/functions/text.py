"""Free text to numbers, codes and canonical categories."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing".
NULL_TOKENS = ("", "NA", "NaN", "NULL")

# Answer label to code, caregiver burden items.
BURDEN_CODES = {
    "zu keiner zeit": 0,
    "nie": 0,
    "selten": 1,
    "manchmal": 2,
    "häufig": 3,
    "haeufig": 3,
    "oft": 3,
    "ziemlich oft": 3,
    "sehr oft": 4,
    "fast immer": 4,
    "immer": 4,
    "trifft nicht zu": 0,
    "nie/überhaupt nicht": 0,
    "gelegentlich": 2,
    "hin und wieder": 2,
    "häufig/oft": 3,
    "ziemlich häufig": 3,
    "sehr häufig": 4,
    "meistens": 4,
}

# The short burden scale, used where unknown labels must stay missing.
BURDEN_CODES_STRICT = {
    "zu keiner zeit": 0,
    "nie": 0,
    "selten": 1,
    "manchmal": 2,
    "ziemlich oft": 3,
    "fast immer": 4,
}

# Answer label to code, depression items.
DEPRESSION_CODES = {
    "0": 0,
    "1": 1,
    "2": 2,
    "3": 3,
    "gar nicht": 0,
    "überhaupt nicht": 0,
    "ueberhaupt nicht": 0,
    "trifft nicht zu": 0,
    "nie": 0,
    "leicht": 1,
    "ein wenig": 1,
    "ein bisschen": 1,
    "manchmal": 1,
    "mäßig": 2,
    "maessig": 2,
    "ziemlich": 2,
    "oft": 2,
    "stark": 3,
    "sehr stark": 3,
    "fast immer": 3,
    "immer": 3,
}

# Answer label to code, wellbeing items.
WELLBEING_CODES = {
    "die ganze zeit": 5,
    "meistens": 4,
    "etwas mehr als die hälfte der zeit": 3,
    "etwas weniger als die hälfte der zeit": 2,
    "ab und zu": 1,
    "nie": 0,
}

# Spellings of each sex category.
SEX_TOKENS = {
    "weiblich": ("w", "f", "weiblich", "female", "frau"),
    "männlich": ("m", "male", "männlich", "maennlich", "mann"),
    "divers": ("divers", "d", "non-binary", "non binary", "nb"),
}
SEX_LEVELS = tuple(SEX_TOKENS)

# Marks of each marital status, tested in this order, and the status for all others.
MARITAL_MARKS = {
    "Ledig": "ledig",
    "Verheiratet": "verheiratet|lebenspartnerschaft|eingetragene",
    "Geschieden": "geschieden",
    "Verwitwet": "verwitwet",
}
MARITAL_OTHER = "Sonstiges"
MARITAL_LEVELS = (*MARITAL_MARKS, MARITAL_OTHER)

NUMBER = r"-?(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
WHOLE_NUMBER = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trimmed text, NULL where it is one of the missing-value tokens."""
    text = F.trim(_col(c))
    return F.when(~text.isin(*tokens), text)


def normalize_label(c: Column | str, squish: bool = True) -> Column:
    """Lower-case, trimmed text; ``squish`` also folds inner white space to one blank."""
    text = _col(c).cast("string")
    if squish:
        text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.lower(F.trim(text))


def to_numeric(c: Column | str) -> Column:
    """Number if the whole text is one, else NULL."""
    text = _col(c).cast("string")
    return F.when(text.rlike(WHOLE_NUMBER), F.trim(text).try_cast("double"))


def parse_number(c: Column | str, decimal_comma: bool = False) -> Column:
    """First number in the text; a comma groups digits unless ``decimal_comma``."""
    text = _col(c).cast("string")
    if decimal_comma:
        text = F.translate(text, ".,", ",.")
    digits = F.replace(F.regexp_extract(text, NUMBER, 0), F.lit(","), F.lit(""))
    # Casting an empty text costs an exception per row inside Spark.
    return F.when(digits != "", digits.try_cast("double"))


def code_lookup(key: Column, codes: Mapping[str, float]) -> Column:
    """Code of ``key`` under a literal map, NULL when absent."""
    pairs = [F.lit(x) for label, code in codes.items() for x in (label, float(code))]
    return F.try_element_at(F.create_map(*pairs), key)


def likert_code(c: Column | str, codes: Mapping[str, float] | None = None, number_first: bool = True) -> Column:
    """Numeric code of an answer text: its first number if wanted, else its label's code."""
    return label_code(normalize_label(c, squish=False), codes, number_first)


def label_code(label: Column, codes: Mapping[str, float] | None = None, number_first: bool = True) -> Column:
    """Numeric code of a lower-case, trimmed label; without ``codes`` only numbers count.

    A label found as it stands needs no pattern matching: known labels hold no number, or the very
    number that is their code. Only the others have white space folded and are searched for a number.
    """
    if codes is None:
        return parse_number(label)
    known = code_lookup(label, codes)
    folded = code_lookup(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")), codes)
    if not number_first:
        return F.coalesce(known, folded)
    plain = all(not re.search(r"\d", key) or key == f"{code:g}" for key, code in codes.items())
    return F.coalesce(known, parse_number(label), folded) if plain else F.coalesce(parse_number(label), known, folded)


def canon_sex(c: Column | str) -> Column:
    """One of ``SEX_LEVELS``, NULL for other texts."""
    token = normalize_label(c, squish=False)
    result = F.lit(None).cast("string")
    for level, tokens in reversed(SEX_TOKENS.items()):
        result = F.when(token.isin(*tokens), level).otherwise(result)
    return result


def canon_marital(c: Column | str) -> Column:
    """One of ``MARITAL_LEVELS``; unknown and missing texts count as other."""
    text = normalize_label(c, squish=False)
    result = F.lit(MARITAL_OTHER)
    for level, mark in reversed(MARITAL_MARKS.items()):
        result = F.when(text.rlike(mark), level).otherwise(result)
    return result


def format_interval(estimate: Column | str, low: Column | str, high: Column | str) -> Column:
    """Text such as ``0.53 [0.10, 0.96]``; NULL when a part is."""
    parts = [_col(estimate), _col(low), _col(high)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(known, F.format_string("%.2f [%.2f, %.2f]", *parts))


def split_field(c: Column | str, n: int = 2) -> list[Column]:
    """The first ``n`` comma-separated numbers of a text as columns."""
    parts = F.split(_col(c), r",\s*")
    return [to_numeric(F.get(parts, F.lit(i))) for i in range(n)]
