"""Questionnaires as data: which columns, which codes, which score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.names import present_columns, select_items
from duowave.functions.text import BURDEN_CODES, WELLBEING_CODES
from duowave.operators import scoring

# Fatigue item columns.
FATIGUE_ITEMS = (
    "id48_1_sie_haben_aufgrund_ihrer_pflegeaufgaben_ein_gefuehl_von_muede_sein",
    "id49_1_sie_haben_sich_haeufig_muede_gefuehlt",
    "id50_1_sie_fuehlen_sich_koerperlich_erschoepft",
    "id51_1_sie_haben_haeufig_das_gefuehl_geistig_ausgelaugt_zu_sein",
    "id52_1_sie_empfinden_ihre_pflegeaufgabe_als_koerperlich_anstrengend",
    "id53_1_sie_empfinden_ihre_pflegeaufgabe_als_geistig_anstrengend",
)


@dataclass(frozen=True)
class Instrument:
    """One questionnaire. ``items`` is a column-name pattern or a list of names; ``score`` maps item columns to a total.

    With ``impute_up_to`` the preferred score is the total with up to that many missing items filled by the row mean.
    ``better`` and ``mcid`` say what counts as a response; no ``mcid`` means half the baseline standard deviation.
    """

    name: str
    items: str | Sequence[str]
    score: Callable[[Sequence[str]], Column]
    exclude: str | None = None
    fallback: str | None = None
    at_least: int = 1
    codes: Mapping[str, float] | None = None
    number_first: bool = True
    impute_up_to: int | None = None
    better: str = "lower"
    mcid: float | None = None

    def item_columns(self, df: DataFrame) -> list[str]:
        """Item columns of ``df``; a list of names may match none of them."""
        if isinstance(self.items, str):
            return select_items(df, self.items, self.exclude, self.fallback, self.at_least)
        return present_columns(df, self.items)


# Item patterns, tolerances and response thresholds of the study's scales.
BURDEN = Instrument(
    "ZBI", r"^id\d+_\d+($|_)", lambda items: scoring.score_observed(items, 4), fallback=r"^id\d+",
    codes=BURDEN_CODES, impute_up_to=4,
)
WELLBEING = Instrument(
    "WHO-5", r"^id[1-5]_", scoring.score_percent, codes=WELLBEING_CODES, number_first=False, better="higher", mcid=10,
)
DEPRESSION = Instrument(
    "BDI-II", r"^id\d{1,2}_\d+", scoring.score_prorated, exclude=r"^id25_", at_least=10, mcid=5,
)
FATIGUE = Instrument("CRF", FATIGUE_ITEMS, scoring.score_prorated)
INSTRUMENTS = (WELLBEING, DEPRESSION, BURDEN, FATIGUE)


def score_form(df: DataFrame, instrument: Instrument) -> DataFrame | None:
    """The form with coded items and ``score_raw``, ``score_imp`` and preferred ``score``; ``None`` without items."""
    items = instrument.item_columns(df)
    if not items:
        return None
    coded = scoring.code_items(df, items, instrument.codes, instrument.number_first)
    # The raw score comes first, so that filled items cannot enter it.
    raw = coded.withColumn("score_raw", instrument.score(items))
    if instrument.impute_up_to is None:
        return raw.withColumns({"score_imp": F.lit(None).cast("double"), "score": F.col("score_raw")})
    filled = scoring.impute_scale(raw, items, "score_imp", max_missing_count=instrument.impute_up_to)
    return filled.withColumn("score", scoring.score_preferred("score_imp", "score_raw"))
