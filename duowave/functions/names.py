"""Column-name resolution on the driver: ids, items, candidates and cleaned headers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted patient id column names, best first.
ID_COLUMNS = ("patient", "patient_id", "pat_id", "pid", "id_patient", "id")


def require_columns(df: DataFrame, wanted: Iterable[str], what: str = "column") -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming every absent column."""
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        raise ValueError(f"missing {what}s {absent}; available columns: {df.columns}")
    return df


def first_present_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column of ``df``, else ``None``."""
    return next((c for c in candidates if c in df.columns), None)


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted names that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def detect_id_column(df: DataFrame) -> str:
    """Name of the patient id column."""
    found = first_present_column(df, ID_COLUMNS)
    if found is None:
        raise ValueError(f"no patient id column among {df.columns}")
    return found


def select_items(df: DataFrame, include: str, exclude: str | None = None,
                 fallback: str | None = None, at_least: int = 1) -> list[str]:
    """Columns matching ``include`` but not ``exclude``; ``fallback`` replaces ``include`` when nothing matches."""
    def matching(pattern: str) -> list[str]:
        return [c for c in df.columns
                if re.search(pattern, c) and not (exclude and re.search(exclude, c))]

    items = matching(include)
    if not items and fallback:
        items = matching(fallback)
    if len(items) < at_least:
        raise ValueError(f"{len(items)} item columns match {include!r}, at least {at_least} needed")
    return items


def clean_name(name: str) -> str:
    """Header text as an ASCII snake_case identifier."""
    text = name.replace("ß", "ss").replace("%", "_percent_").replace("#", "_number_")
    text = text.replace("'", "").replace('"', "")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    if not text or text[0].isdigit():
        text = f"x{text}"
    return text


def clean_header(header: Sequence[str]) -> list[str]:
    """Cleaned names of all headers; repeats get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for column in header:
        name = clean_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to its cleaned name."""
    return df.toDF(*clean_header(df.columns))


def standardize_id(df: DataFrame, id_col: str | None = None, out: str = "patient_id") -> DataFrame:
    """Rename the id column to ``out`` and make it a trimmed string."""
    id_col = id_col or detect_id_column(df)
    return df.withColumnRenamed(id_col, out).withColumn(out, F.trim(F.col(out).cast("string")))
