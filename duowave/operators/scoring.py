"""Row-wise scoring of item columns; plain column sums, so scoring never shuffles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.text import likert_code


def row_missing(items: Sequence[str]) -> Column:
    """Number of unanswered items."""
    return reduce(add, [F.col(c).isNull().cast("int") for c in items])


def row_answered(items: Sequence[str]) -> Column:
    """Number of answered items."""
    return reduce(add, [F.col(c).isNotNull().cast("int") for c in items])


def row_sum(items: Sequence[str]) -> Column:
    """Sum of the answered items, 0 when there are none."""
    return reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in items])


def row_mean(items: Sequence[str]) -> Column:
    """Mean of the answered items, NULL when there are none."""
    return F.try_divide(row_sum(items), row_answered(items))


def missing_allowed(n_items: int, max_count: int | None = None, max_prop: float | None = None) -> int:
    """Largest tolerated number of missing items, as an integer so that no rounding error can reject a row."""
    if max_count is not None:
        return max_count
    return math.floor((max_prop or 0.0) * n_items + 1e-9)


def impute_scale(df: DataFrame, items: Sequence[str], score_name: str, max_missing_count: int | None = None,
                 max_missing_prop: float | None = None) -> DataFrame:
    """Fill missing items with the row's own mean when few enough are missing, and add the total.

    Rows beyond the tolerance keep their gaps and get a NULL total.
    """
    if not items:
        raise ValueError("no item columns to score")
    tolerated = row_missing(items) <= missing_allowed(len(items), max_missing_count, max_missing_prop)
    return (
        df.withColumn("_tolerated", tolerated)
        .withColumn("_fill", F.when(F.col("_tolerated"), row_mean(items)))
        .withColumns({c: F.coalesce(F.col(c).cast("double"), "_fill") for c in items})
        .withColumn(score_name, F.when(F.col("_tolerated"), row_sum(items)))
        .drop("_tolerated", "_fill")
    )


def score_observed(items: Sequence[str], max_missing: int) -> Column:
    """Sum of the answered items when at most ``max_missing`` are missing."""
    return F.when(row_missing(items) <= max_missing, row_sum(items))


def score_prorated(items: Sequence[str], answered_share: float = 0.8) -> Column:
    """Mean answer times the number of items when enough items are answered."""
    needed = math.ceil(answered_share * len(items) - 1e-9)
    return F.when(row_answered(items) >= needed, row_mean(items) * len(items))


def score_percent(items: Sequence[str], min_answered: int = 4, points: int = 5, factor: int = 4) -> Column:
    """Prorated sum over ``points`` items scaled by ``factor`` to 0-100."""
    return F.when(row_answered(items) >= min_answered, row_mean(items) * points * factor)


def score_preferred(*scores: str) -> Column:
    """First score that is known."""
    return F.coalesce(*scores)


def apply_across(df: DataFrame, items: Sequence[str], fn) -> DataFrame:
    """Replace every item column by ``fn(column)`` in one pass.

    Columns of one type go through an array, so that the generated code holds ``fn`` once: written out
    per column, the text patterns of a scale of 20 items exceed what the JVM compiles.
    """
    kinds = {df.schema[c].dataType.simpleString() for c in items}
    if len(kinds) > 1:
        return df.withColumns({c: fn(F.col(c)) for c in items})
    packed = df.withColumn("_items", F.transform(F.array(*items), lambda c: fn(c)))
    return packed.withColumns({c: F.col("_items")[i] for i, c in enumerate(items)}).drop("_items")


def code_items(df: DataFrame, items: Sequence[str], codes: Mapping[str, float] | None = None,
               number_first: bool = True) -> DataFrame:
    """Replace item texts by codes; numbers count as texts."""
    df = df.withColumns({c: F.col(c).cast("string") for c in items})
    return apply_across(df, items, lambda c: likert_code(c, codes, number_first))


def keep_any_observed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one known value among ``columns``."""
    return df.where(F.coalesce(*columns).isNotNull())
