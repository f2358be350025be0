"""Sorted change tables and top changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duowave.plans.skew import join_small


def rank_changes(df: DataFrame, change: str = "change", tie: Sequence[str] = ("patient",)) -> DataFrame:
    """Sort by absolute change, largest first, unknown changes last."""
    return df.orderBy(F.abs(change).desc_nulls_last(), *tie)


def top_changes_n(df: DataFrame, n: int = 2, by: Sequence[str] = (), change: str = "change",
                  tie: str = "patient") -> DataFrame:
    """The ``n`` largest absolute changes (per ``by``), ties broken by ``tie``."""
    order = [F.abs(change).desc_nulls_last(), F.col(tie)]
    if not by:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def top_changes_ties(df: DataFrame, n: int = 2, by: Sequence[str] = ("instrument",),
                     change: str = "change") -> DataFrame:
    """All rows at least as large as the n-th largest absolute change (per ``by``).

    Spark keeps ``n`` rows per task before the shuffle to find the n-th value; the tied rows are then
    filtered in place, however many there are.
    """
    size = df.where(F.col(change).isNotNull()).select(*by, F.abs(change).alias("abs_change"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("abs_change")))
    nth = (
        size.withColumn("_place", place).where(F.col("_place") <= n)
        .groupBy(*by).agg(F.min("abs_change").alias("_nth"))
    )
    return (
        join_small(df, nth, by, "inner")
        .withColumn("abs_change", F.abs(change))
        .where(F.col("abs_change") >= F.col("_nth")).drop("_nth")
    )


def order_levels(df: DataFrame, by: Sequence[str], estimate: str = "estimate", tie: str = "term",
                 out: str = "label_order") -> DataFrame:
    """Number the rows of a result table by estimate within each report."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(estimate), tie)
    return df.withColumn(out, F.row_number().over(order))
