"""Standardised effect sizes of change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.functions.categories import GROUPS
from duowave.operators.anova import side_by_side
from duowave.plans.scratch import materialize

# Fixed value: normal quantile of the 95 % limits.
Z95 = 1.96


def change_stats(pairs: DataFrame, by: Sequence[str], group: str, change: str, n_mode: str = "known") -> DataFrame:
    """Count, mean and variance of change per group; the shared aggregation of all effect sizes."""
    size = F.count(change) if n_mode == "known" else F.count("*")
    return pairs.where(F.col(group).isin(*GROUPS)).groupBy(*by, group).agg(
        size.alias("n"), F.avg(change).alias("m"), F.var_samp(change).alias("v")
    )


def effect_dz(pairs: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group",
              change: str = "change") -> DataFrame:
    """Within-group effect: mean change over its standard deviation, with 95 % limits."""
    return dz_of(change_stats(pairs, by, group, change), by, group)


def dz_of(stats: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Within-group effects from ``change_stats``."""
    usable = (F.col("n") >= 2) & (F.col("v") > 0)
    dz = F.when(usable, F.try_divide(F.col("m"), F.sqrt("v")))
    se = F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.pow("dz", F.lit(2)), 2 * (F.col("n") - 1)))
    return (
        stats.withColumn("dz", dz).withColumn("se", se)
        .select(*by, group, "n", "dz", "se", (F.col("dz") - Z95 * F.col("se")).alias("ci_low"),
                (F.col("dz") + Z95 * F.col("se")).alias("ci_high"))
    )


def effect_hedges_g(pairs: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group",
                    change: str = "change", n_mode: str = "known") -> DataFrame:
    """Between-group effect on change, small-sample corrected, with 95 % limits.

    ``n_mode="all"`` counts rows with an unknown change in the group sizes.
    """
    return hedges_g_of(change_stats(pairs, by, group, change, n_mode), by, group)


def hedges_g_of(stats: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Between-group effects from ``change_stats``."""
    wide = side_by_side(stats, by, ["n", "m", "v"], group)
    n_c, n_i = F.col("n_c"), F.col("n_i")
    usable = (n_c >= 2) & (n_i >= 2) & (F.col("v_c") > 0) & (F.col("v_i") > 0)
    total = n_c + n_i
    pooled = F.sqrt(F.try_divide((n_i - 1) * F.col("v_i") + (n_c - 1) * F.col("v_c"), total - 2))
    d = F.try_divide(F.col("m_i") - F.col("m_c"), pooled)
    g = F.when(usable, d * (1 - 3 / (4 * total - 9)))
    se = F.sqrt(total / (n_i * n_c) + F.pow("g", F.lit(2)) / (2 * (total - 2)))
    return (
        wide.withColumn("g", g).withColumn("se", F.when(F.col("g").isNotNull(), se))
        .select(*by, n_i.alias("n_i"), n_c.alias("n_c"), "g", "se",
                (F.col("g") - Z95 * F.col("se")).alias("ci_low"), (F.col("g") + Z95 * F.col("se")).alias("ci_high"))
    )


def effect_table(pairs: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group",
                 digits: int = 3) -> DataFrame:
    """Within-group and between-group effects in one rounded table."""
    stats = materialize(change_stats(pairs, by, group, "change"), "change_stats")
    within = dz_of(stats, by, group).select(
        *by, F.concat(F.lit("dz (within) "), F.col(group)).alias("metric"), F.col("dz").alias("effect"),
        "ci_low", "ci_high", F.col("n").cast("string").alias("n"),
    )
    between = hedges_g_of(stats, by, group).select(
        *by, F.lit("g (between Δ)").alias("metric"), F.col("g").alias("effect"), "ci_low", "ci_high",
        F.format_string("I=%d, C=%d", "n_i", "n_c").alias("n"),
    )
    rounded = {c: F.round(c, digits) for c in ("effect", "ci_low", "ci_high")}
    return within.unionByName(between).withColumns(rounded)
