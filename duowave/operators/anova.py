"""Group x time mixed ANOVA of two visits, from grouped moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duowave.functions.categories import CONTROL, GROUPS, INTERVENTION, signif
from duowave.functions.tails import f_upper
from duowave.plans.skew import join_small


def side_by_side(moments: DataFrame, by: Sequence[str], columns: Sequence[str], group: str = "group") -> DataFrame:
    """Per-group moment rows as one row per ``by`` with suffix ``_c`` (control) and ``_i`` (intervention)."""
    return moments.groupBy(*by).agg(*[
        F.max(F.when(F.col(group) == name, F.col(c))).alias(f"{c}_{suffix}")
        for name, suffix in ((CONTROL, "c"), (INTERVENTION, "i")) for c in columns
    ])


def mixed_anova(pairs: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group",
                min_pairs: int = 3) -> DataFrame:
    """Type III tests of group, time and group:time with partial eta squared.

    ``pairs`` has one row per patient with ``pre`` and ``post``. Rows lacking a score or a declared group are
    dropped; instruments with too few pairs or only one group give no rows.
    """
    known = pairs.where(F.col("pre").isNotNull() & F.col("post").isNotNull() & F.col(group).isin(*GROUPS))
    level, change = (F.col("pre") + F.col("post")) / 2, F.col("post") - F.col("pre")
    moments = known.groupBy(*by, group).agg(
        F.count("*").alias("n"),
        F.avg(level).alias("m"), F.var_samp(level).alias("mv"),
        F.avg(change).alias("d"), F.var_samp(change).alias("dv"),
    )
    wide = side_by_side(moments, by, ["n", "m", "mv", "d", "dv"], group)

    def spread(name: str):
        within = sum((F.coalesce(F.col(f"{name}_{s}") * (F.col(f"n_{s}") - 1), F.lit(0.0)) for s in "ci"), F.lit(0.0))
        return F.try_divide(within, F.col("df2")) * (1 / F.col("n_c") + 1 / F.col("n_i"))

    enough = wide.where((F.col("n_c") > 0) & (F.col("n_i") > 0) & (F.col("n_c") + F.col("n_i") >= min_pairs))
    gap, mean_change = F.col("d_i") - F.col("d_c"), (F.col("d_i") + F.col("d_c")) / 2
    effects = enough.withColumn("df2", F.col("n_c") + F.col("n_i") - 2).withColumns(
        {"hm": spread("mv"), "hd": spread("dv")}
    ).select(*by, "df2", F.explode(F.array(
        F.struct(F.lit("group").alias("effect"), F.try_divide(F.pow(F.col("m_i") - F.col("m_c"), 2), "hm").alias("f")),
        F.struct(F.lit("time").alias("effect"), F.try_divide(F.pow(mean_change, 2), F.col("hd") / 4).alias("f")),
        F.struct(F.lit("group:time").alias("effect"), F.try_divide(F.pow(gap, 2), "hd").alias("f")),
    )).alias("e"))
    tested = effects.select(
        *by, "e.effect", F.col("e.f").alias("f_value"), F.lit(1).cast("long").alias("df1"), "df2",
        (F.col("e.f") / (F.col("e.f") + F.col("df2"))).alias("pes"),
    )
    return tested.withColumn(
        "p_value", f_upper("f_value", F.col("df1").cast("double"), F.col("df2").cast("double"))
    )


def anova_report(anova: DataFrame) -> DataFrame:
    """ANOVA rows rounded for a printed table."""
    return anova.withColumns({
        "f_value": F.round("f_value", 2),
        "p_value": signif(F.col("p_value"), 3),
        "pes": F.round("pes", 3),
    })


def anova_without_outliers(pairs: DataFrame, n: int = 2, ties: bool = False, by: Sequence[str] = ("instrument",),
                           patient: str = "patient", group: str = "group") -> DataFrame:
    """The group:time test on all pairs and without the ``n`` largest absolute changes per instrument.

    One pass finds the n-th largest change; a second marks every row and sums up both models at once.
    """
    pairs = pairs.select(*by, patient, group, "pre", "post", "change")
    known = pairs.where(F.col("change").isNotNull())
    # The n-th largest change per instrument, with the patient that settles ties: a few rows, found by keeping n per task.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("change").desc(), patient))
    nth = known.withColumn("_place", place).where(F.col("_place") <= n).groupBy(*by).agg(
        F.max(F.struct("_place", F.abs("change").alias("size"), F.col(patient).alias("who"))).alias("_nth"))
    marked = join_small(pairs, nth, by)
    size = F.abs("change")
    beyond = size >= F.col("_nth.size") if ties else (size > F.col("_nth.size")) | (
        (size == F.col("_nth.size")) & (F.col(patient) <= F.col("_nth.who")))
    # A row without a patient is never taken for an outlier.
    out = F.coalesce(beyond, F.lit(False)) & F.col(patient).isNotNull()
    models = F.array_compact(F.array(F.lit("with outliers"), F.when(~out, F.lit("without outliers"))))
    stacked = marked.select(*by, group, "pre", "post", F.explode(models).alias("model"))
    return mixed_anova(stacked, [*by, "model"], group).where(F.col("effect") == "group:time").select(
        *by, "model", "f_value", "df1", "df2",
        F.col("p_value").alias("p_value_group_time"), F.col("pes").alias("eta_sq_partial"),
    )
