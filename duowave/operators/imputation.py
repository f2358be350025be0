"""Filling missing totals, pooling of multiply-imputed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.functions.categories import GROUPS
from duowave.functions.tails import t_critical, t_two_sided
from duowave.operators.anova import side_by_side
from duowave.plans.skew import join_small


def regression_impute(df: DataFrame, total: str, group: str = "group", by: Sequence[str] = (),
                      out: str = "total_imp") -> DataFrame:
    """Replace a missing total by its prediction from the group, which is the group's mean.

    Rows without a group stay missing. The means are aggregated and joined back, because a window
    over two groups would put half of all rows into one task.
    """
    keys = [*by, group]
    means = df.where(F.col(group).isNotNull()).groupBy(*keys).agg(F.avg(total).alias("_pred"))
    return join_small(df, means, keys, "left").withColumn(out, F.coalesce(total, "_pred")).drop("_pred")


def mi_delta_fit(imputed: DataFrame, by: Sequence[str] = ("instrument",), pre: str = "pre", post: str = "post",
                 group: str = "group", imp: str = "imp") -> DataFrame:
    """Per imputed copy the group effect on change, its squared standard error and residual degrees of freedom."""
    change = F.col(post) - F.col(pre)
    moments = imputed.where(F.col(group).isin(*GROUPS) & change.isNotNull()).groupBy(imp, *by, group).agg(
        F.count("*").alias("n"), F.avg(change).alias("m"), F.var_samp(change).alias("v")
    )
    wide = side_by_side(moments, [imp, *by], ["n", "m", "v"], group)
    within = sum((F.coalesce(F.col(f"v_{s}") * (F.col(f"n_{s}") - 1), F.lit(0.0)) for s in "ci"), F.lit(0.0))
    dof = F.col("n_c") + F.col("n_i") - 2
    return wide.where("n_c > 0 and n_i > 0").select(
        imp, *by, (F.col("m_i") - F.col("m_c")).alias("estimate"),
        (F.try_divide(within, dof) * (1 / F.col("n_c") + 1 / F.col("n_i"))).alias("variance"), dof.alias("dof"),
    )


def rubin_pool(fits: DataFrame, by: Sequence[str] = ("instrument",), term: str = "groupIntervention") -> DataFrame:
    """Pooled estimate over imputed copies with small-sample degrees of freedom (Barnard and Rubin 1999)."""
    pooled = fits.groupBy(*by).agg(
        F.count("*").alias("m"), F.avg("estimate").alias("estimate"), F.avg("variance").alias("u"),
        F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("b"), F.min("dof").alias("dof_complete"),
    )
    extra = (1 + 1 / F.col("m")) * F.col("b")
    lam = F.col("lambda")
    observed = (F.col("dof_complete") + 1) / (F.col("dof_complete") + 3) * F.col("dof_complete") * (1 - lam)
    old = F.try_divide((F.col("m") - 1).cast("double"), lam * lam)
    return (
        pooled.withColumn("total", F.col("u") + extra)
        .withColumn("lambda", F.try_divide(extra, F.col("total")))
        .withColumns({"nu_obs": observed, "nu_old": old})
        .withColumn("dof", F.when(F.col("b") == 0, F.col("nu_obs")).otherwise(
            F.try_divide(F.col("nu_old") * F.col("nu_obs"), F.col("nu_old") + F.col("nu_obs"))))
        .withColumn("std_error", F.sqrt("total"))
        .withColumn("statistic", F.try_divide("estimate", "std_error"))
        .withColumns({"p_value": t_two_sided("statistic", "dof"), "_width": t_critical("dof")})
        .select(*by, F.lit(term).alias("term"), "estimate", "std_error", "statistic", "dof", "p_value",
                (F.col("estimate") - F.col("_width") * F.col("std_error")).alias("conf_low"),
                (F.col("estimate") + F.col("_width") * F.col("std_error")).alias("conf_high"), "m")
    )
