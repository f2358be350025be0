"""Residuals of the saturated group x time model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.gamma import normal_quantile, polynomial
from duowave.functions.tails import z_two_sided
from duowave.plans.scratch import Scratch
from duowave.plans.skew import BUCKET_ROWS, HOT_KEY_ROWS, join_small, running_index

# Polynomials of the Shapiro-Wilk test by rising powers (algorithm AS R94). The weights of the largest and
# second largest value take powers of 1 / sqrt(n); mean and log deviation of the transformed statistic take n for up to 11
# values and log n beyond; so does the bound below which the statistic of few values is transformed.
LARGEST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_MEAN, FEW_SPREAD = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
MANY_MEAN, MANY_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
FEW_BOUND = (-2.273, 0.459)


def cell_residual(long: DataFrame, by: Sequence[str] = ("instrument", "group", "time"), value: str = "score",
                  out: str = "residual") -> DataFrame:
    """Score minus its cell mean, for rows with a score and a complete cell."""
    known = long.where(F.col(value).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    means = known.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return join_small(known, means, by, "inner").withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def residual_diagnostics(long: DataFrame, by: Sequence[str] = ("instrument",),
                         cell: Sequence[str] = ("group", "time"), value: str = "score",
                         min_rows: int = 3) -> DataFrame:
    """Jarque-Bera normality test of the cell residuals per instrument.

    Residuals are centred within each cell, so their pooled moments are sums of cell moments: one
    aggregation, no residual column and no limit on the number of rows.
    """
    complete = F.col(value).isNotNull()
    for c in cell:
        complete = complete & F.col(c).isNotNull()
    score = F.when(complete, F.col(value))
    cells = long.groupBy(*by, *cell).agg(
        F.count("*").alias("rows"), F.count(score).alias("n"),
        F.var_pop(score).alias("v"), F.skewness(score).alias("sk"), F.kurtosis(score).alias("ku"),
    )
    n, v = F.col("n"), F.coalesce("v", F.lit(0.0))
    sums = cells.groupBy(*by).agg(
        F.sum("rows").alias("n_obs"), F.sum("n").alias("n_resid"),
        F.sum(n * v).alias("s2"),
        F.sum(F.coalesce(n * F.pow(v, 1.5) * F.col("sk"), F.lit(0.0))).alias("s3"),
        F.sum(F.coalesce(n * v * v * (F.col("ku") + 3), F.lit(0.0))).alias("s4"),
    )
    size = F.col("n_resid")
    skew = F.try_divide(F.col("s3") / size, F.pow(F.col("s2") / size, 1.5))
    excess = F.try_divide(F.col("s4") / size, F.pow(F.col("s2") / size, 2)) - 3
    jb = F.when(size >= min_rows, size / 6 * (skew * skew + excess * excess / 4))
    return (
        sums.withColumns({"skewness": F.when(size > 0, skew), "excess_kurtosis": F.when(size > 0, excess)})
        .withColumn("jb", F.when(size > 0, jb))
        .withColumn("p_value", F.exp(-F.col("jb") / 2))
        .select(*by, "n_obs", "n_resid", "skewness", "excess_kurtosis", "jb", "p_value")
    )


def shapiro_wilk(long: DataFrame, by: Sequence[str] = ("instrument",), cell: Sequence[str] = ("group", "time"),
                 value: str = "score", max_rows: int = HOT_KEY_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shapiro-Wilk test of the cell residuals per instrument, for any number of them.

    Residuals are ranked, instruments of more than ``max_rows`` by ranges, and every rank gets its normal score in the
    JVM. What the test needs of them is sums and the two values at either end: weights of all other values are normal
    scores over a common factor. Up to 5000 values this is the usual test; beyond, the same approximation goes on.

    Rows without score or cell have no residual. Fewer than three residuals, or residuals without spread, give null.
    Equal residuals may stand in any order.
    """
    by = list(by)
    scratch = Scratch(long.sparkSession, "shapiro")
    rows = long.select(*by, *[c for c in cell if c not in by], F.col(value).alias("_y"))
    residuals = scratch.write(cell_residual(rows, [*by, *[c for c in cell if c not in by]], "_y", "_r").select(*by, "_r"), "residuals")
    sizes = scratch.write(residuals.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    ranked = join_small(running_index(residuals, by, ["_r"], "_i", max_rows, bucket_rows), sizes, by, "inner")
    i, n, r = F.col("_i"), F.col("_n"), F.col("_r")
    score = normal_quantile((i - 0.375) / (n + 0.25))

    def at(place: Column) -> Column:
        return F.max(F.when(i == place, r))

    sums = ranked.withColumn("_m", score).groupBy(*by).agg(
        F.first("_n").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("mm"), F.sum(F.col("_m") * r).alias("mr"),
        F.var_pop(r).alias("v"), at(F.lit(1)).alias("r1"), at(F.lit(2)).alias("r2"), at(n - 1).alias("s2"), at(n).alias("s1"),
        F.max("_m").alias("m1"), F.max(F.when(i == n - 1, F.col("_m"))).alias("m2"))
    n, root = F.col("n"), F.sqrt(F.col("mm"))
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(polynomial(LARGEST, 1 / F.sqrt(n)) + F.try_divide("m1", root))
    a2 = polynomial(SECOND, 1 / F.sqrt(n)) + F.try_divide("m2", root)
    both = n > 5
    two_m1, two_m2 = 2 * F.col("m1") * F.col("m1"), F.when(both, 2 * F.col("m2") * F.col("m2")).otherwise(0.0)
    left = 1 - 2 * F.col("a1") * F.col("a1") - F.when(both, 2 * F.col("a2") * F.col("a2")).otherwise(0.0)
    factor = F.sqrt(F.try_divide(F.col("mm") - two_m1 - two_m2, left))
    ends, seconds = F.col("s1") - F.col("r1"), F.when(both, F.col("s2") - F.col("r2")).otherwise(0.0)
    inner = F.col("mr") - F.col("m1") * ends - F.col("m2") * seconds
    # Of three values the middle one has no weight.
    product = F.when(n == 3, 0.0).otherwise(F.try_divide(inner, factor)) + F.col("a1") * ends + F.col("a2") * seconds
    w = F.when((n >= 3) & (F.col("v") > 0), F.least(product * product / (n * F.col("v")), F.lit(1.0)))
    tested = sums.withColumns({"a1": a1, "a2": a2}).withColumn("w", w).withColumn("p_value", _shapiro_p(n, F.col("w")))
    total = long.groupBy(*by).agg(F.count("*").alias("n_obs"))
    return join_small(total, tested.select(*by, F.col("n").alias("n_resid"), "w", "p_value"), by).select(
        *by, "n_obs", F.coalesce("n_resid", F.lit(0)).alias("n_resid"), "w", "p_value")


def _shapiro_p(n: Column, w: Column) -> Column:
    """Upper tail of the transformed statistic."""
    rest = F.log(1 - w)
    log_n = F.log(n)
    bound = polynomial(FEW_BOUND, n)
    few = (-F.log(bound - rest) - polynomial(FEW_MEAN, n)) / F.exp(polynomial(FEW_SPREAD, n))
    many = (rest - polynomial(MANY_MEAN, log_n)) / F.exp(polynomial(MANY_SPREAD, log_n))
    z = F.when(n <= 11, few).otherwise(many)
    half = z_two_sided(z) / 2
    upper = F.when(z > 0, half).otherwise(1 - half)
    three = F.greatest(6 / F.lit(3.141592653589793) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    return F.when(n == 3, three).when((n <= 11) & (rest >= bound), F.lit(1e-99)).when(w >= 1, F.lit(1.0)).otherwise(upper)
