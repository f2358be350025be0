"""Clinically meaningful change: thresholds, responders and odds ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.functions.categories import CONTROL, INTERVENTION
from duowave.functions.tails import z_two_sided
from duowave.operators.effects import Z95
from duowave.plans.skew import join_small

# Fixed value: distribution-based threshold, as a share of the baseline standard deviation.
SD_SHARE = 0.5


def mcid_threshold(pairs: DataFrame, rules: Mapping[str, tuple[str, float | None]],
                   by: str = "instrument", pre: str = "pre") -> DataFrame:
    """Direction (``lower`` or ``higher`` is better) and threshold per instrument.

    ``rules`` maps instrument to direction and a constant, or ``None`` for half the baseline standard deviation.
    """
    key = F.col(by)
    direction = F.create_map(*[F.lit(x) for name, (way, _) in rules.items() for x in (name, way)])
    constant = F.create_map(*[F.lit(x) for name, (_, value) in rules.items()
                              for x in (name, None if value is None else float(value))])
    return (
        pairs.where(key.isin(*rules)).groupBy(by).agg(F.stddev_samp(pre).alias("sd_pre"))
        .select(by, F.try_element_at(direction, key).alias("direction"),
                F.coalesce(F.try_element_at(constant, key), SD_SHARE * F.col("sd_pre")).alias("mcid"))
    )


def classify_response(pairs: DataFrame, thresholds: DataFrame, by: str = "instrument",
                      change: str = "change") -> DataFrame:
    """Add ``responder`` and ``worsener``; NULL where the change is unknown."""
    gain = F.when(F.col("direction") == "lower", -F.col(change)).otherwise(F.col(change))
    return join_small(pairs, thresholds, [by], "inner").withColumns({
        "responder": gain >= F.col("mcid"), "worsener": gain <= -F.col("mcid"),
    })


def responder_rates(responses: DataFrame, by: Sequence[str] = ("instrument", "group")) -> DataFrame:
    """Responders and worseners per group; the rate is of all rows, ``n_valid`` counts those with a known change."""
    return responses.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("responder").alias("n_valid"),
        F.count_if("responder").alias("responders"), F.count_if("worsener").alias("worseners"),
    ).withColumn("resp_rate", F.col("responders") / F.col("n"))


def logit_or(responses: DataFrame, by: Sequence[str] = ("instrument",), group: str = "group") -> DataFrame:
    """Logistic regression of response on group, from the 2 x 2 counts; an empty cell gives NULL."""
    known = responses.where(F.col("responder").isNotNull())
    counts = known.groupBy(*by).agg(*[
        F.count_if((F.col(group) == name) & (F.col("responder") == hit)).cast("double").alias(cell)
        for cell, name, hit in (("a", INTERVENTION, True), ("b", INTERVENTION, False),
                                ("c", CONTROL, True), ("d", CONTROL, False))
    ])
    a, b, c, d = (F.nullif(F.col(x), F.lit(0.0)) for x in "abcd")
    return counts.select(*by, F.explode(F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.ln(c / d).alias("estimate"),
                 F.sqrt(1 / c + 1 / d).alias("std_error")),
        F.struct(F.lit("groupIntervention").alias("term"), F.ln(a * d / (b * c)).alias("estimate"),
                 F.sqrt(1 / a + 1 / b + 1 / c + 1 / d).alias("std_error")),
    )).alias("t")).select(*by, "t.*").withColumn(
        "statistic", F.col("estimate") / F.col("std_error")
    ).withColumn("p_value", z_two_sided("statistic"))


def odds_ratio_table(logit: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Odds ratio of the intervention with Wald 95 % limits."""
    half = Z95 * F.col("std_error")
    return logit.where(F.col("term") == "groupIntervention").select(
        *by, F.exp("estimate").alias("odds_ratio"), F.exp(F.col("estimate") - half).alias("ci_low"),
        F.exp(F.col("estimate") + half).alias("ci_high"), "p_value",
    )
