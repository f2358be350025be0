"""Joins of visits, patients and wide tables.

No join carries an unconditional broadcast hint: Spark broadcasts a side below its own size threshold
and splits skewed partitions of the rest at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_group(df: DataFrame, patients: DataFrame, key: str = "patient", patient_key: str = "patient_id",
               how: str = "left") -> DataFrame:
    """Add the patient attributes (study arm) to rows whose key has another name."""
    return df.join(patients, df[key] == patients[patient_key], how).drop(patients[patient_key])


def join_two_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Left join on several shared key columns."""
    return left.join(right, on=list(keys), how=how)


def join_chain(base: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of several one-row-per-key tables, all on the same key so that one partitioning serves all."""
    return reduce(lambda df, other: df.join(other, on=key, how="left"), others, base)


def pick_scores(long: DataFrame, key: str, wanted: Mapping[str, tuple[str, str]], by: str = "instrument",
                value: str = "score") -> DataFrame:
    """One row per key with the score of each wanted ``(instrument, time)`` as a column.

    Replaces a chain of self joins by one aggregation.
    """
    return long.groupBy(key).agg(*[
        F.max(F.when((F.col(by) == instrument) & (F.col("time") == time), F.col(value))).alias(name)
        for name, (instrument, time) in wanted.items()
    ])


def self_join_pre_post(long: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """The pre rows with the post value of the same key, if any."""
    is_pre = F.col("time") == "pre"
    return (
        long.groupBy(*keys).agg(
            F.count_if(is_pre).alias("_n"),
            F.max(F.when(is_pre, F.col(value))).alias(f"{value}_pre"),
            F.max(F.when(F.col("time") == "post", F.col(value))).alias(f"{value}_post"),
        )
        .where("_n > 0").drop("_n")
    )


def full_outer_merge(frames: Sequence[DataFrame], key: str, patients: DataFrame,
                     patient_key: str = "patient_id", group: str = "group") -> DataFrame:
    """Merge one-row-per-key tables, complete the group from the patients and drop rows without one.

    The union and single aggregation give what a chain of full joins on a unique key gives, with one shuffle.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c != key]
    merged = stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in values])
    dim = patients.select(F.col(patient_key).alias(key), F.col(group).alias("_group"))
    return (
        merged.join(dim, on=key, how="left")
        .withColumn(group, F.coalesce(group, "_group")).drop("_group")
        .where(F.col(group).isNotNull())
    )


def semi_in(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids, on=list(keys), how="left_semi")


def anti_not_in(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``ids``; rows without a key stay."""
    return df.join(ids, on=list(keys), how="left_anti")
