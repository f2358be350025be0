"""Long to wide, stacking and change scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.functions.categories import TIMES
from duowave.plans.scratch import Scratch


def pivot_pre_post(long: DataFrame, keys: Sequence[str], value: str = "score", prefix: str = "") -> DataFrame:
    """One row per key with the value at each visit label as a column."""
    wide = long.groupBy(*keys).pivot("time", list(TIMES)).agg(F.max(value))
    return wide.withColumnsRenamed({t: f"{prefix}{t}" for t in TIMES}) if prefix else wide


def change_score(wide: DataFrame, pre: str = "pre", post: str = "post", out: str = "change") -> DataFrame:
    """Add post minus pre."""
    return wide.withColumn(out, F.col(post) - F.col(pre))


def all_scales_wide(long: DataFrame, key: str, scales: Mapping[str, str], by: str = "instrument",
                    value: str = "score") -> DataFrame:
    """One row per key with a ``<scale>_<time>`` column per instrument and visit label."""
    cells = [f"{instrument}_{time}" for instrument in scales for time in TIMES]
    wide = (
        long.withColumn("_cell", F.concat_ws("_", by, "time"))
        .groupBy(key).pivot("_cell", cells).agg(F.max(value))
    )
    renames = {f"{i}_{t}": f"{name}_{t}" for i, name in scales.items() for t in TIMES}
    return wide.withColumnsRenamed(renames)


def frames_by(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """One frame per known value of a text column, sorted by it.

    ``df`` is computed once and written by value, so every frame reads its own files only. Values are few; null has no
    frame, and frames lack the column.
    """
    written = Scratch(df.sparkSession, "frames").write(df.where(F.col(column).isNotNull()), "by_value", [column])
    values = sorted(r[0] for r in written.select(column).distinct().collect())
    return {v: written.where(F.col(column) == v).drop(column) for v in values}


def stack_instruments(frames: Mapping[str, DataFrame | None]) -> DataFrame:
    """One long table of all instruments; absent ones are left out."""
    return bind_results([
        df.withColumn("instrument", F.lit(name)) for name, df in frames.items() if df is not None
    ])


def bind_results(frames: Sequence[DataFrame], spark=None, schema: T.StructType | None = None) -> DataFrame:
    """Union by column name; no frames at all give an empty table of ``schema``."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
