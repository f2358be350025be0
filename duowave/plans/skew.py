"""Ways to number, bucket and join rows that hold when one key owns a large share of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duowave.plans.scratch import Scratch, materialize

# A key with more rows than this is never handled by a single task.
HOT_KEY_ROWS = 5_000_000
# Target size of one range bucket.
BUCKET_ROWS = 500_000
# Largest table that gets a broadcast hint, in rows and in bytes of its files.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """Add the broadcast hint to a written table of at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes."""
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES and written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(written)
    return written


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join an aggregate to its source rows, broadcasting it only when its counted size allows.

    The aggregate is computed once. Without the broadcast a handful of group keys would pull the
    whole of ``big`` through a shuffle into as many tasks.
    """
    on = list(on)
    return big.join(broadcast_if_small(materialize(small, "lookup")), on, how)


def range_buckets(df: DataFrame, order: Sequence[str], rows: int, scratch: Scratch, name: str,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Written copy of ``df`` with a ``bucket`` column: consecutive ranges of ``order`` of even size.

    Rows that share the leading order columns may span several buckets, so a hot value is split as
    long as the trailing order columns differ.
    """
    n = max(1, -(-rows // bucket_rows))
    ranged = df.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id())
    return scratch.write(ranged, name)


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                  max_rows: int = HOT_KEY_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``out``, the 1-based position of each row within ``keys`` sorted by ``order``.

    Keys of up to ``max_rows`` rows use a plain window. Larger keys are cut into range buckets,
    numbered per bucket, and shifted by the sizes of the buckets before.
    """
    keys, order = list(keys), list(order)
    scratch = Scratch(df.sparkSession, "index")
    hot = scratch.write(
        df.groupBy(*keys).count().where(F.col("count") > max_rows), "hot_keys"
    )
    window = Window.partitionBy(*keys).orderBy(*order)
    hot_rows = hot.agg(F.sum("count")).first()[0]
    if not hot_rows:
        return df.withColumn(out, F.row_number().over(window).cast("long"))

    hot_keys = broadcast_if_small(hot.select(*keys))
    cold = df.join(hot_keys, same_keys(df, hot_keys, keys), "left_anti").withColumn(
        out, F.row_number().over(window).cast("long")
    )
    cut = range_buckets(
        df.join(hot_keys, same_keys(df, hot_keys, keys), "left_semi"),
        [*keys, *order], hot_rows, scratch, "hot_rows", bucket_rows,
    )
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per hot key and bucket: no more than buckets + hot keys.
    shifts = scratch.write(
        cut.groupBy(*keys, "bucket").count()
        .withColumn("shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count"), "shifts"
    )
    numbered = cut.withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    )
    warm = numbered.join(
        broadcast_if_small(shifts),
        same_keys(numbered, shifts, [*keys, "bucket"]),
    ).select(*[numbered[c] for c in df.columns], (F.col("place") + F.col("shift")).alias(out))
    return cold.unionByName(warm)
