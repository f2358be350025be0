"""Visit times and the choice of visits per patient.

First, last and latest times are hash aggregates, which combine before the shuffle; only the rows at these times
are compared as a whole. Few such times go to every task; of many a filter does, so that hardly any other row is
shuffled. Only numbering needs every row of a patient in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.dates import parse_any_datetime
from duowave.functions.names import detect_id_column, present_columns, require_columns
from duowave.plans.bloom import MOST_BITS, bitmap_pages, filter_bits, maybe_among
from duowave.plans.scratch import materialize
from duowave.plans.skew import HOT_KEY_ROWS, broadcast_if_small, running_index

# Rows per end of a key from which rows are filtered before the shuffle.
FILTER_FROM = 3

# Visit time columns, best first.
TIME_COLUMNS = ("when_dt", "authored", "created_at", "created", "timestamp", "time", "date", "datum",
                "submitted_at")


def _row(df: DataFrame, keys: Sequence[str], *lead: Column) -> Column:
    """All non-key columns as one comparable value that sorts by ``lead`` first."""
    leads = [c.alias(f"_lead{i}") for i, c in enumerate(lead)]
    return F.struct(*leads, *[F.col(c) for c in df.columns if c not in keys])


def _chosen(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """One row per key, columns in the original order."""
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _at(df: DataFrame, keys: Sequence[str], time_col: str, *ends: Column) -> DataFrame:
    """Rows whose time is one of the key's ``ends`` (or unknown where an end is), with the key's row count ``_n``.

    The ends are hash aggregates of key and time alone, written and measured. Rows of the same time remain, so what
    follows compares few rows of a key.
    """
    ends = [e.alias(f"_end{i}") for i, e in enumerate(ends)]
    times = materialize(df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"), *ends), "ends")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    small = broadcast_if_small(times)
    if small is not times:
        hit = [F.col(time_col).eqNullSafe(F.col(f"_end{i}")) for i in range(len(ends))]
        return df.join(small, reduce(lambda x, y: x & y, same)).where(reduce(lambda x, y: x | y, hit)).select(*df.columns, "_n")
    return _at_many(df, keys, time_col, times, len(ends), same)


def _at_many(df: DataFrame, keys: Sequence[str], time_col: str, times: DataFrame, n_ends: int, same: Sequence[Column],
             most_bits: int = MOST_BITS) -> DataFrame:
    """The same for more keys than can be sent around: a filter over keys and ends goes before the shuffle.

    Key and time are both keys of the join, so a key with many rows is dealt out by time.
    """
    found = times.agg(F.count("*").alias("keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    kept = [f"_k{i}" for i in range(len(keys))]
    at = times.select(*kept, "_n", F.explode(F.array_distinct(F.array(*[F.col(f"_end{i}") for i in range(n_ends)]))).alias("_end"))
    if found["rows"] > FILTER_FROM * n_ends * found["keys"]:
        bits = filter_bits(n_ends * found["keys"], most_bits)
        pages = bitmap_pages(at, [*kept, "_end"], bits)
        df = maybe_among(df, [F.col(c) for c in (*keys, time_col)], pages, bits)
    same = [*same, F.col(time_col).eqNullSafe(F.col("_end"))]
    return df.join(at, reduce(lambda x, y: x & y, same)).select(*df.columns, "_n")


def visit_number(df: DataFrame, keys: Sequence[str], time_col: str, tie_col: str, out: str = "visit_n",
                 max_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Running visit number per key by time, ties by ``tie_col``; unknown times come last."""
    late = df.withColumn("_late", F.col(time_col).isNull())
    return running_index(late, keys, ["_late", time_col, tie_col], out, max_rows).drop("_late")


def when_fallback(df: DataFrame, keys: Sequence[str], seq_col: str, out: str = "when_dt",
                  max_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Use the row's number within its key, in seconds after 1970-01-01, as visit time."""
    numbered = running_index(df.drop(out), keys, [seq_col], "_n", max_rows)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return numbered.withColumn(out, start + F.make_dt_interval(secs=F.col("_n").cast("decimal(18,6)"))).drop("_n")


def get_when(df: DataFrame, seq_col: str, id_col: str | None = None,
             candidates: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Add ``when_dt`` from the first candidate column that parses, row by row.

    Without any candidate, or when none of the values parses, row order per patient stands in.
    """
    found = present_columns(df, candidates)
    if found:
        timed = df.withColumn("when_dt", F.coalesce(*[parse_any_datetime(df, c) for c in found]))
        if not timed.where(F.col("when_dt").isNotNull()).isEmpty():
            return timed
    return when_fallback(df, [id_col or detect_id_column(df)], seq_col)


def add_pre_post(df: DataFrame, keys: Sequence[str], time_col: str, tie_col: str) -> DataFrame:
    """Keep each key's first row as ``pre`` and last row as ``post``; keys with one dated row are dropped."""
    require_columns(df, [*keys, time_col, tie_col])
    dated = df.where(F.col(time_col).isNotNull())
    row = _row(df, keys, F.col(time_col), F.col(tie_col))
    at = _at(dated, keys, time_col, F.min(time_col), F.max(time_col)).where("_n > 1")
    visits = at.groupBy(*keys).agg(F.min(row).alias("_pre"), F.max(row).alias("_post")).select(*keys, F.explode(F.array(
        F.struct(F.lit("pre").alias("time"), F.col("_pre").alias("row")),
        F.struct(F.lit("post").alias("time"), F.col("_post").alias("row")),
    )).alias("_visit"))
    kept = [F.col(c) if c in keys else F.col(f"_visit.row.{c}").alias(c) for c in df.columns]
    return visits.select(*kept, F.col("_visit.time").alias("time"))


def pre_post_pairs(df: DataFrame, keys: Sequence[str], time_col: str, tie_col: str,
                   value: str = "score") -> DataFrame:
    """``add_pre_post`` and ``pivot_pre_post`` in one aggregation: a row per key with pre, post and change."""
    dated = df.where(F.col(time_col).isNotNull()).select(*keys, time_col, tie_col, value)
    at = _at(dated, keys, time_col, F.min(time_col), F.max(time_col)).where("_n > 1")
    ends = at.groupBy(*keys).agg(
        F.min(F.struct(time_col, tie_col, value)).alias("_pre"),
        F.max(F.struct(time_col, tie_col, value)).alias("_post"),
    )
    return (
        ends.select(*keys, F.col(f"_pre.{value}").alias("pre"), F.col(f"_post.{value}").alias("post"))
        .withColumn("change", F.col("post") - F.col("pre"))
    )


def baseline_row(df: DataFrame, keys: Sequence[str], time_col: str, tie_col: str) -> DataFrame:
    """Earliest row per key; a row without time is taken only if there is no other."""
    # The earliest known time; unknown only where all are.
    at = _at(df, keys, time_col, F.min(time_col)).drop("_n")
    return _chosen(at, keys, F.min(_row(df, keys, F.col(time_col), F.col(tie_col))))


def latest_per_cell(df: DataFrame, keys: Sequence[str], time_col: str, tie_col: str) -> DataFrame:
    """Latest row per key, ties by the highest ``tie_col``."""
    at = _at(df, keys, time_col, F.max(time_col)).drop("_n")
    return _chosen(at, keys, F.max(_row(df, keys, F.col(time_col), F.col(tie_col))))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``."""
    # NULL sorts first.
    low = F.when(F.count("*") == F.count(order[0]), F.min(order[0]))
    at = _at(df, keys, order[0], low).drop("_n")
    return _chosen(at, keys, F.min(_row(df, keys, *[F.col(c) for c in order])))
