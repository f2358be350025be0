"""Records of quoted CSV files, read by many tasks a file.

Spark splits files at line ends, but a quoted cell may hold line ends. Whether a split begins inside a quoted cell follows
from the number of quotes before it: an odd number in a split turns the state. One aggregation counts them per split,
a running sum over the few splits of a file gives every split its state, and then each split cuts its own lines into
records. What a split border cuts through comes out as fragments, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.plans.scratch import Scratch
from duowave.plans.skew import broadcast_if_small

# Rows that a task hands on at a time.
BATCH = 4096
WHOLE, END, START = 0, 1, 2
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _cut(lines: Iterator[tuple[str, int, int, str]]) -> Iterator[tuple[str, int, int, int, str]]:
    """File, block, line number, kind and text of records and fragments, from lines in order with their block's state."""
    at, number, held, begun, inside, first = None, 0, [], 0, False, WHOLE
    for file, block, odd, line in lines:
        if (file, block) != at:
            if held:
                yield (*at, begun, START if first == WHOLE else END, "\n".join(held))
            at, number, held, inside = (file, block), 0, [], bool(odd)
            first = END if inside else WHOLE
        if not held:
            begun = number
        number += 1
        held.append(line)
        inside ^= bool(line.count('"') & 1)
        if not inside:
            yield file, block, begun, first, "\n".join(held)
            held, first = [], WHOLE
    if held:
        yield (*at, begun, START if first == WHOLE else END, "\n".join(held))


def quoted_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``block``, ``row`` and ``text`` of every record; the first three sort the records of a file.

    Line ends within quotes come out as ``\\n``. A file whose quotes do not come in pairs ends with one record of all that
    follows the last odd one. Blank lines between records are records too.
    """
    scratch = Scratch(spark, "records")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    # One row per split.
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = scratch.write(odd.select(F.col("file").alias("f"), F.col("block").alias("b"),
                                      (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside")), "states")
    small = broadcast_if_small(states)
    same = (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))
    if small is not states:
        # The rows stay where and as they are read.
        stated = lines.join(small, same)
    else:
        stated = lines.withColumn("n", F.monotonically_increasing_id()).join(states, same).repartition("file", "block").sortWithinPartitions(
            "file", "block", "n")

    def records(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "value")))

        held = []
        for record in _cut(rows()):
            held.append(record)
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)

    cut = stated.select("file", "block", "inside", "value").mapInArrow(records, "file string, block long, row long, kind int, text string")
    cut = scratch.write(cut, "cut")
    # A start and the ends that follow it, up to the next start, are one record; at most two fragments a split.
    order = Window.partitionBy("file").orderBy("block", "row")
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("record", F.sum(F.when(F.col("kind") == START, 1).otherwise(0)).over(order))
    joined = pieces.groupBy("file", "record").agg(
        F.min(F.struct("block", "row")).alias("at"), F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
    stitched = joined.select("file", "at.block", "at.row", F.array_join("parts.text", "\n").alias("text"))
    return cut.where(F.col("kind") == WHOLE).select("file", "block", "row", "text").unionByName(stitched)


def read_quoted(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], options: dict) -> DataFrame:
    """Text columns of quoted files whose header has these columns, with ``file``, ``block`` and ``row``."""
    records = quoted_records(spark, path).where(F.trim("text") != "")
    # A file's header is its first record that is not blank.
    heads = records.where("block = 0").groupBy(F.col("file").alias("f")).agg(F.min("row").alias("head"))
    rows = records.join(broadcast_if_small(Scratch(spark, "heads").write(heads, "heads")), F.col("file") == F.col("f"), "left").where(
        (F.col("block") > 0) | (F.col("row") > F.col("head")))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    cells = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return rows.select("file", "block", "row", cells.alias("cells")).select("cells.*", "file", "block", "row")


def largest_file(spark: SparkSession, path: str | Sequence[str]) -> int:
    """Size in bytes of the largest file, from the listing."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
