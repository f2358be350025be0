"""Questionnaire exports in, result tables in and out."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.functions.dates import ISO_TIME, parse_datetime_text
from duowave.functions.names import clean_header, require_columns
from duowave.functions.text import WHOLE_NUMBER, blank_to_null, to_numeric
from duowave.sources.records import largest_file, read_quoted

# Spellings of truth values in exports.
TRUE_TOKENS = ("t", "true")
FALSE_TOKENS = ("f", "false")
# Size in bytes from which files with quoted line breaks are split.
SPLIT_ABOVE = 128_000_000
# Files whose first lines one job reads.
HEADERS_AT_ONCE = 64
# Signs of path patterns, which stand for themselves in the name of a file.
_PATTERN_SIGNS = re.compile(r"[\\\[\]{}*?]")


def scan_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _typed(name: str, kind: T.DataType):
    text = F.col(name)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        token = F.lower(text)
        return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)
    if isinstance(kind, T.IntegralType):
        # Directly, as whole numbers beyond 2^53 would lose digits as doubles.
        return F.coalesce(text.try_cast(kind), to_numeric(text).try_cast(kind))
    if isinstance(kind, T.NumericType):
        return to_numeric(text).try_cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return parse_datetime_text(text)
    return text.try_cast(kind)


def _first_lines(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, str]]:
    """Name, as a path pattern, and first line of every file that has a line.

    A limit ends a scan after one buffer, so the size of a file does not matter; several files go into a job.
    """
    # The listing alone; no content is read.
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found: list[tuple[str, str]] = []
    for at in range(0, len(files), HEADERS_AT_ONCE):
        names = [_PATTERN_SIGNS.sub(r"\\\g<0>", f) for f in files[at:at + HEADERS_AT_ONCE]]
        firsts = [spark.read.text(f).limit(1).select(F.lit(f).alias("file"), "value") for f in names]
        found += [(r["file"], r["value"]) for r in reduce(DataFrame.unionAll, firsts).collect()]
    return found


def _headers(spark: SparkSession, path: str | Sequence[str], form: dict) -> dict[tuple[str, ...], list[str]]:
    """Files by their cleaned header; only first lines and file names reach the driver."""
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in _first_lines(spark, path):
        if line.count('"') % 2:
            # A quoted line break in the header.
            header = list(spark.read.options(**form).csv(file).first())
        else:
            header = next(csv.reader([line.removeprefix("\ufeff")]), [])
        found.setdefault(tuple(clean_header([h or "" for h in header])), []).append(file)
    return found


def infer_types(texts: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """Types that fit every known value of the text columns, from one aggregate over all rows.

    Whole numbers, other numbers, truth values and ISO times; everything else, such as numbers with leading
    zeros, stays text, as does a column without any value.
    """
    tests = {
        "whole": lambda c: c.rlike(r"^[-+]?(0|[1-9]\d{0,17})$"),
        "number": lambda c: c.rlike(WHOLE_NUMBER) & ~c.rlike(r"^[-+]?0\d"),
        "truth": lambda c: F.lower(c).isin(*TRUE_TOKENS, *FALSE_TOKENS),
        "time": lambda c: c.rlike(ISO_TIME) & parse_datetime_text(c).isNotNull(),
    }
    if not columns:
        return {}
    counts = texts.agg(*[F.struct(F.count(c).alias("known"), *[F.count_if(fn(F.col(c))).alias(k) for k, fn in tests.items()])
                         .alias(c) for c in columns]).first()
    kinds = {"whole": T.LongType(), "number": T.DoubleType(), "truth": T.BooleanType(), "time": T.TimestampNTZType()}
    found = {}
    for c in columns:
        fits = next((kind for k, kind in kinds.items() if counts[c]["known"] and counts[c][k] == counts[c]["known"]), None)
        if fits is not None:
            found[c] = fits
    return found


def read_export(spark: SparkSession, path: str | Sequence[str], types: dict[str, T.DataType] | None = None,
                multi_line: bool = True, ingest_seq: bool = True, infer: bool = True, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Read CSV exports with cleaned names, trimmed texts and column types.

    All missing-value tokens become NULL; a text that does not fit its type becomes NULL too. ``types`` names the type
    of columns; the others get the type that all their values fit (:func:`infer_types`) unless ``infer`` is off.
    Every file is read by its own header; files are put together by column name, with NULL where a file lacks a column.
    ``ingest_seq`` adds a sortable position (file, block, row) that follows the order within each file.
    Quoted line breaks need ``multi_line``, which reads a file in one task unless one is larger than ``split_above``
    bytes; then files are split, and cut into records by the quotes before them. Pass
    ``False`` when no cell holds a line break.
    """
    split = multi_line and largest_file(spark, path) > split_above
    form = {"encoding": "UTF-8", "multiLine": multi_line, "escape": '"'}
    headers = _headers(spark, path, form)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )

    def read(columns: Sequence[str], files: str | Sequence[str]) -> DataFrame:
        if split:
            found = read_quoted(spark, files, columns, {"escape": '"', "multiLine": "true"})
            return found.select(*columns, *([F.struct("file", "block", "row").alias("ingest_seq")] if ingest_seq else []))
        texts = spark.read.options(header=True, **form).schema(
            T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(files)
        return texts.select("*", position.alias("ingest_seq")) if ingest_seq else texts

    parts = [read(columns, path if len(headers) == 1 else files) for columns, files in sorted(headers.items())]
    texts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in texts.columns if c != "ingest_seq"]
    texts = texts.select(*columns, *(["ingest_seq"] if ingest_seq else []))
    texts = texts.withColumns({c: blank_to_null(c) for c in columns})
    types = dict(types or {})
    require_columns(texts, types)
    if infer:
        types = infer_types(texts, [c for c in columns if c not in types]) | types
    return texts.withColumns({c: _typed(c, kind) for c, kind in types.items()}) if types else texts


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result table as a folder of CSV files with headers, replacing an earlier result."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """Write a row-scale table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_result_checked(spark: SparkSession, path: str, schema: T.StructType,
                        required: Sequence[str] | None = None) -> DataFrame:
    """Read a result table back with a declared schema after checking its header for ``required`` columns."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required or schema.names)
    ordered = T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType())
                            for c in header.columns])
    return spark.read.schema(ordered).option("header", True).csv(path)
