"""Shared ways to read tables, key rows and walk sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of code points other than the ASCII white space that bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(df: DataFrame, id_col: str, text_col: str, **others: Column) -> DataFrame:
    """``id``, ``text`` and the given columns, so that no column of ``df`` can clash with those an operator adds."""
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"),
                     *[c.alias(n) for n, c in others.items()])


def with_text_key(df: DataFrame) -> DataFrame:
    """Add ``text_key``: with the id it tells rows of one id apart; equal rows share it and get equal results."""
    return df.withColumn("text_key", F.xxhash64("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on id and text key, nulls equal."""
    return a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 texts of an Arrow column one at a time, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what is made of a batch of texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows with equal ``keys``, as columns; a run may span batches. Integer columns only."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        for start, stop in zip(edges[:-1], edges[1:]):
            part = {c: x[start:stop] for c, x in cols.items()}
            if held and any(held[0][k][0] != part[k][0] for k in keys):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()
