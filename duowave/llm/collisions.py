"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on random lines, and every line's projections are sorted. Around the query's place on each line a
window grows by virtual rehashing: its half width is the search radius, which is multiplied from round to round. A
vector that lies in the windows of enough lines has collided often enough to be verified, that is scored exactly; the
search of a block ends once enough of its vectors are.

For the largest inner product all vectors get one more entry, which brings them to one length; the nearest vectors to
the query, stretched to that length, are then those of largest inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duowave.llm.tables import table
from duowave.plans.scratch import Scratch

# Lines, share of lines that a vector must collide on, first radius in lengths and its growth.
LINES = 64
COLLIDE = 0.6
FIRST_RADIUS, GROWTH, ROUNDS = 0.7, 1.15, 16
# A block's search ends when this share of its vectors, and the wanted number, have been verified.
VERIFY = 0.4
SEED = 20250902
# Vectors indexed together, and queries sent to the tasks at a time.
BLOCK_VECTORS = 32_000
QUERY_BYTES = 16_000_000
NEIGHBOURS, QUERY_EVERY = 20, 20


def usable(vector: Column) -> Column:
    """Not null, with finite entries only, one of which is not zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the entry that brings them to the common length."""
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


class LineIndex:
    """Sorted projections of one block of vectors, and each vector's rank on every line."""

    def __init__(self, vectors: np.ndarray, lines: np.ndarray, longest: float):
        if len(vectors) >= 1 << 16:
            raise ValueError("a block has fewer than 65,536 vectors")
        self.vectors = vectors
        projected = (_lengthened(vectors, longest) @ lines).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.ranks = np.empty(order.shape, dtype=np.uint16)
        np.put_along_axis(self.ranks, order, np.arange(len(vectors), dtype=np.uint16)[None, :], axis=1)

    def windows(self, places: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First rank and width of the window around every query (a column of ``places``) on every line."""
        low = np.stack([np.searchsorted(s, p - radius, side="left") for s, p in zip(self.sorted, places)])
        high = np.stack([np.searchsorted(s, p + radius, side="right") for s, p in zip(self.sorted, places)])
        return low.astype(np.uint16), (high - low).astype(np.uint16)

    def search(self, places: np.ndarray, radii: np.ndarray, collide: int, enough: int):
        """Per query the vectors that collided often enough; ``places`` has the queries' projections by line."""
        inside = np.empty(self.ranks.shape, dtype=bool)
        shifted = np.empty_like(self.ranks)
        waiting = np.arange(places.shape[1])
        for radius in radii:
            low, width = self.windows(places[:, waiting], radius)
            later = []
            for i, q in enumerate(waiting):
                # Ranks below the window wrap round to large numbers.
                np.subtract(self.ranks, low[:, i, None], out=shifted)
                np.less(shifted, width[:, i, None], out=inside)
                found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= collide)
                if len(found) >= enough:
                    yield q, found
                else:
                    later.append(q)
            waiting = np.array(later, dtype=np.int64)
            if not len(waiting):
                return
        # No radius was wide enough for the wanted number: all vectors are verified.
        for q in waiting:
            yield q, np.arange(len(self.vectors))


def _best(index: LineIndex, ids: np.ndarray, query: np.ndarray, own: int, found: np.ndarray, k: int):
    """The ``k`` verified vectors of largest inner product with the query, ties to smaller ids."""
    found = found[ids[found] != own]
    if len(found) > 4 * k:
        rough = index.vectors[found] @ query
        found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
    # Row by row in one order of adding, so that equal vectors get equal scores.
    score = (index.vectors[found] * query).sum(axis=1)
    best = np.lexsort((ids[found], -score))[:k]
    return ids[found[best]], score[best]


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
            lines: int = LINES, verify: float = VERIFY, block_vectors: int = BLOCK_VECTORS,
            query_bytes: int = QUERY_BYTES, seed: int = SEED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` rows of largest inner product with each query.

    Queries are the rows for which ``is_query`` holds; a query is compared with all rows of another id. Vectors that are
    null, zero or hold null or non-finite entries take no part, nor do null ids, nor vectors of another length than most
    have. An id that comes more than once is one query (its smallest vector); repeated rows are found each. With fewer
    rows than ``k`` all are found. Empty tables give no rows.

    Every row is indexed, in blocks of ``block_vectors`` that are searched where they lie; of each block ``k`` rows a
    query are passed on. Queries go to the tasks ``query_bytes`` at a time, each time over all blocks.
    """
    if not 0 < lines < 256:
        raise ValueError("lines must be from 1 to 255")
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("longest"))
    shape = shape.orderBy(F.desc("n"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    dim, longest = shape["dim"], float(np.sqrt(shape["longest"]))
    rows = rows.where(F.size("v") == dim)
    axes = np.random.default_rng(seed).standard_normal((dim + 1, lines))
    radii = longest * FIRST_RADIUS * GROWTH ** np.arange(ROUNDS)
    collide = int(np.ceil(COLLIDE * lines))

    per_block = max(1, query_bytes // (8 * (dim + lines)))
    scratch = Scratch(spark, "nearest")
    queries = scratch.write(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-queries.count() // per_block)
    # The hash leaves blocks uneven; half as many queries to a block on average keep all of them small.
    blocks = 2 * blocks if blocks > 1 else blocks

    def search(sent):
        def compute(batches):
            own, asked = sent.value
            places = (_lengthened(asked * (longest / np.linalg.norm(asked, axis=1))[:, None], longest) @ axes).T
            for ids, vectors in _blocks(batches, dim, block_vectors):
                index = LineIndex(vectors, axes, longest)
                out = []
                for q, found in index.search(places, radii, collide, min(len(ids), k + 1 + int(verify * len(ids)))):
                    best, score = _best(index, ids, asked[q], own[q], found, k)
                    out.append((np.full(len(best), own[q]), best, score))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
        return compute

    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        if not part.num_rows:
            continue
        asked = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), asked))
        hits = rows.select("id", "v").mapInArrow(search(sent), "query_id long, vec_id long, score double")
        hits = scratch.write(hits, f"hits_{block}")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _blocks(batches, dim: int, size: int):
    """Ids and vectors, ``size`` rows at a time."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column("id").to_numpy())
        vectors.append(batch.column("v").flatten().to_numpy().reshape(-1, dim))
        held += batch.num_rows
        if held >= size:
            yield np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def op10(spark, sf_dir: str) -> DataFrame:
    """``op10_collision_counting``: the 20 nearest of every twentieth embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors["vec_id"] % QUERY_EVERY == 0)
