"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of radius + 1 bits. For each nonzero vector v one table keeps the
fingerprint bits whose vector has an odd product with v. Up to ``radius`` differing bits span less than the whole
space, so some v is orthogonal to all of them: its table drops every differing bit and the pair collides there.
No pair within the radius is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.llm.components import connected_components
from duowave.llm.tables import as_bytes, keyed_texts, runs, same_row, table, with_text_key
from duowave.plans.scratch import Scratch

# Shingle length in words, hash seed and radius in bits.
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
# Buckets with more fingerprints than this are divided by a second set of masks.
BUCKET_LIMIT = 4096


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """Masks of which one at least avoids any ``radius`` of the given bits (all 64 unless given)."""
    bits = list(range(BITS)) if bits is None else bits
    size = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for i, bit in enumerate(bits) if (1 + i % size & v).bit_count() & 1) for v in range(1, size + 1)
    ]


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles; a shorter text is one shingle, an empty one gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle_words + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        shifted = [words[start + k:stop + k] for k in range(shingle_words)]
        hashes = np.array([digest(join(s), seed) for s in zip(*shifted)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(texts: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``id``, ``text_key`` and ``fp`` (64 bits as a long) of rows with ``id``, ``text_key`` and ``text``."""
    def compute(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle_words, seed) for t in as_bytes(batch.column("text"))),
                                 dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(prints.view(np.int64))], ["id", "text_key", "fp"])

    return texts.mapInArrow(compute, "id long, text_key long, fp long")


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over distinct fingerprints linked within the radius."""
    left, right = [], []
    todo = values.copy()
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = np.bitwise_count(todo ^ at) <= radius
            if near.any():
                found, todo = todo[near], todo[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within the radius of each other.

    ``prints`` has distinct ``fp``. Each bucket gives a spanning forest, not its pairs. A bucket of more than
    ``bucket_limit`` fingerprints is divided by covering masks of its free bits; what then remains together
    shares all but about 16 bits and so holds at most 2 ** 16 fingerprints.
    """
    masks = covering_masks(radius)
    scratch = Scratch(prints.sparkSession, "simhash")
    keyed = scratch.write(
        prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                      .alias("t", "key")), "buckets")
    sizes = keyed.groupBy("t", "key").count().where("count > 1")
    full = keyed.join(sizes, ["t", "key"])
    small = full.where(F.col("count") <= bucket_limit).select("t", F.lit(0).alias("v"), "key", "fp")
    inner = F.array(*[F.array(*[F.lit(_signed(m | s)) for s in
                                covering_masks(radius, [b for b in range(BITS) if not m >> b & 1])]) for m in masks])
    large = full.where(F.col("count") > bucket_limit).select(
        "t", "fp", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("v", "mask")
    ).select("t", (F.col("v") + 1).alias("v"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    def link(batches):
        left, right, held = [], [], 0
        for run in runs(batches, ["t", "v", "key"]):
            if len(run["fp"]) < 2:
                continue
            a, b = forest(run["fp"].view(np.uint64), radius)
            left.append(a)
            right.append(b)
            held += len(a)
            if held > 100_000:
                yield _edges(left, right)
                left, right, held = [], [], 0
        if held:
            yield _edges(left, right)

    dealt = small.unionByName(large).repartition("t", "v", "key").sortWithinPartitions("t", "v", "key", "fp")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, seed: int = SEED, radius: int = RADIUS,
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row ``id``, ``text_key``, ``fp`` and ``component`` (smallest id whose fingerprint is reachable by links).

    Null and empty texts have fingerprint 0 and are linked like any other. Equal fingerprints are one node, so
    copies never form pairs. A repeated row gets one result each; a null id names a component only if the
    component has no other. Empty tables give no rows. Other columns of ``df`` are not read.
    """
    scratch = Scratch(df.sparkSession, "near_duplicates")
    texts = with_text_key(keyed_texts(df, id_col, text_col))
    prints = scratch.write(fingerprints(texts, shingle_words, seed), "prints")
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius, bucket_limit))
    rooted = scratch.write(
        nodes.join(roots, nodes["fp"] == roots["node"], "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    components = rooted.join(least, "root").select("fp", "root", "component")
    return prints.join(components, "fp").select("id", "text_key", "fp", "root", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one of smallest id (smallest text hash among rows of that id)."""
    found = near_duplicates(df, id_col, text_col, **options)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    # Rows that are equal are counted before the smallest is taken.
    equal = found.groupBy("root", "id", "text_key").agg(F.count("*").alias("n"))
    chosen = Scratch(df.sparkSession, "kept").write(
        equal.groupBy("root").agg(F.min(F.struct(place.alias("p"), "n")).alias("m")).select("m.p.id", "m.p.text_key", "m.n"), "rows")
    rows = with_text_key(keyed_texts(df, id_col, text_col, row=F.struct(*[df[c] for c in df.columns])))
    single = chosen.where("n = 1")
    kept = rows.join(single, same_row(rows, single), "left_semi").select("row")
    several = chosen.where("n > 1")
    if not several.isEmpty():
        twice = rows.join(several, same_row(rows, several), "left_semi")
        kept = kept.unionByName(twice.groupBy("id", "text_key").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    """``op8_simhash``: doc_id, fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))
