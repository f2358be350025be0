"""Substring dedup with difference-cover anchors.

Positions of a document whose remainder modulo a period lies in a difference cover carry an anchor: the hash of a few
words from there on. For any two positions p and q some shift t below the period puts p + t and q + t into the
cover, so two equal windows of period + anchor - 1 words share an aligned anchor. Only windows holding an anchor that
other documents also have are hashed as a whole; equal hashes of whole windows then decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.llm.tables import as_bytes, keyed_texts, slices, table, with_text_key
from duowave.plans.scratch import Scratch

WINDOW_WORDS = 50
# A perfect difference set modulo 31, where every shift is the difference of one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
# Odd multipliers of the two rolling hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# An anchor is frequent from this count on, or from this share of all; so there are at most 1 / share frequent ones.
FREQUENT_COUNT, FREQUENT_SHARE = 1000, 1e-5
# Anchors counted together in a task, and the least count there that is reported.
COUNTED_TOGETHER, REPORTED_COUNT = 2_000_000, 32
# Parts into which the windows that begin with a frequent anchor are dealt.
SALTS = 1023


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    """Raise unless every shift modulo ``period`` is a difference of two cover positions."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:
    """The first ``n`` or more powers of ``base`` modulo 2 ** 64; the longest list made is kept."""
    if base not in kept or len(kept[base]) < n:
        out = np.full(1 << n.bit_length(), base, dtype=np.uint64)
        out[0] = 1
        kept[base] = np.cumprod(out, dtype=np.uint64)
    return kept[base]


def window_hashes(hashes: np.ndarray, length: int, base: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of the ``length`` words from each position on, by prefix sums modulo 2 ** 64."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes))[:len(hashes)], dtype=np.uint64)])
    out = (sums[length:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n)[:n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _positions(n: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    member = np.zeros(period, dtype=bool)
    member[list(cover)] = True
    return np.flatnonzero(np.resize(member, n)) if n > 0 else np.empty(0, np.int64)


def _per_document(batch: pa.RecordBatch):
    """Row number, words' hashes, marks of each document that takes part: with an id and no copy of an earlier text."""
    for i, text in enumerate(as_bytes(batch.column("text"))):
        if batch.column("id")[i].is_valid and not batch.column("is_copy")[i].as_py():
            yield i, text.split()


def _frequent_anchors(texts: DataFrame, scratch: Scratch, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Sorted hashes of the anchors that very many texts hold.

    Tasks report what is frequent in a stretch of their rows. An anchor that stays unreported is dealt with like the
    others; the result does not depend on what is found here. At most 1 / ``FREQUENT_SHARE`` hashes reach the driver.
    """
    length = window - period + 1

    def compute(batches):
        held, size = [], 0

        def report():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= REPORTED_COUNT
            return pa.RecordBatch.from_arrays([
                pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()),
                pa.array([size, *n[often].tolist()], pa.int64())], ["h", "n"])

        for batch in batches:
            for text in as_bytes(batch.column("text")):
                words = text.split()
                if len(words) >= window:
                    rolled = window_hashes(word_hashes(words), length)
                    held.append(np.unique(rolled[_positions(len(rolled), period, cover)]))
                    size += len(held[-1])
                if size >= COUNTED_TOGETHER:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counts = scratch.write(
        texts.select("text").mapInArrow(compute, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    everything = counts.where("h IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_COUNT, int(FREQUENT_SHARE * everything))
    found = counts.where(F.col("h").isNotNull() & (F.col("n") >= least)).select("h").toArrow()["h"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[place] == values


def _anchors(docs: DataFrame, frequent, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Each document's different anchors; ``route`` spreads the frequent ones by document and is 0 for the others."""
    length = window - period + 1

    def compute(batches):
        for batch in slices(batches):
            rows, hashes = [], []
            for i, words in _per_document(batch):
                if len(words) < window:
                    continue
                rolled = window_hashes(word_hashes(words), length)
                found = np.unique(rolled[_positions(len(rolled), period, cover)])
                rows.append(np.full(len(found), i))
                hashes.append(found)
            if rows:
                ids = batch.column("id").take(pa.array(np.concatenate(rows)))
                h = np.concatenate(hashes)
                route = np.where(_member(h, frequent.value), ids.to_numpy() | np.int64(1 << 62), 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(route)], ["id", "h", "route"])

    return docs.mapInArrow(compute, "id long, h long, route long")


def _windows(found: DataFrame, frequent, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Hashes of the windows of which an anchor in the first period is among the document's shared ones.

    ``h`` and ``g`` are 79 bits of hash. ``place`` holds the start of the window below the number of the text among
    those of its id. Windows that begin with the words of a frequent anchor are ``hot`` and carry a salt.
    """
    length = window - period + 1

    def compute(batches):
        for batch in slices(batches):
            rows, h, g, places, hot = [], [], [], [], []
            marks = batch.column("shared")
            for i, words in _per_document(batch):
                n = len(words) - window + 1
                if n <= 0 or not marks[i].is_valid:
                    continue
                hashes = word_hashes(words)
                rolled = window_hashes(hashes, length)
                at = _positions(len(rolled), period, cover)
                at = at[_member(rolled[at], np.sort(marks[i].values.to_numpy().view(np.uint64)))]
                # Windows that start at most period - 1 words before a shared anchor.
                step = np.zeros(len(hashes) + 2, dtype=np.int32)
                np.add.at(step, np.maximum(at - period + 1, 0), 1)
                np.add.at(step, at + 1, -1)
                start = np.flatnonzero(np.cumsum(step)[:n] > 0)
                rows.append(np.full(len(start), i))
                h.append(window_hashes(hashes, window)[start])
                g.append(window_hashes(hashes, window, MULTIPLIERS[1])[start])
                places.append(start + (batch.column("number")[i].as_py() << 32))
                hot.append(_member(rolled[start], frequent.value))
            if rows:
                ids = batch.column("id").take(pa.array(np.concatenate(rows)))
                warm = np.concatenate(hot)
                salt = np.where(warm, 1 + ids.to_numpy() % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.concatenate(h).view(np.int64)),
                    pa.array((np.concatenate(g) >> np.uint64(49)).astype(np.int32)),
                    pa.array(np.concatenate(places).astype(np.int64)), pa.array(salt), pa.array(warm),
                ], ["id", "h", "g", "place", "salt", "hot"])

    return found.mapInArrow(compute, "id long, h long, g int, place long, salt int, hot boolean")


def _repeats(windows: DataFrame) -> DataFrame:
    """``id`` and ``place`` of the windows that a smaller id has too.

    One shuffle puts equal windows together, the hot ones salted. Their least ids per salt are few and give the least
    of all; only hot windows are then shuffled again, by a join whose sides Spark can divide where they are skewed.
    """
    # `hot` is no partition key, so that Spark cannot move the filters below the shuffle that all parts share.
    judged = windows.withColumn("lo", F.min("id").over(Window.partitionBy("h", "g", "salt")))
    cold = judged.where("NOT hot AND id > lo").select("id", "place")
    least = judged.where("hot AND id = lo").groupBy("h", "g").agg(F.min("id").alias("least"))
    # Another form of the key: the aggregate gets a shuffle of its own, without which Spark does not divide the join.
    least = least.select(F.col("h").bitwiseXOR(F.lit(1)).alias("z"), F.col("g").alias("y"), "least")
    hot = judged.where("hot").withColumn("x", F.col("h").bitwiseXOR(F.lit(1)))
    hot = hot.join(least, (F.col("x") == F.col("z")) & (F.col("g") == F.col("y")))
    return cold.unionByName(hot.where("id > least").select("id", "place"))


def _removal(joined: DataFrame, window: int, carried: list[T.StructField]) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        *carried,
    ])
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    names = schema.names

    def spans(n_words: int, is_copy: bool, number: int, places) -> list[tuple[int, int]]:
        if is_copy:
            # All windows also start in the earlier document with this text.
            return [(0, n_words)] if n_words >= window else []
        if not places.is_valid:
            return []
        start = places.values.to_numpy()
        start = np.unique(start[start >> 32 == number] & 0xFFFFFFFF)
        if not len(start):
            return []
        # Windows that touch or overlap make one span.
        cut = np.flatnonzero(np.diff(start) > window)
        first = start[np.concatenate([[0], cut + 1])]
        last = start[np.concatenate([cut, [len(start) - 1]])] + window
        return list(zip(first.tolist(), last.tolist()))

    def compute(batches):
        for batch in slices(batches):
            total, gone, kept, removed = [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = text.split()
                found = spans(len(words), batch.column("is_copy")[i].as_py(), batch.column("number")[i].as_py(),
                              batch.column("places")[i])
                left, at = [], 0
                for start, stop in found:
                    left += words[at:start]
                    at = stop
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                removed.append([{"start": a, "stop": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("text"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, span),
                *[batch.column(f.name) for f in carried]], names)

    return joined.mapInArrow(compute, schema)


def _texts_of_ids(docs: DataFrame) -> DataFrame:
    """``rid`` and ``texts``: per id the hashes of its texts and whether a smaller id has the same text."""
    texts = docs.select("id", "key", F.crc32("text").alias("key2"), F.octet_length("text").alias("size")).distinct()
    first = texts.groupBy(F.col("key").alias("k"), F.col("key2").alias("k2"), F.col("size").alias("k3")).agg(F.min("id").alias("first"))
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("key2").eqNullSafe(F.col("k2")) & F.col("size").eqNullSafe(F.col("k3"))
    marked = texts.join(first, same).select("id", "key", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("is_copy"))
    return marked.groupBy(F.col("id").alias("rid")).agg(F.array_sort(F.collect_set(F.struct("key", "is_copy"))).alias("texts"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                   window: int = WINDOW_WORDS, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Cut every word lying in a window whose words also occur in a document of smaller id.

    Per row of ``df``: ``id``, ``text``, ``n_words``, ``n_removed``, ``kept_text`` (remaining words joined by one space),
    ``removed`` (spans of word positions) and, if ``carry`` names columns, ``row`` (a struct of them). Windows are
    judged on the input. Rows of one id are the same document, so they remove nothing from each other; an id should
    have few texts. Texts shorter than a window, empty and null texts keep all words. A null id is neither smaller
    nor larger than any. Empty tables give no rows.

    A text that a smaller id has too is dealt with as a whole, so that copies send no anchors. All steps start from the
    same texts dealt out by id, which Spark shuffles once. Anchors and candidate windows are shuffled once too. Those of
    passages in very many documents would meet in one task; they are found beforehand and spread over many.
    """
    check_cover(period, cover)
    if window < period:
        raise ValueError("the window must be as long as the period")
    row = {"row": F.struct(*[df[c] for c in carry])} if carry else {}
    texts = with_text_key(keyed_texts(df, id_col, text_col, **row)).withColumnRenamed("text_key", "key")
    scratch = Scratch(df.sparkSession, "substrings")
    roles = scratch.write(_texts_of_ids(texts), "texts")
    frequent = df.sparkSession.sparkContext.broadcast(_frequent_anchors(texts, scratch, window, period, cover))
    # Null-safe left joins on id alone everywhere: any other join would deal out the texts anew.
    number = F.array_position(F.transform("texts", lambda t: t["key"]), F.col("key")) - 1
    docs = texts.join(roles, texts["id"].eqNullSafe(roles["rid"]), "left").select(
        *texts.columns, number.alias("number"), F.element_at("texts", (number + 1).cast("int"))["is_copy"].alias("is_copy"))
    anchors = _anchors(docs, frequent, window, period, cover)
    held = anchors.withColumn("n", F.count("*").over(Window.partitionBy("h", "route")))
    # A document has a bounded number of anchors and windows, so the lists are no longer than its text.
    marks = held.where("n > 1 OR route <> 0").groupBy(F.col("id").alias("sid")).agg(F.collect_list("h").alias("shared"))
    marked = docs.join(marks, docs["id"].eqNullSafe(marks["sid"]), "left").where("shared IS NOT NULL").drop("sid")
    repeats = _repeats(_windows(marked, frequent, window, period, cover))
    gone = repeats.groupBy(F.col("id").alias("gid")).agg(F.collect_list("place").alias("places"))
    joined = docs.join(gone, docs["id"].eqNullSafe(gone["gid"]), "left").drop("gid")
    return _removal(joined, window, [docs.schema["row"]] if carry else [])


def op1(spark, sf_dir: str) -> DataFrame:
    """``op1_substring_dedup``: words, removed words and digest of what is kept, per document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                        F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, w, p, array_to_string(w[p:p + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs
  FROM (SELECT v.doc_id, unnest(range(p, p + 50)) AS q FROM windows v JOIN firsts f ON v.s = f.s WHERE v.doc_id > f.lo)
  GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed,
         CASE WHEN qs IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(qs, i)), ' ') END AS kept
  FROM words d LEFT JOIN gone g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(kept) AS kept_sha256
FROM kept
"""
