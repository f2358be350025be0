"""Language-model scores by prediction by partial matching over bytes.

The trie of contexts is a table of counted byte sequences: the last ``order`` bytes and the byte that follows. A byte
is coded in its longest context. Where that context has never been followed by it, an escape (half an occurrence
from each different successor) leads to the context one byte shorter, in which the successors already ruled out
are excluded. Below the empty context all remaining bytes are equally likely.

Probabilities are found once per distinct sequence. Documents are dealt into chunks of bounded size; a chunk asks for
the sequences and words that it holds and for no others, so no table of the whole corpus is ever in one place.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.llm.tables import as_bytes, table

ORDER = 5
# Bytes that UTF-8 never uses: before a text and at its end. The first is never coded.
START, END = 0xFE, 0xFF
SYMBOLS = 255
# Texts of about this many bytes make a chunk.
CHUNK_BYTES = 32_000_000
# Training rows are those whose id's CRC-32 does not have this remainder.
FOLDS, HELD_OUT = 5, 1
_GATHER = 1_000_000


def held_out(id_col: Column) -> Column:
    """Whether a row is held out; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def words_of(text: bytes) -> list[bytes]:
    """Words after lowering A-Z."""
    return text.lower().split()


def sequences(words: list[bytes], order: int) -> np.ndarray:
    """Each byte of the words joined by one space, and the end, with the ``order`` bytes before it, as integers."""
    data = np.frombuffer(bytes([START]) * order + b" ".join(words) + bytes([END]), dtype=np.uint8)
    codes = np.zeros(len(data) - order, dtype=np.int64)
    for i in range(order + 1):
        codes = (codes << 8) | data[i:len(data) - order + i]
    return codes


def word_key(word: bytes) -> int:
    """Negative number from a 63-bit hash; sequences are not negative."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) - (1 << 63)


def _pair_counts(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Counts of byte pairs in training texts, of words and of documents. At most 65,538 rows reach the driver."""
    def compute(batches):
        totals = np.zeros(65_538, dtype=np.int64)
        for batch in batches:
            for text, out in zip(as_bytes(batch.column("text")), batch.column("held_out").to_pylist()):
                if not out:
                    words = words_of(text)
                    totals[:65_536] += np.bincount(sequences(words, 1), minlength=65_536)
                    totals[65_536] += len(words)
                    totals[65_537] += 1
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], ["pair", "n"])

    counts = docs.select("text", "held_out").mapInArrow(compute, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    totals = np.zeros(65_538, dtype=np.int64)
    for row in counts.collect():
        totals[row["pair"]] = row["n"]
    return totals[:65_536].reshape(256, 256), int(totals[65_536]), int(totals[65_537])


def _coded(n, total, kinds, gone, kinds_above, below):
    """Log10 probability on entering a context from a longer one, whose successors (``gone`` occurrences here) are excluded.

    Each different successor gives half an occurrence to the escape.
    """
    escape = kinds - kinds_above
    room = np.maximum(total - gone, 1)
    found = np.log10(np.maximum(n - 0.5, 0.5) / room)
    missed = np.where(escape > 0, np.log10(np.maximum(escape, 1) / (2 * room)), 0.0) + below
    return np.where(n > 0, found, missed)


def _shortest(pairs: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte after each byte, on entering the empty context from the one-byte context."""
    single = pairs.sum(axis=0)
    kinds = int((single > 0).sum())
    unseen = -np.log10(max(SYMBOLS - kinds, 1))
    gone = ((pairs > 0) * single).sum(axis=1)[:, None]
    above = (pairs > 0).sum(axis=1)[:, None]
    return _coded(single[None, :], single.sum(), kinds, gone, above, unseen)


def _contexts(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sequence the number of its context, and per context its occurrences and different successors."""
    which = np.unique(codes >> 8, return_inverse=True)[1]
    return which, np.bincount(which, n).astype(np.int64), np.bincount(which, n > 0).astype(np.int64)


def _whole_groups(batches, group):
    """Columns of consecutive rows, cut only between values of ``group(codes)``; rows are sorted by it."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held = {c: np.concatenate([held[c], x]) if held else x for c, x in cols.items()}
        values = group(held["key"])
        if len(values) > 50_000 and values[0] != values[-1]:
            cut = int(np.searchsorted(values, values[-1]))
            yield {c: x[:cut] for c, x in held.items()}
            held = {c: x[cut:] for c, x in held.items()}
    if held and len(held["key"]):
        yield held


def _two_byte_contexts(grams: DataFrame, pairs) -> DataFrame:
    """Per two context bytes and successor: count, context totals, and the probability one context below."""
    def compute(batches):
        counts = pairs.value
        below = _shortest(counts)
        total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
        for rows in _whole_groups(batches, lambda key: key >> 8):
            key, n = rows["key"], rows["n"]
            last, symbol = (key >> 8) & 255, key & 255
            which, n2, k2 = _contexts(key, n)
            here = counts[last, symbol]
            gone = np.bincount(which, np.where(n > 0, here, 0)).astype(np.int64)
            value = _coded(here, total[last], kinds[last], gone[which], k2[which], below[last, symbol])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key, n, n2[which], k2[which], value)], ["tail", "n2", "total2", "kinds2", "below2"])

    short = grams.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n"))
    dealt = short.withColumn("context", F.shiftright("key", 8)).repartition("context").sortWithinPartitions("context", "key")
    return dealt.select("key", "n").mapInArrow(compute, "tail long, n2 long, total2 long, kinds2 long, below2 double")


def _probabilities(grams: DataFrame, pairs, order: int) -> DataFrame:
    """``key`` and ``value``: log10 probability of each sequence's last byte after the others."""
    def compute(batches):
        for rows in _whole_groups(batches, lambda key: (key >> 8) & 0xFFFFFF):
            lower, shorter = None, None
            for length in range(3, order + 1):
                codes, first, back = np.unique(rows["key"] & ((1 << 8 * (length + 1)) - 1), return_index=True, return_inverse=True)
                n = np.bincount(back, rows["n"]).astype(np.int64)
                which, total, kinds = _contexts(codes, n)
                if lower is None:
                    under = [rows[c][first] for c in ("n2", "total2", "kinds2", "below2")]
                else:
                    place = np.searchsorted(shorter, codes & ((1 << 8 * length) - 1))
                    under = [x[place] for x in lower]
                gone = np.bincount(which, np.where(n > 0, under[0], 0)).astype(np.int64)
                value = _coded(*under[:3], gone[which], kinds[which], under[3])
                lower, shorter = [n, total[which], kinds[which], value], codes
            yield pa.RecordBatch.from_arrays(
                [pa.array(shorter), pa.array(_coded(*lower[:3], 0, 0, lower[3]))], ["key", "value"])

    tails = _two_byte_contexts(grams, pairs)
    # Null-safe, as a plain join would put a test for null below the shared shuffle and so part its uses.
    keyed = grams.join(tails, F.col("key").bitwiseAND(0xFFFFFF).eqNullSafe(F.col("tail")))
    dealt = keyed.withColumn("context", F.shiftright("key", 8).bitwiseAND(0xFFFFFF))
    dealt = dealt.repartition("context").sortWithinPartitions("context", "key")
    return dealt.select("key", "n", "n2", "total2", "kinds2", "below2").mapInArrow(compute, "key long, value double")


def _asked(docs: DataFrame, order: int) -> DataFrame:
    """Per chunk the sequences and words that it holds; ``what`` has the chunk above the number of training occurrences.

    One column for both: branches that need only one of them would otherwise shuffle other rows each.
    """
    def compute(group: pa.Table) -> pa.Table:
        words, others = Counter(), set()
        parts, waiting, size = [], {True: [], False: []}, 0

        def settle():
            for out, arrays in waiting.items():
                if arrays:
                    codes, n = np.unique(np.concatenate(arrays), return_counts=True)
                    parts.append((codes, n * (not out)))
                    arrays.clear()

        for text, out in zip(as_bytes(group["text"]), group["held_out"].to_pylist()):
            found = words_of(text)
            (others if out else words).update(found)
            codes = sequences(found, order)
            waiting[out].append(codes)
            size += len(codes)
            if size > _GATHER:
                settle()
                size = 0
        settle()
        codes = np.unique(np.concatenate([p[0] for p in parts]))
        n = np.zeros(len(codes), dtype=np.int64)
        while parts:
            # A part holds each of its sequences once.
            some, times = parts.pop()
            n[np.searchsorted(codes, some)] += times
        others.difference_update(words)
        keys = np.fromiter((word_key(w) for x in (words, others) for w in x), dtype=np.int64, count=len(words) + len(others))
        times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
        keys = np.concatenate([codes, keys])
        n = np.concatenate([n, times, np.zeros(len(others), np.int64)])
        return pa.table({"key": pa.array(keys), "what": pa.array((group["chunk"][0].as_py() << 32) + n)})

    return docs.groupBy("chunk").applyInArrow(compute, "key long, what long")


class _Counts(dict):
    """Training occurrences by word; looked up by hash once per different word."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys_, self.values_ = keys, values

    def __missing__(self, word: bytes) -> float:
        at = int(np.searchsorted(self.keys_, word_key(word)))
        if at >= len(self.keys_) or self.keys_[at] != word_key(word):
            raise RuntimeError("a word was not counted")
        value = self[word] = float(self.values_[at])
        return value


def _sums(found: list[np.ndarray], grams: np.ndarray, logs: np.ndarray, order: int) -> np.ndarray:
    """Sum of ``logs`` over the sequences of each document; ``grams`` are sorted and hold all of them.

    Sequences of all documents are sorted together, the document in the bits below the sequence, so that each different
    one is looked up once, and in order. A document's sum does not depend on the others.
    """
    bits = 64 - 8 * (order + 1)
    packed = np.concatenate(found).astype(np.uint64) << np.uint64(bits)
    packed |= np.repeat(np.arange(len(found), dtype=np.uint64), [len(c) for c in found])
    packed.sort()
    document = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    codes = (packed >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    place = np.searchsorted(grams, codes[first])
    if not np.array_equal(grams[np.minimum(place, len(grams) - 1)], codes[first]):
        raise RuntimeError("a sequence was not counted")
    value = np.repeat(logs[place], np.diff(np.append(first, len(codes))))
    return np.bincount(document, value, minlength=len(found))


def _scored(docs: DataFrame, answers: DataFrame, order: int, n_ends: int) -> DataFrame:
    """Scores of the documents of each chunk from the answers to what it asked."""
    schema = "id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"
    names = ["id", "held_out", "n_tokens", "n_known", "log_counts", "score"]
    most = 1 << 64 - 8 * (order + 1)

    def compute(texts: pa.Table, answers: pa.Table) -> pa.Table:
        key, value = answers["key"].to_numpy(), answers["value"].to_numpy()
        sort = np.argsort(key)
        key, value = key[sort], value[sort]
        first = int(np.searchsorted(key, 0))
        counts, grams, logs = _Counts(key[:first], value[:first]), key[first:], value[first:]
        n_tokens, n_known, log_counts = [], [], []
        sums, held, size = [], [], 0
        for text in as_bytes(texts["text"]):
            words = words_of(text)
            held.append(sequences(words, order))
            size += len(held[-1])
            if size > _GATHER or len(held) == most:
                sums.append(_sums(held, grams, logs, order))
                held, size = [], 0
            n = np.fromiter(map(counts.__getitem__, words), dtype=np.float64, count=len(words))
            n = np.append(n, n_ends)
            n_tokens.append(len(n))
            n_known.append(int((n > 0).sum()))
            log_counts.append(float(np.log10(n + 0.5).sum()))
        if held:
            sums.append(_sums(held, grams, logs, order))
        return pa.table([texts["id"].combine_chunks(), texts["held_out"].combine_chunks(),
                         pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_counts, pa.float64()),
                         pa.array(np.concatenate([np.zeros(0), *sums]))], names=names)

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(compute, schema)


def ppm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_of_training: Column | None = None,
               order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model learns from all rows for which ``out_of_training`` (default: :func:`held_out`) is not true. Texts are
    lower-cased (A-Z) and read as words joined by one space, then an end. ``score`` is the log10 probability of
    these bytes and the end; ``base_score`` that of the words and the end with counts raised by a half. Null texts are
    empty: only their end is scored. A null id is an empty text for the fold. Repeated rows count and are scored each.
    Without training rows all bytes are equally likely. Empty tables give no rows. Words are told apart by 63-bit hashes.

    ``order`` is at least 3. Each chunk of texts is one group of about ``chunk_bytes`` (or one longer text), so memory
    does not depend on the corpus; a word or sequence has at most one row per chunk.
    """
    if not 3 <= order <= 6:
        raise ValueError("order must be from 3 to 6")
    spark = df.sparkSession
    fold = held_out(df[id_col]) if out_of_training is None else out_of_training
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"),
                      F.coalesce(fold, F.lit(False)).alias("held_out"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(-(-size // chunk_bytes), 2 * spark.sparkContext.defaultParallelism)
    counts, n_words, n_ends = _pair_counts(texts)
    # Two arrays of 65,536 counts at most.
    pairs = spark.sparkContext.broadcast(counts)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk")
    docs = texts.select("id", "text", "held_out", chunk)
    # Dealt out by key once; the sums and the way back both start from there. No key has more rows than there are chunks.
    asked = _asked(docs, order).repartition("key")
    known = asked.groupBy("key").agg(
        F.sum(F.col("what").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n"), (F.max(F.col("key")) >= 0).alias("is_gram"))
    # Read twice, so it has a shuffle of its own that Spark can use twice.
    grams = known.where("is_gram").select("key", "n").repartition(F.shiftright("key", 8).bitwiseAND(0xFFFFFF))
    values = _probabilities(grams, pairs, order).unionByName(
        known.where("NOT is_gram").select("key", F.col("n").cast("double").alias("value")))
    answers = asked.join(values.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select(
        F.shiftright("what", 32).alias("chunk"), "key", "value")
    scored = _scored(docs, answers, order, n_ends)
    # One row: the number of different training tokens.
    kinds = known.agg(F.count_if(~F.col("is_gram") & (F.col("n") > 0)).alias("kinds"))
    train = n_words + n_ends
    floor = F.log10(F.lit(float(train)) + 0.5 * (F.col("kinds") + (1 if n_ends else 0) + 1))
    return scored.crossJoin(F.broadcast(kinds)).select(
        "id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """``op4_ppm``: base and model score of every document."""
    return ppm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
