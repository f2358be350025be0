"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a linked list. A heap holds the adjacent pairs that the vocabulary can merge, lowest rank
first, then leftmost. Each pop merges one pair and adds its two new neighbours. Only merges are counted: the number of
tokens is the number of initial symbols less the merges, and no ids are made.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.llm.backtracking import over_texts, tokenizer_source
from duowave.llm.tables import table

SPACE = "▁"
TOKEN_LIMIT = 4096
# Chunks whose count is kept; the store is emptied when full.
CACHE_CHUNKS = 250_000


def pieces_of(model: bytes) -> dict[str, int]:
    """Rank by text of the ordinary pieces of a serialized model, best score first.

    The model is a protocol-buffer message whose field 1 repeats the pieces: text (1), score (2), kind (3; 1 ordinary).
    """
    import struct

    def varint(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    def fields(data: bytes):
        at = 0
        while at < len(data):
            tag, at = varint(data, at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(data, at)
            elif kind == 1:
                value, at = data[at:at + 8], at + 8
            elif kind == 2:
                size, at = varint(data, at)
                value, at = data[at:at + size], at + size
            elif kind == 5:
                value, at = data[at:at + 4], at + 4
            else:
                raise ValueError("not a model file")
            yield tag >> 3, value

    scored = []
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            if piece.get(3, 1) == 1:
                scored.append((-struct.unpack("<f", piece[2])[0], len(scored), piece[1].decode()))
    return {text: rank for rank, (_, _, text) in enumerate(sorted(scored))}


class MergeCounter:
    """Counts the tokens of texts under a piece vocabulary with byte fallback and a space put in front."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        longer = [p for p in ranks if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("pieces span words")
        # No piece goes on from another character into a space mark, so merges stay within these chunks; a
        # character that no longer piece has is a chunk of its own.
        alone = "" if any("\n" in p for p in longer) else "\n"
        self.chunks = re.compile(f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else
                                 f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """Number of merges that byte-pair merging makes of ``symbols``."""
        ranks = self.ranks
        heap = []
        for i in range(len(symbols) - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        if not heap:
            return 0
        n = len(symbols)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            _, i, j, size = pop(heap)
            left, right = symbols[i], symbols[j]
            # A pair is stale if one side was merged since: an absorbed symbol is empty, a grown one is longer.
            if not left or not right or len(left) + len(right) != size:
                continue
            done += 1
            both = left + right
            symbols[i], symbols[j] = both, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                rank = ranks.get(both + symbols[k])
                if rank is not None:
                    push(heap, (rank, i, k, len(both) + len(symbols[k])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + both)
                if rank is not None:
                    push(heap, (rank, h, i, len(symbols[h]) + len(both)))
        return done

    def chunk(self, chunk: str) -> int:
        """Tokens of one chunk: a character outside the vocabulary counts once per byte and never merges."""
        if chunk in self.ranks and len(chunk) == 1:
            return 1
        start = sum(1 if c in self.ranks else len(c.encode()) for c in chunk)
        return start - self.merges(list(chunk))

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        cache, total = self.cache, 0
        for chunk in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            n = cache.get(chunk)
            if n is None:
                if len(cache) >= CACHE_CHUNKS:
                    cache.clear()
                n = self.chunk(chunk)
                if len(chunk) <= 64:
                    cache[chunk] = n
            total += n
        return total


def token_counts(df: DataFrame, text_col: str, path: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text; null and empty texts have 0. A column named ``out`` is replaced.

    Rows are independent, so nothing is shuffled. Memory per task is the vocabulary, a store of at most
    ``CACHE_CHUNKS`` short chunks and one batch of texts.
    """
    model = df.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    counter: list[MergeCounter] = []

    def work(batch):
        if not counter:
            counter.append(MergeCounter(pieces_of(model.value)))
        counts = (counter[0].count(t.as_py() or "") for t in batch.column(text_col))
        return [pa.array(np.fromiter(counts, dtype=np.int64, count=batch.num_rows))]

    return over_texts(df, [T.StructField(out, T.LongType())], work)


def op3(spark, sf_dir: str) -> DataFrame:
    """``op3_merge_counts``: bytes, tokens and whether a document exceeds the limit."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
