"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

One Aho-Corasick pass over a word finds the longest token from each position. The encoder takes the longest token
whose neighbour on the left is compatible, shortens it to the next token that is its prefix where not, and steps back
where none is left. Two tokens are compatible if merging by rank would never join across their border; that is read off
a table of merges and of each token's two parts. The result equals merging by rank, in time linear in the word.
"""

from __future__ import annotations

import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.llm.tables import slices, table

# Offset that marks the last symbol of a word.
_LAST = 0x20000
# Words whose encoding is kept; the store is emptied when full.
CACHE_WORDS = 250_000
# White space of the tokenizer's pattern engine.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Word-end BPE of a tokenizer file's JSON (``model`` with ``end_of_word_suffix``, ids in merge order)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {self._inner(s, suffix): i for s, i in model["vocab"].items()}
        base = len(vocab) - len(model["merges"])
        self.parts = [(i, i) for i in range(base)]
        self.merged: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[self._inner(a, suffix)], vocab[self._inner(b, suffix)]
            if vocab[self._inner(a + b, suffix)] != base + k:
                raise ValueError("token ids are not in the order of the merges")
            self.parts.append(pair)
            self.merged[pair] = base + k
        self.length = [0] * len(vocab)
        self.shorter = [-1] * len(vocab)
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.length[i] = len(s)
            self.shorter[i] = next((vocab[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in vocab), -1)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.symbols = byte_symbols()
        self.split = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def _inner(token: str, suffix: str) -> str:
        """Token with its word end moved into the last symbol."""
        if token.endswith(suffix) and token != suffix:
            body = token[:-len(suffix)]
            return body[:-1] + chr(ord(body[-1]) + _LAST)
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps ``left`` and ``right`` apart when they stand side by side."""
        merged, parts = self.merged, self.parts
        limit = len(parts)
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def word(self, word: str) -> list[int]:
        """Token ids of one word."""
        symbols = self.symbols
        text = "".join([symbols[b] for b in word.encode()])
        text = text[:-1] + chr(ord(text[-1]) + _LAST)
        n, length = len(text), self.length
        longest = [-1] * (n + 1)
        # Matches end in order, so the last one stored for a start is the longest.
        for end, token in self.automaton.iter(text):
            longest[end - length[token] + 1] = token
        if length[longest[0]] == n:
            return [longest[0]]
        shorter, compatible = self.shorter, self.compatible
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            while True:
                end = at + length[token]
                if open_at[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                else:
                    # No token from here fits: this place is closed, the token before it must end elsewhere.
                    open_at[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        cache = self.cache
        # Lower case is taken code point by code point, without the rule for a final sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for word in self.split.findall(text):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids = self.word(word)
                if len(word) <= 64:
                    cache[word] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; special strings in it become their own ids."""
        out: list[int] = []
        if self.marks is None:
            self._plain(text, out)
            return out
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out


class OffsetTable:
    """Decoder: token i is ``blob[offsets[i]:offsets[i + 1]]``, with a space behind it."""

    def __init__(self, source: str):
        spec = json.loads(source)
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        pieces = [(names[i] + " ").encode() for i in range(len(names))]
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens by the offset table, one space between them."""
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[place[:-1]].tobytes()


def tokenizer_source(path: str, max_bytes: int = 8_000_000) -> bytes:
    """A vocabulary file read once on the driver, to be sent with the job; its size is checked."""
    with open(path, "rb") as file:
        source = file.read(max_bytes + 1)
    if len(source) > max_bytes:
        raise ValueError(f"{path} has more than {max_bytes} bytes")
    return source


def over_texts(df: DataFrame, columns: list[T.StructField], work) -> DataFrame:
    """Apply ``work(batch)``, which returns Arrow arrays for ``columns``, beside the columns of ``df``; those of the same name go."""
    new = {c.name.lower() for c in columns}
    kept = [c for c in df.columns if c.lower() not in new]
    names = [*kept, *[c.name for c in columns]]

    def compute(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *work(batch)], names)

    return df.mapInArrow(compute, T.StructType([*[df.schema[c] for c in kept], *columns]))


def _ids_array(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _texts_array(ids, decoder: OffsetTable) -> pa.Array:
    return pa.array([decoder.decode(x) for x in ids], pa.binary()).cast(pa.string())


def encode(df: DataFrame, text_col: str, path: str, out: str = "token_ids") -> DataFrame:
    """``df`` with an array of token ids.

    Null and empty texts give an empty array. A column named ``out`` is replaced. Rows are independent, so nothing
    is shuffled and a lost executor costs its rows only.
    """
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(path).decode())
    made: list[WordEncoder] = []

    def work(batch):
        if not made:
            made.append(WordEncoder(source.value))
        return [_ids_array([made[0].encode(t.as_py() or "") for t in batch.column(text_col)])]

    return over_texts(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, ids_col: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the text of an array of token ids; null arrays give the empty text. ``out`` is replaced."""
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(path).decode())
    made: list[OffsetTable] = []

    def work(batch):
        if not made:
            made.append(OffsetTable(source.value))
        values = (row.values for row in batch.column(ids_col))
        return [_texts_array((np.empty(0, np.int32) if v is None else v.to_numpy() for v in values), made[0])]

    return over_texts(df, [T.StructField(out, T.StringType())], work)


def round_trip(df: DataFrame, text_col: str, path: str, ids_out: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ids of each text and the text that they decode to, in one pass; as :func:`encode` and :func:`decode`."""
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(path).decode())
    made: list[tuple[WordEncoder, OffsetTable]] = []

    def work(batch):
        if not made:
            made.append((WordEncoder(source.value), OffsetTable(source.value)))
        encoder, decoder = made[0]
        ids = [encoder.encode(t.as_py() or "") for t in batch.column(text_col)]
        return [_ids_array(ids), _texts_array((np.array(x, dtype=np.int32) for x in ids), decoder)]

    return over_texts(df, [T.StructField(ids_out, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())], work)


def op7(spark, sf_dir: str) -> DataFrame:
    """``op7_backtracking_bpe``: number and digests of token ids and of the decoded text, per document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, "text", path).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
