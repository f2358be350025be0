"""Product codes of vectors by Lloyd rounds over cover trees.

Vectors become integers and are cut into parts, and every part position has its own codebook. Each partition's vectors
are indexed once, in blocks: per part position a cover tree, whose nodes hold a centre, a radius and a range of the rows in
tree order, so that the cumulative sums over that order give the sum of any subtree. A round walks down from the roots
with all codebook entries as candidates. By the triangle inequality an entry farther from the centre than the nearest
one plus twice the radius is nearest to no row below. A node left with one candidate is assigned as a whole; the others
hand their candidates to their children, and only rows of ambiguous leaves are compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.llm.tables import table
from duowave.plans.scratch import Scratch
from duowave.plans.skew import broadcast_if_small

# Steps per unit, parts of a vector, entries of a codebook and rounds that move them.
STEPS = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Vectors to a block of trees, and rows below which a node is not divided.
BLOCK_VECTORS = 32_768
LEAF_ROWS = 16

NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("centre", "<i4"), ("first", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def finite(vector: Column) -> Column:
    """Not null, and all components known and finite."""
    def known(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, known), F.lit(False))


def whole_steps(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x), held within the range in which a squared distance of whole vectors fits into 63 bits."""
    limit = float(1 << ((62 - int(vectors.shape[1]).bit_length()) // 2 - 1))
    return np.clip(np.floor(np.clip(vectors, -limit, limit) * STEPS), -limit, limit).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


class CoverTree:
    """Cover tree over the rows of ``points``.

    Children of a node stand more than its covering distance (a power of two below the node's radius) apart and cover
    all of its rows within that distance; the first child keeps the node's centre.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.points, self.order, self.nodes = points, order, nodes
        self.sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points, axis=0, out=self.sums[1:])

    @classmethod
    def build(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> CoverTree:
        order = np.arange(len(points))
        # Per node: range in the order, centre (a row), then first child, children and radius.
        made: list[list] = [[0, len(points), 0, 0, 0, 0.0]]
        at = 0
        while at < len(made):
            start, stop, centre = made[at][:3]
            rows = order[start:stop]
            gap = squared(points[rows], points[centre])
            farthest = float(gap.max())
            made[at][5] = farthest ** 0.5 * (1 + 1e-12)
            if farthest > 0 and stop - start > leaf_rows:
                cover = 4.0 ** (np.ceil(np.log2(farthest) / 2) - 1)
                made[at][3] = len(made)
                groups = []
                while True:
                    near = gap <= cover
                    groups.append(rows[near])
                    made.append([start, start + len(groups[-1]), centre, 0, 0, 0.0])
                    start += len(groups[-1])
                    rows = rows[~near]
                    if not len(rows):
                        break
                    centre = int(rows[0])
                    gap = squared(points[rows], points[centre])
                order[made[at][0]:stop] = np.concatenate(groups)
                made[at][4] = len(made) - made[at][3]
            at += 1
        nodes = np.array([tuple(m) for m in made], dtype=NODE)
        place = np.empty(len(points), dtype=np.int32)
        place[order] = np.arange(len(points), dtype=np.int32)
        nodes["centre"] = place[nodes["centre"]]
        return cls(points[order], order.astype(np.int32), nodes)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ranges of the tree order (starts, stops) with the index of the nearest entry, and the distances computed.

        Ties go to the smaller index.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        compared = 0
        node = np.zeros(len(entries), dtype=np.int64)
        entry = np.arange(len(entries))
        while len(node):
            compared += len(node)
            groups, first, count = _groups(node)
            here = self.nodes[groups]
            gap = squared(self.points[self.nodes["centre"][node]], entries[entry])
            best = np.minimum.reduceat(gap, first)
            # With a little room for rounding: an entry is dropped only if it is farther for certain.
            reach = (np.sqrt(best.astype(float)) + 2 * here["radius"]) * (1 + 1e-9)
            # Without a radius all rows are the centre, and the exact comparison settles them.
            keep = np.where(np.repeat(here["radius"], count) > 0, np.sqrt(gap.astype(float)) <= np.repeat(reach, count),
                            gap == np.repeat(best, count))
            kept = np.add.reduceat(keep.astype(np.int64), first)
            node, entry = node[keep], entry[keep]
            first = np.concatenate([[0], np.cumsum(kept)[:-1]])
            settled = (kept == 1) | (here["radius"] == 0)
            done.append((here["start"][settled], here["stop"][settled], entry[first[settled]]))
            leaf = ~settled & (here["children"] == 0)
            for part in (leaf, ~settled & ~leaf):
                if not part.any():
                    if part is not leaf:
                        node = node[:0]
                    continue
                low = here["start"] if part is leaf else here["first"]
                width = here["stop"] - here["start"] if part is leaf else here["children"]
                below, candidate = _spread(low[part], width[part], first[part], kept[part], entry)
                if part is leaf:
                    compared += len(below)
                    rows, start, _ = _groups(below)
                    gap = squared(self.points[below], entries[candidate])
                    least = np.minimum.reduceat(gap, start)
                    # Candidates ascend within a row, so its first least one is the smallest.
                    hits = np.flatnonzero(gap == np.repeat(least, np.diff(np.append(start, len(gap)))))
                    chosen = hits[np.searchsorted(hits, start)]
                    done.append((rows, rows + 1, candidate[chosen]))
                else:
                    node, entry = below, candidate
        starts, stops, codes = (np.concatenate(x) for x in zip(*done))
        return starts, stops, codes, compared

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """Index of the nearest entry per row, in the order the rows were given in."""
        starts, stops, codes, _ = self.assign(entries)
        by_place = np.argsort(starts)
        out = np.empty(len(self.points), dtype=np.int64)
        out[self.order] = np.repeat(codes[by_place], (stops - starts)[by_place])
        return out

    def moments(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their sum per entry."""
        starts, stops, codes, _ = self.assign(entries)
        counts = np.zeros(len(entries), dtype=np.int64)
        sums = np.zeros(entries.shape, dtype=np.int64)
        np.add.at(counts, codes, stops - starts)
        np.add.at(sums, codes, self.sums[stops] - self.sums[starts])
        return counts, sums


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each begins, and how often it comes."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[first], first, np.diff(np.append(first, len(sorted_keys)))


def _spread(low: np.ndarray, width: np.ndarray, first: np.ndarray, kept: np.ndarray, entry: np.ndarray):
    """Every number from ``low`` on (``width`` of them) with every candidate of its group; sorted by both."""
    per_group = width.astype(np.int64) * kept
    group = np.repeat(np.arange(len(low)), per_group)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(per_group) - per_group, per_group)
    return low[group].astype(np.int64) + inside // kept[group], entry[first[group] + inside % kept[group]]


def _tree_bytes(tree: CoverTree) -> dict[str, bytes]:
    return {"points": tree.points.astype("<i4").tobytes(), "place": tree.order.astype("<i4").tobytes(), "nodes": tree.nodes.tobytes()}


def _tree_of(stored: dict[str, bytes], width: int) -> CoverTree:
    points = np.frombuffer(stored["points"], dtype="<i4").reshape(-1, width).astype(np.int64)
    return CoverTree(points, np.frombuffer(stored["place"], dtype="<i4"), np.frombuffer(stored["nodes"], dtype=NODE))


def _blocks(batches, dim: int, size: int):
    """Member structs and integer vectors, up to ``size`` rows at a time."""
    rows, vectors, held = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            if held and held + part.num_rows > size:
                yield pa.concat_arrays(rows), np.concatenate(vectors)
                rows, vectors, held = [], [], 0
            rows.append(part.column("member"))
            vectors.append(whole_steps(part.column("v").flatten().to_numpy().reshape(-1, dim)))
            held += part.num_rows
    if held:
        yield pa.concat_arrays(rows), np.concatenate(vectors)


def tree_blocks(rows: DataFrame, dim: int, parts: int, scratch: Scratch, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Written blocks of ``rows`` (``member`` struct, ``v``): the structs, and one stored tree per part position."""
    width = dim // parts
    stored = pa.struct([("points", pa.binary()), ("place", pa.binary()), ("nodes", pa.binary())])

    def build(batches):
        for structs, vectors in _blocks(batches, dim, block_vectors):
            trees = [_tree_bytes(CoverTree.build(vectors[:, p * width:(p + 1) * width])) for p in range(parts)]
            members = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([members, pa.array([trees], pa.list_(stored))], ["members", "trees"])

    struct = rows.schema["member"].dataType.simpleString()
    blocks = rows.mapInArrow(build, f"members array<{struct}>, trees array<struct<points:binary,place:binary,nodes:binary>>")
    # A row is a block of some megabytes: small row groups, so that a reader holds few of them.
    target = f"{scratch.path}/blocks"
    blocks.write.option("parquet.block.size", 16_000_000).option("parquet.block.size.row.check.min", 2).option(
        "parquet.block.size.row.check.max", 4).parquet(target)
    return rows.sparkSession.read.schema(blocks.schema).parquet(target)


def tree_codes(df: DataFrame, id_col: str, vector_col: str, carry: Sequence[str] = (), parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS, block_vectors: int = BLOCK_VECTORS) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``row`` (struct of ``carry``), ``code`` (array of parts) and ``error`` of every vector; and the codebooks.

    The codebooks, of shape parts, entries and width, begin with the vectors of smallest id. Each round assigns all parts
    to their nearest entries and moves every entry that has any to the floored mean of its parts; at the end parts are
    assigned again. ``error`` is the sum of squared distances in steps.

    Vectors that are null or hold null or non-finite components are left out, as are those of another length than the
    most common one that the parts divide (the longer of two). Null ids are coded but begin no codebook unless ids are
    too few; equal ids are ordered by their vectors. Repeated rows are coded each. Fewer vectors than entries give as
    many entries. Components beyond the range of exact distances (half a million at 64 dimensions) count as its ends.
    Empty tables give no rows and empty codebooks.

    Per round a block hands on one sum per entry and component; the codebooks are all that reaches the driver.
    """
    spark = df.sparkSession
    carried = [F.struct(*[df[c] for c in carry]).alias("row")] if carry else []
    member = F.struct(df[id_col].cast("long").alias("id"), *carried)
    rows = df.select(member.alias("member"), df[vector_col].cast("array<double>").alias("v")).where(finite(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    shape = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = shape["dim"] if shape else parts
    width = dim // parts
    rows = rows.where(F.size("v") == dim)
    first = rows.orderBy(F.col("member.id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = whole_steps(np.array([r["v"] for r in first], dtype=float).reshape(len(first), dim))
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2))

    scratch = Scratch(spark, "codes")
    blocks = tree_blocks(rows, dim, parts, scratch, block_vectors)
    for _ in range(rounds):
        books = _moved(blocks, books)
    coded = _assigned(blocks, books, rows.schema["member"].dataType.simpleString())
    return coded.select("member.*", "code", "error"), books


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round."""
    def partial(batches):
        for batch in batches:
            for trees in batch.column("trees"):
                made = [_tree_of(t, books.shape[2]).moments(b) for t, b in zip(trees.as_py(), books)]
                counts, sums = (np.stack(x) for x in zip(*made))
                cells = np.flatnonzero(np.repeat(counts.ravel() > 0, books.shape[2]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cells), pa.array(counts.ravel()[cells // books.shape[2]]), pa.array(sums.ravel()[cells])], ["cell", "n", "s"])

    summed = blocks.select("trees").mapInArrow(partial, "cell long, n long, s long").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    moved = books.copy().ravel()
    cells = summed["cell"].to_numpy()
    moved[cells] = summed["s"].to_numpy() // summed["n"].to_numpy()
    return moved.reshape(books.shape)


def _assigned(blocks: DataFrame, books: np.ndarray, struct: str) -> DataFrame:
    """Codes and errors of all rows."""
    def code(batches):
        for batch in batches:
            for members, trees in zip(batch.column("members"), batch.column("trees")):
                codes, error = [], 0
                for stored, book in zip(trees.as_py(), books):
                    tree = _tree_of(stored, books.shape[2])
                    codes.append(tree.codes(book))
                    points = np.empty_like(tree.points)
                    points[tree.order] = tree.points
                    error = error + squared(points, book[codes[-1]])
                codes = np.stack(codes, axis=1)
                offsets = np.arange(len(codes) + 1, dtype=np.int32) * len(books)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([members.values, lists, pa.array(error)], ["member", "code", "error"])

    return blocks.mapInArrow(code, f"member {struct}, code array<int>, error long")


def op11(spark, sf_dir: str) -> DataFrame:
    """``op11_cover_tree_codes``: codes and errors of all embeddings, errors by label, and a digest of the codebooks."""
    coded, books = tree_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    coded = Scratch(spark, "coded").write(coded.select("id", "row.label", "code", "error"), "rows")
    sums = Scratch(spark, "coded").write(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    sums = sums.withColumnRenamed("label", "l")
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error",
        F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Codebook ``book{i + 1}`` from ``book{i}``."""
    comps = "abcd"
    means = ", ".join(f"CASE WHEN n > 0 THEN CAST(floor(s.{c} / n) AS BIGINT) ELSE b.{c} END AS {c}" for c in comps)
    sums = ", ".join(f"CAST(sum(p.{c}) AS BIGINT) AS {c}" for c in comps)
    return f"""{_nearest_sql(i)},
book{i + 1} AS (
  SELECT b.p, b.e, {means} FROM book{i} b LEFT JOIN (
    SELECT p, e, count(*) AS n, {sums} FROM near{i} p GROUP BY p, e) s ON b.p = s.p AND b.e = s.e)"""


def _nearest_sql(i: int) -> str:
    gap = " + ".join(f"(p.{c} - b.{c}) * (p.{c} - b.{c})" for c in "abcd")
    return f"""near{i} AS (
  SELECT rid, p, a, b, c, d, best % {ENTRIES} AS e, best // {ENTRIES} AS gap FROM (
    SELECT rid, p.p, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.c) AS c, any_value(p.d) AS d,
           min(({gap}) * {ENTRIES} + b.e) AS best
    FROM cut p JOIN book{i} b ON p.p = b.p GROUP BY rid, p.p))"""


# Parts are four components wide, as those of 64 dimensions are.
OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {STEPS}) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT rid, CAST(i AS INT) AS p, v[4 * i + 1] AS a, v[4 * i + 2] AS b, v[4 * i + 3] AS c, v[4 * i + 4] AS d
  FROM kept, range({PARTS}) parts(i)),
book0 AS (SELECT p, rid AS e, a, b, c, d FROM cut WHERE rid < {ENTRIES}),
{_round_sql(0)},
{_round_sql(1)},
{_nearest_sql(2)},
coded AS (
  SELECT rid, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error FROM near2 GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) CROSS JOIN digest
"""
