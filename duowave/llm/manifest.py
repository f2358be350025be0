"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are the leaves of one tree per source, whose roots are the leaves of one more tree. Nodes of a level are rows with a
place within their tree. Every level is joined with itself on computed places of siblings: place XOR 1 in binary trees,
the other slots of the same run otherwise. Rows in slot zero, which then hold their whole run, emit the parents. All
trees climb together, and their levels are written tables; going down again, every row gets its path, that is what stands
before and after it in its run on each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duowave.llm.tables import table
from duowave.plans.scratch import Scratch
from duowave.plans.skew import BUCKET_ROWS, broadcast_if_small, range_buckets

# Children of a node, and the fields of a document's leaf.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NO_BYTES = bytearray()


def canonical(fields: Sequence[Column]) -> Column:
    """Text that tells any two rows apart: per field ``-`` for null, else its length in bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    """SHA-256 of a text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    """Lowercase hex digits of bytes; those of a run of digests are their hex texts one after another."""
    return F.lower(F.hex(value))


def numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch, name: str,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``place`` (from 0, within ``tree``, by ``order``) and ``size`` (rows of the tree) to a written table.

    Rows are dealt by ranges of tree and order, so a tree of any size spreads over many tasks; the places of a range are
    shifted by the rows of the ranges before. Equal rows may span ranges.
    """
    spark = rows.sparkSession
    total, wanted = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_bucket = max(1, min(bucket_rows, -(-total // wanted)))
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    cut = range_buckets(spread, ["tree", *order, "_row"], total, scratch, f"{name}_ranges", per_bucket)
    earlier = Window.partitionBy("tree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per tree and range: no more than trees and ranges together.
    shifts = scratch.write(cut.groupBy("tree", "bucket").count().select(
        F.col("tree").alias("t"), F.col("bucket").alias("b"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"),
        F.sum("count").over(Window.partitionBy("tree")).alias("size")), f"{name}_shifts")
    inside = F.row_number().over(Window.partitionBy("tree", "bucket").orderBy(*order, "_row")) - 1
    placed = cut.withColumn("at", inside)
    placed = placed.join(broadcast_if_small(shifts), (placed["tree"] == F.col("t")) & (placed["bucket"] == F.col("b")))
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).cast("long").alias("place"), "size")


def sibling(place: Column, k: int, fanout: int) -> Column:
    """Place of the ``k``-th other slot of the run, counted on from the own slot and round."""
    if fanout == 2:
        return place.bitwiseXOR(F.lit(1).cast("long"))
    slot = place % fanout
    return place - slot + (slot + k) % fanout


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Add ``before`` and ``after``: digests of the run's nodes on the left and on the right, one after another."""
    joined, kept = nodes, nodes.columns
    for k in range(1, fanout):
        other = nodes.select(F.col("tree").alias(f"t{k}"), F.col("place").alias(f"p{k}"), F.col("node").alias(f"n{k}"))
        joined = joined.join(other, (F.col("tree") == F.col(f"t{k}"))
                             & (sibling(F.col("place"), k, fanout) == F.col(f"p{k}")), "left")
    slot = F.col("place") % fanout

    def beside(left: bool) -> Column:
        # Slots that come round to the start of the run stand before the own one.
        here = [F.when((slot + k >= fanout) == F.lit(left), F.col(f"n{k}")) for k in range(1, fanout)]
        return F.concat(*[F.coalesce(n, F.lit(NO_BYTES)) for n in here])

    return joined.select(*kept, beside(True).alias("before"), beside(False).alias("after"))


def climb(leaves: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """Written levels of all trees, from ``tree``, ``place``, ``size``, ``node`` (and more) of the leaves.

    ``size`` is the number of nodes of the tree on the level; the level on which it is 1 holds the tree's root.
    """
    levels = [scratch.write(with_siblings(leaves, fanout), f"{name}_0")]
    largest = levels[0].agg(F.max("size")).first()[0] or 1
    while largest > 1:
        first = levels[-1].where((F.col("size") > 1) & (F.col("place") % fanout == 0))
        parents = first.select(
            "tree", F.expr(f"place div {fanout}").alias("place"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
            digest(hexed(F.concat("node", "after"))).alias("node"))
        levels.append(scratch.write(with_siblings(parents, fanout), f"{name}_{len(levels)}"))
        largest = -(-largest // fanout)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """``tree`` and ``node`` of the root of every tree."""
    out = None
    for level in levels:
        top = level.where("size = 1").select("tree", "node")
        out = top if out is None else out.unionByName(top)
    return out


def paths(levels: Sequence[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """The lowest level with ``path``: ``before`` and ``after`` per level, from the bottom up, for levels with a run."""
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    upper = None
    for level in reversed(levels):
        here = level.drop("before", "after")
        if upper is None:
            upper = level.select(*here.columns, none.alias("path"))
            continue
        above = upper.select(F.col("tree").alias("t"), F.col("place").alias("p"), F.col("path").alias("upper"))
        parent = F.when(F.col("size") > 1, F.expr(f"place div {fanout}"))
        step = F.concat(F.array(F.struct("before", "after")), F.col("upper"))
        upper = level.join(above, (F.col("tree") == F.col("t")) & (parent == F.col("p")), "left").select(
            *here.columns, F.coalesce(step, none).alias("path"))
    return upper


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(hexed(s["before"]), hexed(node), hexed(s["after"]))))


def path_digest(path: Column) -> Column:
    """SHA-256, as hex text, of all siblings of a path in order."""
    siblings = F.aggregate(path, F.lit(NO_BYTES), lambda made, s: F.concat(made, s["before"], s["after"]))
    return F.sha2(hexed(siblings), 256)


def manifest(df: DataFrame, id_col: str, source_col: str, fields: Sequence[str], fanout: int = FANOUT,
             changed: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id``, ``source``, ``leaf``, ``subroot``, ``root``, ``path`` and ``other_leaf`` per row; digests are bytes.

    A leaf is the digest of the canonical text of ``fields``. ``other_leaf`` is that of the row with the columns in
    ``changed`` put in their place, which ``fold`` checks against the path.

    Within a source rows stand by id, nulls first, then by leaf; repeated rows are leaves each. The null source is one
    tree, and the first. A tree of one row has that leaf as its root. Null fields differ from empty ones. Columns other
    than ``fields`` are not read. Empty tables give no rows. ``fanout`` is 2 or more.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    scratch = Scratch(df.sparkSession, "manifest")
    changed = changed or {}
    leaf = digest(canonical([df[f] for f in fields]))
    other = digest(canonical([changed.get(f, df[f]) for f in fields])) if changed else leaf
    # '-' sorts before '=', so trees sort by source with the null source first.
    tree = F.coalesce(F.concat(F.lit("="), df[source_col].cast("string")), F.lit("-"))
    rows = scratch.write(df.select(tree.alias("tree"), df[id_col].alias("id"), leaf.alias("node"), other.alias("other_leaf")), "rows")
    leaves = numbered(rows, ["id", "node"], scratch, "leaves", bucket_rows)
    levels = climb(leaves, scratch, "level", fanout)

    tops = scratch.write(roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), "subroots")
    upper = climb(numbered(tops, ["of"], scratch, "tops", bucket_rows), scratch, "upper", fanout)
    # One row in all.
    root = upper[-1].select(F.col("node").alias("root"))
    per_source = scratch.write(paths(upper, fanout).select(
        "of", F.col("node").alias("subroot"), F.col("path").alias("source_path")).join(F.broadcast(root)), "sources")

    source = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)"))
    return paths(levels, fanout).join(broadcast_if_small(per_source), F.col("tree") == F.col("of")).select(
        "id", source.alias("source"), F.col("node").alias("leaf"), "subroot", "root",
        F.concat("path", "source_path").alias("path"), "other_leaf")


def op12(spark, sf_dir: str) -> DataFrame:
    """``op12_merkle_manifest``: leaves, roots and proofs of all documents, and which tampered ones the root detects."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    text = F.when(tampered, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    made = manifest(docs, "doc_id", "source", FIELDS, changed={"text": text})
    folded = made.withColumn("folded", fold(F.col("other_leaf"), F.col("path")))
    return folded.select(
        F.col("id").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"), hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def _field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _up_sql(name: str, start: str, fanout: int = FANOUT) -> str:
    """Recursive table of all nodes of trees: tree, lvl, idx, digest."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, lvl + 1, idx // {fanout}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {name}) WHERE size > 1 GROUP BY tree, lvl, idx // {fanout})"""


# Bits of the crc32 of the decimal id, lowest first, taken in one by one.
_CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_transform(range(8), lambda b: CAST((ord(c) >> b) & 1 AS BIGINT))))),
    lambda c, b: xor(c >> 1, ((xor(c, b) & 1) * 3988292384))))"""

OP12_SQL = f"""
WITH RECURSIVE base AS (
  SELECT coalesce('=' || source, '-') AS tree, doc_id,
         sha256({" || ".join(_field_sql(f) for f in FIELDS)}) AS leaf,
         CASE WHEN {_CRC_SQL} % 2 = 0
              THEN sha256({" || ".join(_field_sql(f if f != "text" else "replace(text, chr(10), '')") for f in FIELDS)}) END AS changed
  FROM documents),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) AS BIGINT) - 1 AS idx,
         row_number() OVER () AS rid
  FROM base),
{_up_sql("up", "SELECT tree, 0 AS lvl, idx, leaf AS digest FROM placed")},
sizes AS (SELECT tree, max(lvl) AS height FROM up GROUP BY tree),
subroots AS (SELECT u.tree, digest AS subroot FROM up u JOIN sizes s ON u.tree = s.tree AND lvl = height),
tops AS (SELECT '' AS tree, tree AS of, subroot, CAST(row_number() OVER (ORDER BY tree) AS BIGINT) - 1 AS idx FROM subroots),
{_up_sql("top", "SELECT tree, 0 AS lvl, idx, subroot AS digest FROM tops")},
root AS (SELECT max(lvl) AS top_height, arg_max(digest, lvl) AS root FROM top),
steps AS (
  SELECT p.rid, u.lvl, coalesce(string_agg(digest, '' ORDER BY u.idx) FILTER (u.idx < p.idx // CAST(3 ** u.lvl AS BIGINT)), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY u.idx) FILTER (u.idx > p.idx // CAST(3 ** u.lvl AS BIGINT)), '') AS after
  FROM placed p JOIN sizes s ON p.tree = s.tree
  JOIN up u ON u.tree = p.tree AND u.lvl < s.height AND u.idx // 3 = p.idx // CAST(3 ** (u.lvl + 1) AS BIGINT)
  GROUP BY p.rid, u.lvl
  UNION ALL
  SELECT p.rid, s.height + u.lvl,
         coalesce(string_agg(digest, '' ORDER BY u.idx) FILTER (u.idx < t.idx // CAST(3 ** u.lvl AS BIGINT)), ''),
         coalesce(string_agg(digest, '' ORDER BY u.idx) FILTER (u.idx > t.idx // CAST(3 ** u.lvl AS BIGINT)), '')
  FROM placed p JOIN sizes s ON p.tree = s.tree JOIN tops t ON t.of = p.tree CROSS JOIN root
  JOIN top u ON u.lvl < top_height AND u.idx // 3 = t.idx // CAST(3 ** (u.lvl + 1) AS BIGINT)
  GROUP BY p.rid, s.height, u.lvl),
folds AS (
  SELECT rid, 0 AS lvl, coalesce(changed, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.lvl + 1, sha256(before || digest || after) FROM folds f JOIN steps s ON f.rid = s.rid AND f.lvl = s.lvl),
folded AS (SELECT rid, arg_max(digest, lvl) AS folded_root FROM folds GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM steps GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree CROSS JOIN root JOIN folded f ON f.rid = p.rid LEFT JOIN proofs r ON r.rid = p.rid
"""
