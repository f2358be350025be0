"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size gives the whole copies that every document gets for certain. What is left of the target is
a sample without replacement. In it a document is included with probability p, in proportion to the power of two at or
below its size, such that the words expected are those wanted. Documents whose p reaches 1 are certain. The others are
ranked by their random odds over their inclusion odds, u / (1 - u) : p / (1 - p), and the sample is the first of them. Its
size is fixed in words: it ends where the words are nearest to those wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duowave.llm.tables import WORD, table
from duowave.plans.scratch import Scratch
from duowave.plans.skew import broadcast_if_small

# Weights by order of source, share of all sizes, cap on repeats and seed of the draw.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_COPIES = 2
SEED = 20250901
# The odds are cut at this number of bins per round to find where a source's sample ends.
BINS = 4096
UNIFORM_BITS = 52


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, id_col: Column, key: Column) -> Column:
    """Hex digits of an MD5 of seed, id and ``key``; null ids and keys count as empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (id_col, key)]
    return F.md5(F.concat(F.lit(f"{seed}:"), text[0], F.lit(":"), text[1]))


def rank(draw_col: Column, p: Column) -> Column:
    """Whole number below 2 ** 52 that grows with the random odds over the inclusion odds, r as r / (1 + r)."""
    scale = float(1 << UNIFORM_BITS)
    u = (F.conv(F.substring(draw_col, 1, UNIFORM_BITS // 4), 16, 10).cast("long").cast("double") + 0.5) / scale
    out, kept = u * (1 - p), (1 - u) * p
    return F.least(F.floor(out / (out + kept) * scale), F.lit((1 << UNIFORM_BITS) - 1)).cast("long")


def size_class(size: Column) -> Column:
    """Largest power of two up to ``size``; 1 for 0."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(size, F.lit(1)))) - 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` of rows with ``source`` and ``size``.

    Sources in code-point order, null last, get the weights in turn. Targets are the shares of ``share_percent`` of
    all words; what would exceed ``max_copies`` times a source's size is shared again by weight. That ends with one
    level: sources in order of size over weight are full up to some place, and the others share the rest. One row
    per source, so the windows over all sources hold few rows.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("source_size") / F.col("weight")), "weight", F.col("source").asc_nulls_last())
    earlier, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = sums.withColumn("weight", weight).withColumns({
        "total": F.sum("source_size").over(everything),
        "full_before": F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * max_copies,
        "weight_left": F.sum("weight").over(onward),
    })
    # Level if this source and all after it are open, in words per weight.
    level = (F.col("total") * share_percent / F.lit(100.0) - F.col("full_before")) / F.col("weight_left")
    judged = ranked.withColumn("level", level).withColumn(
        "full", F.col("source_size") * max_copies <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("full"), F.struct(-F.col("place"), F.col("level"))))
    placed = judged.withColumn("place", F.row_number().over(order)).withColumn("at", open_level.over(everything)["level"])
    target = F.when(F.col("full"), (F.col("source_size") * max_copies).cast("double")).otherwise(
        F.col("at") * F.col("weight"))
    return placed.select("source", "source_size", target.alias("target"))


def inclusion(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``source``, ``class``, ``words`` and ``p`` of each class of sizes, from rows with ``size`` and goals with ``left``.

    p is c times the class, at most 1, and c is such that the words expected are ``left``: the largest classes are
    certain up to the first for which c, made of what then is left, keeps p below 1. At most 63 rows per source.
    """
    classes = sizes.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    larger, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    c = (F.col("left") - F.coalesce(F.sum("words").over(larger), F.lit(0))) / F.nullif(F.sum(
        F.col("class").cast("double") * F.col("words")).over(onward), F.lit(0.0))
    tried = _by_source(classes, goals.select("source", "left")).withColumn("c", c)
    first = F.max(F.when(F.col("c") * F.col("class") < 1, F.struct("class", "c"))).over(Window.partitionBy("source"))
    found = tried.withColumn("first", first)
    # A source without words expects none, whatever p is.
    return found.select("source", "class", "words", F.when(F.col("class") <= F.col("first.class"), F.greatest(
        F.col("first.c") * F.col("class"), F.lit(0.0))).otherwise(1.0).alias("p"))


def mix_limits(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT,
               max_copies: int = MAX_COPIES, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Where each source's sample ends, from a written table of ``source``, ``size`` and ``draw``.

    Returns one row per source (size, target, certain copies ``whole``, words ``left`` for the sample, and its end: rank,
    draw, how many of the equal rows there are and how many are taken) and the inclusion probabilities. The end is found
    by two rounds of binned sums over the ranks, then by a window over the rows of one bin of a bin, equal rows counted
    beforehand; no source is sorted as a whole.
    """
    scratch = Scratch(sizes.sparkSession, "mix")
    targets = scratch.write(source_targets(sizes, weights, share_percent, max_copies), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = targets.withColumn("whole", whole.cast("long")).withColumn(
        "left", F.when(F.col("whole") < max_copies, F.greatest(
            F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).otherwise(0.0))
    odds = scratch.write(inclusion(sizes, goals), "odds")
    certain = odds.groupBy("source").agg(F.sum(F.when(F.col("p") >= 1, F.col("words")).otherwise(0)).alias("certain"))
    ranked = _ranked(sizes, odds).where("p < 1")

    # Words before, and range of ranks that still holds, the end of each source's sample.
    state = _by_source(goals.select("source", "left"), certain).select(
        "source", "left", F.col("certain").alias("before"), F.lit(0).cast("long").alias("low"))
    width = 1 << UNIFORM_BITS
    for turn in range(2):
        step = -(-width // bins)
        binned = (
            _by_source(ranked, state).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + width))
            .groupBy("source", "low", "before", "left", F.expr(f"(v - low) div {step}").alias("bin"))
            .agg(F.sum("size").alias("words"))
        )
        # At most `bins` rows per source.
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        ends = binned.withColumn("upto", F.col("before") + running).where(F.col("upto") >= F.col("left"))
        crossed = ends.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        # Without a crossing bin all rows are in.
        nxt = state.join(crossed, state["source"].eqNullSafe(crossed["source"]), "left").select(
            state["source"], "left", F.coalesce("at.before", "before").alias("before"),
            (F.col("low") + F.coalesce(F.col("at.bin") * step, F.lit(width))).alias("low"))
        state = scratch.write(nxt, f"state_{turn}")
        width = step
    inside = _by_source(ranked, state).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + width)).groupBy(
        "source", "v", "draw", "size", "before", "left").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum(F.col("size") * F.col("n")).over(
        Window.partitionBy("source").orderBy("v", "draw").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("upto", upto).where(F.col("upto") >= F.col("left"))
    # Of equal rows at the end as many are taken as bring the words nearest to what is wanted.
    wanted = F.floor((F.col("left") - (F.col("upto") - F.col("size") * F.col("n"))) / F.nullif(F.col("size"), F.lit(0)) + 0.5)
    end = reached.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.min(F.struct(
        F.col("v").alias("end_v"), F.col("draw").alias("end_draw"), F.col("n").alias("end_n"), wanted.alias("end_k"))).alias("e"))
    limits = goals.join(end, F.col("source").eqNullSafe(F.col("s")), "left").select(*goals.columns, "e.*")
    # A sample that nothing ends holds all.
    return scratch.write(limits.fillna({"end_v": 1 << UNIFORM_BITS, "end_draw": "", "end_n": 1, "end_k": 1}), "limits"), odds


def apply_mix(rows: DataFrame, limits: DataFrame, odds: DataFrame) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with ``source``, ``size`` and ``draw``.

    Rows before the end of their source's sample are in it. Of equal rows at the end some may be in it and some not:
    these are written and numbered by the parts they were written in, so that a hot row spreads over tasks.
    """
    full = _ranked(_by_source(rows, limits), odds)
    here, end = F.struct("v", "draw"), F.struct("end_v", "end_draw")
    extra = F.when(F.col("left") <= 0, 0).when((F.col("p") >= 1) | (here < end), 1).when(here == end, F.col("end_k") / F.col("end_n")).otherwise(0)
    full = full.withColumn("extra", extra.cast("double"))
    out = [*rows.columns, "source_size", "target"]
    settled = full.where("extra IN (0, 1)").select(*out, (F.col("whole") + F.col("extra")).cast("long").alias("copies"))
    if limits.where("left > 0 AND end_k > 0 AND end_k < end_n").isEmpty():
        return settled
    scratch = Scratch(rows.sparkSession, "ends")
    split = full.where("extra > 0 AND extra < 1").select(*out, "whole", "end_k")
    split = scratch.write(split.withColumn("_at", F.monotonically_increasing_id()), "rows")
    # Rows of one part are numbered together, after those of the parts before: one row per source and part.
    part = F.shiftright("_at", 33)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = scratch.write(split.groupBy("source", part.alias("part")).count().select(
        F.col("source").alias("s"), F.col("part").alias("q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")), "shifts")
    at = F.row_number().over(Window.partitionBy("source", "part").orderBy("_at"))
    placed = split.withColumn("part", part).withColumn("at", at)
    placed = placed.join(shifts, placed["source"].eqNullSafe(shifts["s"]) & (placed["part"] == shifts["q"]))
    chosen = (F.col("at") + F.col("shift") <= F.col("end_k")).cast("long")
    return settled.unionByName(placed.select(*out, (F.col("whole") + chosen).cast("long").alias("copies")))


def mix_rows(df: DataFrame, id_col: str, source_col: str, size: Column, key: Column, seed: int = SEED, **others: Column) -> DataFrame:
    """``source``, ``size``, ``draw`` and other columns of ``df`` under names that cannot clash."""
    return df.select(df[source_col].cast("string").alias("source"), size.cast("long").alias("size"),
                     draw(seed, df[id_col], key).alias("draw"), *[c.alias(n) for n, c in others.items()])


def pareto_mix(df: DataFrame, id_col: str, source_col: str, size: Column, key: Column, weights: Sequence[int] = WEIGHTS,
               share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES, seed: int = SEED,
               bins: int = BINS) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` per row.

    Per source every document is taken floor(target / source_size) times, and a Pareto sample of the documents once more.
    ``key`` tells rows of one id apart, as a digest of the text does; rows equal in id and key must be of one size.

    Null texts have size 0. Null sources are one source, null ids one id. Rows equal in source, id and key are
    drawn together; where the sample ends among them, only as many are taken as are wanted. Empty tables give no rows.
    Other columns are not read.
    """
    sizes = Scratch(df.sparkSession, "sizes").write(
        mix_rows(df, id_col, source_col, size, key, seed, id=df[id_col].cast("long")), "rows")
    return apply_mix(sizes, *mix_limits(sizes, weights, share_percent, max_copies, bins)).select(
        "id", "source", "size", "source_size", "target", "copies")


def repeat_by_mix(df: DataFrame, id_col: str, source_col: str, size: Column, key: Column, **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; the limits are small, so no row is shuffled.

    Nulls, repeated rows and empty tables as in :func:`pareto_mix`; all columns stay as they are.
    """
    sizes = Scratch(df.sparkSession, "sizes").write(mix_rows(df, id_col, source_col, size, key), "rows")
    rows = mix_rows(df, id_col, source_col, size, key, row=F.struct(*[df[c] for c in df.columns]))
    taken = apply_mix(rows, *mix_limits(sizes, **options)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def _ranked(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """Rows with the ``p`` of their source and class, and their rank ``v``."""
    right = odds.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "p")
    same = rows["source"].eqNullSafe(right["_source"]) & (size_class(rows["size"]) == right["_class"])
    return rows.join(broadcast_if_small(right), same).drop("_source", "_class").withColumn("v", rank(F.col("draw"), F.col("p")))


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source. Spark broadcasts the few sources or splits skewed ones."""
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def op9(spark, sf_dir: str) -> DataFrame:
    """``op9_pareto_mix``: words each document gives to the mix."""
    docs = table(spark, sf_dir, "documents")
    mixed = pareto_mix(docs, "doc_id", "source", word_count(docs["text"]), F.md5("text"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


# Targets by resharing in rounds, the sample by running sums over the whole order.
OP9_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, size, CAST(1 AS BIGINT) << (length(bin(greatest(size, 1))) - 1) AS class, draw, row_number() OVER () AS rid,
         (CAST(CAST('0x' || substr(draw, 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
               md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS draw
        FROM documents)),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
shared AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS sources, false AS is_full, 0 AS round
  FROM sums
  UNION ALL
  SELECT source, source_size, weight, total, sources, coalesce(is_full OR source_size * 2 <= level * weight, true), round + 1
  FROM (SELECT *, (CAST(total * 150 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(sum(CASE WHEN is_full THEN source_size * 2 ELSE 0 END) OVER () AS BIGINT))
                  / nullif(CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS BIGINT), 0) AS level FROM shared)
  WHERE round <= sources),
leveled AS (
  SELECT *, (CAST(total * 150 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(sum(CASE WHEN is_full THEN source_size * 2 ELSE 0 END) OVER () AS BIGINT))
            / nullif(CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS BIGINT), 0) AS level
  FROM shared WHERE round = sources + 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE) ELSE level * weight END AS target FROM leveled),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
wants AS (
  SELECT *, CASE WHEN whole < 2 THEN greatest(target - whole * source_size, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS wanted FROM goals),
classes AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS words FROM base GROUP BY source, class),
tried AS (
  SELECT c.*, (wanted - CAST(coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
              / nullif(sum(CAST(class AS DOUBLE) * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
  FROM classes c JOIN wants w ON c.source IS NOT DISTINCT FROM w.source WINDOW o AS (PARTITION BY c.source ORDER BY class DESC)),
starts AS (SELECT source, max(class) AS first_class, arg_max(c, class) AS c FROM tried WHERE c * class < 1 GROUP BY source),
odds AS (
  SELECT t.source, t.class, CASE WHEN t.class <= first_class THEN greatest(s.c * t.class, CAST(0 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END AS p
  FROM classes t LEFT JOIN starts s ON t.source IS NOT DISTINCT FROM s.source),
ranked AS (
  SELECT b.*, p, w.source_size, w.target, w.whole, w.wanted,
         CASE WHEN p >= 1 THEN -1 ELSE least(CAST(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * CAST(4503599627370496 AS DOUBLE)) AS BIGINT),
                                             4503599627370495) END AS v
  FROM base b JOIN wants w ON b.source IS NOT DISTINCT FROM w.source
  JOIN odds o ON b.source IS NOT DISTINCT FROM o.source AND b.class = o.class),
running AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY v, draw, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN wanted > 0 AND (p >= 1 OR upto < wanted OR (upto - size < wanted AND (upto - wanted) * 2 <= size)) THEN 1 ELSE 0 END)
         AS taken
FROM running
"""
