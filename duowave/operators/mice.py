"""Multiple imputation by chained equations with predictive mean matching.

Observed cells are stored once. Of the copies only the gaps are stored, as one list per gap. All copies advance together:
rows without any gap add the same moments to the regressions of all copies and are summed up once; the others are put
together with the gaps of each copy. A step is one aggregation, a tiny solve per copy, and one pass that matches every gap
with the observed cells of nearest prediction. For that pass a row is sent once to each range of positions that holds any of
its copies, and its positions are computed there; gaps at the border of a range are settled afterwards.
All choices derive from row hashes, so a lost executor or another partitioning cannot change the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duowave.operators.linear import cross_products, symmetric
from duowave.plans.scratch import Scratch
from duowave.plans.skew import BUCKET_ROWS

# Number of copies, rounds, donors per gap, seed and ridge of the regressions.
COPIES = 20
ROUNDS = 5
DONORS = 5
SEED = 20251130
RIDGE = 1e-5
# Target size of one range of positions, in rows of all copies together.
RANGE_ROWS = BUCKET_ROWS // 2


def _uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) that depends only on the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / float(1 << 52)


def _draws(moments: tuple[np.ndarray, np.ndarray, np.ndarray], imps: Sequence[int], seed: int, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Per copy the fitted coefficients and one draw from their distribution, intercept first.

    ``moments`` are counts, means and cross-products per copy, the outcome last. Each copy draws from a stream of its own.
    """
    n, means, s = moments
    k = means.shape[1] - 1
    inner, cross = s[:, :k, :k], s[:, :k, k]
    inverse = np.linalg.pinv(inner + RIDGE * np.eye(k) * inner, hermitian=True)
    beta = np.einsum("bij,bj->bi", inverse, cross)
    rest = np.maximum(s[:, k, k] - 2 * np.einsum("bi,bi->b", beta, cross) + np.einsum("bi,bij,bj->b", beta, inner, beta), 0.0)
    dof = np.maximum(n - k - 1, 1)
    streams = [np.random.default_rng([seed, int(i), *label.encode()]) for i in imps]
    draws = [(r.chisquare(d), r.standard_normal(k), r.standard_normal()) for r, d in zip(streams, dof)]
    sigma = np.sqrt(rest / np.array([d[0] for d in draws]))
    values, vectors = np.linalg.eigh(inverse)
    root = vectors * np.sqrt(np.clip(values, 0, None))[:, None, :]
    drawn = beta + sigma[:, None] * np.einsum("bij,bj->bi", root, np.array([d[1] for d in draws]))
    centre = means[:, k] + sigma * np.array([d[2] for d in draws]) / np.sqrt(n)
    return (np.column_stack([means[:, k] - np.einsum("bi,bi->b", beta, means[:, :k]), beta]),
            np.column_stack([centre - np.einsum("bi,bi->b", drawn, means[:, :k]), drawn]))


def _prediction(coefficients: np.ndarray, predictors: Sequence[str]) -> Column:
    """Linear prediction with the coefficients of the row's copy."""
    def of_copy(i: int) -> Column:
        return F.expr(f"element_at(array({', '.join(f'{float(c)!r}D' for c in coefficients[:, i])}), imp)")

    total = of_copy(0)
    for i, x in enumerate(predictors, 1):
        total = total + of_copy(i) * F.col(x)
    return total


def _predictions(coefficients: np.ndarray, cells: Callable[[int], Sequence[str]]) -> Column:
    """Array of the linear predictions of all copies; ``cells`` gives the predictors' SQL in a copy, by its place."""
    totals = [" + ".join([f"{float(own[0])!r}D", *[f"{float(c)!r}D * {x}" for c, x in zip(own[1:], cells(i))]])
              for i, own in enumerate(coefficients)]
    return F.expr(f"array({', '.join(totals)})")


def _merged(shared, own: Mapping[int, tuple], imps: Sequence[int], columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments per copy of the shared rows (over all variables, or ``None``) and the copy's own rows together."""
    k = len(columns)
    counts, means, products = [], [], []
    for imp in imps:
        parts = [(shared[0], shared[1][columns], shared[2][np.ix_(columns, columns)])] if shared else []
        parts += [own[imp]] if imp in own else []
        n = sum(p[0] for p in parts)
        mean = sum((p[0] * p[1] for p in parts), np.zeros(k)) / max(n, 1)
        counts.append(n)
        means.append(mean)
        products.append(sum((p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts), np.zeros((k, k))))
    return np.array(counts), np.stack(means), np.stack(products)


def _collected(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> dict[int, tuple]:
    """Count, means and cross-products per copy (or under 0): one row per copy reaches the driver."""
    return {r["imp"] if by else 0: (r["n"], np.array(r["means"], dtype=float), symmetric(r["s"], len(columns)))
            for r in cross_products(df, columns, by).collect() if r["n"]}


class _Cuts:
    """Buckets of positions per copy: ranges between cut points. A cut point that comes more than once is a position of many
    rows, which get as many buckets of their own, by tie."""

    def __init__(self, points: Mapping[int, Sequence[float]]):
        self.copies = {}
        for imp, p in points.items():
            values, times = np.unique(np.asarray(p, dtype=float), return_counts=True)
            split = np.where(times > 1, times, 0)
            self.copies[imp] = values, split, np.arange(len(values) + 1) + np.concatenate([[0], np.cumsum(split)])

    def split_any(self, imp: int) -> bool:
        return bool(self.copies[imp][1].any())

    def buckets(self, imp: int, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
        values, split, first = self.copies[imp]
        i = np.searchsorted(values, at, side="left")
        inside = np.minimum(i, len(values) - 1)
        parts = np.where((i < len(values)) & (values[inside] == at), split[inside], 0)
        own = np.minimum(np.floor((tie.astype(float) + 2.0**63) / 2.0**64 * parts), np.maximum(parts - 1, 0)).astype(int)
        return first[i] + np.where(parts > 0, 1 + own, 0)


def _bucketed(rows: DataFrame, per_copy: int) -> DataFrame:
    """Add ``bucket``, about ``per_copy`` ranges of ``at`` and ``tie`` per copy. The cut points are all that is kept of them."""
    shares = [i / per_copy for i in range(1, per_copy)]
    found = rows.groupBy("imp").agg(F.percentile_approx("at", shares, max(10_000, 20 * per_copy)).alias("p")).collect()
    cuts = _Cuts({r["imp"]: r["p"] for r in found})

    def label(batches):
        for batch in batches:
            imps, at, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("imp", "at", "tie"))
            bucket = np.zeros(batch.num_rows, dtype=np.int32)
            for imp in np.unique(imps):
                here = imps == imp
                bucket[here] = cuts.buckets(int(imp), at[here], tie[here])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], [*batch.schema.names, "bucket"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(label, f"{fields}, bucket int")


def _spread(rows: DataFrame, copies: int, cuts: _Cuts, keep_at: bool) -> DataFrame:
    """Each row once per bucket that holds any of its copies, with ``bucket`` and the list ``copies`` of those.

    ``rows`` carries the array at (positions in all copies) and, if cut points come more than once, tie. ``at`` becomes
    the positions in ``copies``, or null unless ``keep_at``.
    """
    payload = [c for c in rows.columns if c not in ("at", "tie")]

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, copies)

    def label(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = matrix(batch, "at")
            bucket = cuts.buckets(0, at, matrix(batch, "tie") if "tie" in batch.schema.names else np.zeros(at.shape))
            order = np.argsort(bucket, axis=1, kind="stable")
            ranked = np.take_along_axis(bucket, order, axis=1)
            first = np.column_stack([np.ones(len(at), dtype=bool), ranked[:, 1:] != ranked[:, :-1]])
            # Copies of one row in one bucket lie next to each other.
            starts = np.flatnonzero(first)
            ends = pa.array(np.append(starts, at.size), pa.int32())
            own = (pa.ListArray.from_arrays(ends, pa.array(np.take_along_axis(at, order, axis=1).ravel())) if keep_at
                   else pa.nulls(len(starts), pa.list_(pa.float64())))
            sent = batch.select(payload).take(pa.array(starts // copies))
            yield pa.RecordBatch.from_arrays(
                [*sent.columns, pa.array(ranked.ravel()[starts], pa.int32()), pa.ListArray.from_arrays(ends, pa.array((order + 1).ravel(), pa.int16())), own],
                [*payload, "bucket", "copies", "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*payload).schema)
    return rows.mapInArrow(label, f"{fields}, bucket int, copies array<smallint>, at array<double>")


def _match(cut: DataFrame, name: str, donors: int, borders: bool) -> DataFrame:
    """Every gap in ``name`` with the value of one of its nearest donors.

    Of the ``donors`` donors before and after a gap, in the order of position and tie, the nearest by position count.
    With ``borders``, ``place`` is 0 for gaps that have all these donors in their bucket and -1 for the others. The
    outermost donors of a bucket are returned too, with their ``place`` among its ``n`` donors.
    """
    columns = cut.columns

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["tie"].to_numpy(), pdf["at"].to_numpy()))
        is_donor = pdf["is_donor"].to_numpy(dtype=bool)[order]
        gaps = ~is_donor
        n = int(is_donor.sum())
        upto = np.cumsum(is_donor)
        before = upto[gaps]
        # A gap near one border reaches no further than the donors kept there.
        inner = (before >= donors) & (n - before >= donors)
        out = pdf.iloc[order[gaps]]
        if n and len(out):
            donor_rows = order[is_donor]
            at, value = pdf["at"].to_numpy()[donor_rows], pdf[name].to_numpy()[donor_rows]
            take = min(donors, n)
            # Places around the gap's own place in the order of position and tie: they do not depend on how the rows
            # are cut, and among equal positions they differ from gap to gap.
            slots = before[:, None] + np.arange(-donors, donors)
            distance = np.where((slots >= 0) & (slots < n), np.abs(at[np.clip(slots, 0, n - 1)] - out["at"].to_numpy()[:, None]), np.inf)
            nearest = np.argsort(distance, axis=1, kind="stable")[:, :take]
            choice = np.minimum((out["pick"].to_numpy() * take).astype(int), take - 1)
            rows = np.arange(len(out))
            found = value[slots[rows, nearest[rows, choice]]]
            out = out.assign(**{name: np.where(inner, found, np.nan) if borders else found})
        if not borders:
            return out
        outer = is_donor & ((upto <= 2 * donors) | (upto > n - 2 * donors))
        return pd.concat([out.assign(place=np.where(inner, 0, -1)), pdf.iloc[order[outer]].assign(place=upto[outer])]).assign(n=n)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.groupBy("imp", "bucket").applyInPandas(fill, f"{fields}, place long, n long" if borders else fields).select(
        *columns, *(["place", "n"] if borders else []))


def _matched(cut: DataFrame, name: str, donors: int, scratch: Scratch) -> DataFrame:
    """Match all gaps of buckets that are ranges of positions. Only gaps near a border and the outermost donors are read again.

    From the counts of the buckets each outermost donor gets its rank among all donors of its copy, and each bucket asks
    for the ranks around its range.
    """
    found = scratch.write(_match(cut, name, donors, True), "found")
    kept = found.where("place <> 0")
    earlier = Window.partitionBy("imp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per copy and bucket.
    sizes = kept.select("imp", "bucket", "n").distinct().withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = kept.where("place > 0").drop("n").join(sizes.drop("n"), ["imp", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("place")).drop("before", "place", "bucket")
    wanted = sizes.select("imp", "bucket", F.explode(F.concat(
        F.sequence(F.col("before") - donors + 1, F.col("before")),
        F.sequence(F.col("before") + F.col("n") + 1, F.col("before") + F.col("n") + donors),
    )).alias("rank"))
    edges = scratch.write(wanted.join(ranked, ["imp", "rank"]).select(*cut.columns), "edges")
    # By number, as these few bytes in many groups would otherwise be put together into one task.
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    rest = kept.select(*cut.columns).unionByName(edges).repartition(parts, "imp", "bucket")
    late = _match(rest, name, donors, False)
    return found.where("place = 0").select(*cut.columns).unionByName(late)


def _impute_step(rows: DataFrame, name: str, n_rows: int, copies: int, scratch: Scratch, donors: int, bucket_rows: int) -> DataFrame:
    """Match gaps in one variable; ``rows`` carries at (match position), tie, pick and is_donor for each of the ``copies``."""
    if n_rows <= bucket_rows:
        # A whole copy fits into one bucket.
        gaps = _match(rows.withColumn("bucket", F.lit(0)), name, donors, False)
    else:
        gaps = _matched(_bucketed(rows, -(-n_rows // bucket_rows)), name, donors, scratch)
    return gaps.select(*rows.columns).unionByName(rows.where("is_donor"))


def mice_pmm(df: DataFrame, key: str, variables: Sequence[str], m: int = COPIES, rounds: int = ROUNDS,
             donors: int = DONORS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``m`` completed copies of ``df``, numbered by ``imp``.

    ``key`` identifies a row. ``variables`` are the numeric columns of the imputation model; each
    incomplete one is predicted from all others, in the given order, ``rounds`` times. Observed cells stay
    as they are, and every filled cell is an observed value of its variable.
    """
    variables = list(variables)
    scratch = Scratch(df.sparkSession, "mice")
    base = scratch.write(
        df.select(F.monotonically_increasing_id().alias("_row"), key, *[F.col(v).cast("double").alias(v) for v in variables]), "input"
    )
    sizes = base.agg(F.count("*").alias("_rows"), *[F.count(v).alias(v) for v in variables]).first()
    n_rows = sizes["_rows"]
    incomplete = [v for v in variables if sizes[v] < n_rows]
    empty = [v for v in incomplete if sizes[v] == 0]
    if empty:
        raise ValueError(f"nothing observed in {empty}")
    imps = list(range(1, m + 1))
    copied = F.explode(F.sequence(F.lit(1), F.lit(m))).alias("imp")
    if not incomplete:
        return base.select(copied, key, *variables)
    whole = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in incomplete])
    complete, partial = base.where(whole), scratch.write(base.where(~whole), "partial")
    # What the complete rows add to any regression of any copy.
    shared = _collected(complete, variables, []).get(0)
    n_buckets = max(-(-n_rows // bucket_rows), -(-n_rows * m // RANGE_ROWS))
    # Partial rows; ``gap_`` holds the fills of a gap, one per copy.
    state = partial
    turn = 0

    def keep(gaps: DataFrame, v: str) -> None:
        # Two alternating tables: the one being read is never the one being replaced.
        nonlocal turn, state
        turn += 1
        fills = scratch.write(gaps.select("imp", "_row", F.col(v).alias("value")), f"gaps_{variables.index(v)}_{turn % 2}")
        lists = fills.repartition("_row").groupBy("_row").agg(
            F.array_sort(F.collect_list(F.struct("imp", "value"))).getField("value").alias(f"gap_{v}"))
        state = scratch.write(state.drop(f"gap_{v}").join(lists, "_row", "left"), f"state_{turn % 2}")

    def completed(rows: DataFrame) -> DataFrame:
        """Partial rows of every copy with all gaps filled."""
        cells = [F.expr(f"coalesce(`{v}`, element_at(`gap_{v}`, imp))").alias(v) if v in incomplete else F.col(v) for v in variables]
        return rows.withColumn("imp", copied).select("imp", key, *cells)

    def match(v: str, step: str, at: Column, rows: Sequence[tuple[DataFrame, Column, bool]]) -> None:
        """Fill ``v``. ``rows`` are tables with the array of their positions in all copies. Those marked send it along, the
        others send the columns that ``at``, the position in the row's copy, is made of."""
        def chance(imp: Column) -> list[Column]:
            return [F.lit(step), F.lit(v), imp, F.col(key)]

        needed = [x for x in variables if x != v] if step != "start" else []
        places = []
        for df, positions, along in rows:
            cells = [F.lit(None).cast("double").alias(x) if along else F.col(x) for x in needed]
            # Only gaps are looked up by their row.
            places.append(df.select(F.when(F.col(v).isNull(), F.col("_row")).otherwise(-1).alias("_row"), key, v, *cells,
                                    positions.alias("at"), F.col("_row").alias("_spot")))
        if n_buckets == 1:
            sent = reduce(DataFrame.unionByName, places).drop("_spot").withColumns({
                "bucket": F.lit(0), "copies": F.sequence(F.lit(1), F.lit(m))})
        else:
            # Any cut points give the same fills; they come from one copy of each row.
            shares = [i / n_buckets for i in range(1, n_buckets)]
            spots = reduce(DataFrame.unionByName, [
                p.select(F.element_at("at", (F.pmod(F.xxhash64("_spot"), F.lit(m)) + 1).cast("int")).alias("at")) for p in places])
            cuts = _Cuts({0: spots.agg(F.percentile_approx("at", shares, max(10_000, 20 * n_buckets))).first()[0]})
            ties = [F.array(*[F.xxhash64(F.lit(seed), *chance(F.lit(i))) for i in imps]).alias("tie")] if cuts.split_any(0) else []
            sent = reduce(DataFrame.unionByName, [
                _spread(p.drop("_spot").select("*", *ties), m, cuts, along) for p, (_, _, along) in zip(places, rows)])
            # More partitions than buckets, so that few of them share one.
            sent = sent.repartition(2 * n_buckets, "bucket")
        donor = F.col(v).isNotNull()
        copies = sent.select("*", F.posexplode("copies").alias("_place", "_copy")).withColumn("imp", F.col("_copy").cast("int"))
        cut = copies.select(
            "imp", "bucket", "_row", v, donor.alias("is_donor"), F.coalesce(F.expr("get(at, _place)"), at).alias("at"),
            F.xxhash64(F.lit(seed), *chance(F.col("imp"))).alias("tie"),
            F.when(donor, 0.0).otherwise(_uniform(seed, *chance(F.col("imp")))).alias("pick"))
        keep(_match(cut, v, donors, False) if n_buckets == 1 else _matched(cut, v, donors, scratch), v)

    # Start: a random observed value, found by matching on a random position.
    for v in incomplete:
        def start(imp: Column) -> Column:
            return _uniform(seed, F.lit("start"), F.lit(v), imp, F.col(key))

        match(v, "start", start(F.col("imp")), [(base, F.array(*[start(F.lit(i)) for i in imps]), False)])
    for round_ in range(rounds):
        for v in incomplete:
            predictors = [x for x in variables if x != v]
            own = _collected(completed(state.where(F.col(v).isNotNull())), [*predictors, v], ["imp"])
            moments = _merged(shared, own, imps, [variables.index(x) for x in [*predictors, v]])
            fitted, drawn = _draws(moments, imps, seed, f"{round_}:{v}")

            def given(_: int) -> list[str]:
                return [f"`{x}`" for x in predictors]

            def filled(i: int) -> list[str]:
                return [f"coalesce(`{x}`, get(`gap_{x}`, {i}))" if x in incomplete else f"`{x}`" for x in predictors]

            match(v, str(round_), _prediction(fitted, predictors), [
                (complete, _predictions(fitted, given), False),
                (state, F.when(F.col(v).isNotNull(), _predictions(fitted, filled)).otherwise(_predictions(drawn, filled)), True)])
    return complete.select(copied, key, *variables).unionByName(completed(state))
