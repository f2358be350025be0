"""Elastic-net regression from moments: the whole path and its cross-validation in one pass over the rows.

Spark sums up the centred cross-products of all columns per key and fold. Everything else needs these tables only: the rest
of a fold is the total less the fold, coordinate descent walks along the path on the Gram matrix, and the error on the
fold left out is a quadratic form in its moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.categories import GROUPS, group_dummy
from duowave.operators.linear import symmetric
from duowave.plans.scratch import Scratch, materialize
from duowave.plans.skew import join_small

FOLDS, LAMBDAS, LEAST_SHARE, MIX = 10, 60, 1e-3, 0.5
# Coordinate descent ends when a sweep moves no standardised coefficient by more than this share of the outcome's deviation.
STILL, SWEEPS = 1e-10, 100_000
# Different levels that a factor may have.
MOST_LEVELS = 100
# Sums that a task holds before it hands them on.
HELD_SUMS = 2_000_000


def fold_of(id_col: Column, folds: int = FOLDS) -> Column:
    """Fold of a row by the leading digits of an MD5 of its id; null ids are fold 0."""
    digits = F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(digits % folds, F.lit(0)).cast("int")


def fold_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str], fold: Column) -> tuple[DataFrame, DataFrame]:
    """Sums per key and fold over rows with all columns known, and the keys with the means they are centred by.

    The first table has ``model``, ``fold``, ``at`` and ``value``: the count, the sums of the columns and the upper triangle
    of their products, centred by the key's means. The second has ``by``, ``model`` and ``means``. Keys may be of any
    number; a row per key, fold and sum leaves each task.
    """
    by = list(by)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    rows = df.select(*by, fold.alias("fold"), x.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = rows.withColumn("model", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    means = rows.groupBy(*by, "model").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(columns))]).alias("means"))
    means = Scratch(df.sparkSession, "moments").write(means, "means")
    width = len(columns)
    upper = np.triu_indices(width)
    cells = 1 + width + len(upper[0])

    def compute(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.array(list(held))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(keys[:, 0], cells)), pa.array(np.repeat(keys[:, 1], cells).astype(np.int32)),
                    pa.array(np.tile(np.arange(cells, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))],
                    ["model", "fold", "at", "value"])
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            gap = batch.column("gap").flatten().to_numpy().reshape(-1, width)
            keys = np.stack([batch.column("model").to_numpy(), batch.column("fold").to_numpy()], axis=1)
            found, of = np.unique(keys, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            edges = np.searchsorted(of.ravel()[order], np.arange(len(found) + 1))
            for key, start, stop in zip(map(tuple, found.tolist()), edges[:-1], edges[1:]):
                part = gap[order[start:stop]]
                sums = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part)[upper]])
                held[key] = held[key] + sums if key in held else sums
            if len(held) * cells > HELD_SUMS:
                yield from flush()
        yield from flush()

    joined = join_small(rows.select("model", "fold", "x"), means.select("model", "means"), ["model"], "inner")
    gaps = joined.select("model", "fold", F.zip_with("x", "means", lambda a, b: a - b).alias("gap"))
    parts = gaps.mapInArrow(compute, "model long, fold int, at int, value double")
    return parts.groupBy("model", "fold", "at").agg(F.sum("value").alias("value")), means


def descend(gram: np.ndarray, cross: np.ndarray, lam: float, mix: float, weight: np.ndarray, start: np.ndarray, still: float) -> np.ndarray:
    """Coefficients of standardised columns that minimise half the mean squared error plus the elastic-net penalty."""
    beta = start.copy()
    soft, ridge = lam * mix * weight, lam * (1 - mix) * weight
    free = np.diag(gram) > 0
    pull = cross - gram @ beta
    for _ in range(SWEEPS):
        largest = 0.0
        for j in np.flatnonzero(free):
            rest = pull[j] + gram[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - soft[j], 0.0) / (gram[j, j] + ridge[j])
            step = new - beta[j]
            if step:
                pull -= gram[:, j] * step
                beta[j] = new
                largest = max(largest, abs(step))
        if largest <= still:
            return beta
    raise ArithmeticError("coordinate descent did not settle")


class Moments:
    """Count, sums and products of the columns, the last of which is the outcome; all around the same centre."""

    def __init__(self, n: float, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n, sums, products

    def less(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def standardised(self):
        """Means, deviations of the columns, their correlations and their correlations with the outcome in its units."""
        mean = self.sums / self.n
        cov = self.products / self.n - np.outer(mean, mean)
        # What rounding leaves of a constant column is none.
        tiny = 1e-12 * np.maximum(np.diag(self.products) / self.n, 1e-300)
        spread = np.where(np.diag(cov) > tiny, np.sqrt(np.maximum(np.diag(cov), 0.0)), 0.0)
        unit = np.where(spread[:-1] > 0, spread[:-1], np.inf)
        return mean, spread, cov[:-1, :-1] / np.outer(unit, unit), cov[:-1, -1] / unit

    def squared_error(self, intercept: float, beta: np.ndarray) -> float:
        """Sum of squared residuals of the rows behind these moments."""
        v = np.append(-beta, 1.0)
        return float(v @ self.products @ v - 2 * intercept * (v @ self.sums) + self.n * intercept**2)


def largest_lambda(moments: Moments, mix: float, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalty from which on only columns without penalty have coefficients, and those coefficients."""
    _, spread, gram, cross = moments.standardised()
    start = descend(gram, cross, 0.0, mix, weight, np.zeros(len(cross)), STILL * max(spread[-1], 1e-300)) if (weight == 0).all() else None
    if start is None:
        fixed = np.flatnonzero(weight == 0)
        start = np.zeros(len(cross))
        if len(fixed):
            start[fixed] = np.linalg.pinv(gram[np.ix_(fixed, fixed)], hermitian=True) @ cross[fixed]
    pull = np.abs(cross - gram @ start) * (weight > 0)
    return float(np.max(pull / np.where(weight > 0, weight, np.inf), initial=0.0)) / max(mix, 1e-3), start


def solve_path(moments: Moments, lambdas: np.ndarray, mix: float, weight: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Intercept and coefficients, in the columns' units around the centre, per penalty from the largest on."""
    mean, spread, gram, cross = moments.standardised()
    _, beta = largest_lambda(moments, mix, weight)
    out = []
    for lam in lambdas:
        beta = descend(gram, cross, lam, mix, weight, beta, STILL * max(spread[-1], 1e-300))
        slopes = np.divide(beta, spread[:-1], out=np.zeros_like(beta), where=spread[:-1] > 0)
        out.append((float(mean[-1] - slopes @ mean[:-1]), slopes))
    return out


def elastic_net(df: DataFrame, outcome: str, columns: Sequence[str], by: Sequence[str] = (), id_col: str = "patient", mix: float = MIX,
                free: Sequence[str] = (), folds: int = FOLDS, lambdas: int = LAMBDAS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The elastic-net path of ``outcome`` on ``columns`` per key, one row per penalty.

    Minimised is half the mean squared error plus ``penalty`` times ``mix`` times the absolute values plus half of 1 - ``mix``
    times the squares of the coefficients of standardised columns; those in ``free`` bear none. ``penalty`` falls from where
    all others vanish to ``least_share`` of it. Folds are dealt by a hash of ``id_col``, so rows of a patient stay together.

    Output: ``share`` of the largest penalty, ``penalty``, ``n_obs``, ``n_nonzero``, ``intercept``, ``betas`` (in units of the columns),
    ``cv_error`` (mean squared error on the folds left out), ``cv_se`` (its standard error), ``fold_sse`` (by fold that has rows) and
    the marks ``is_min`` and ``is_1se`` (largest penalty within one standard error of the least).

    Rows with an unknown column are left out; null keys are a key. Constant columns have coefficient 0. Keys with fewer
    than two folds have no cross-validation, and ``is_min`` marks none.
    """
    by, columns = list(by), list(columns)
    sums, means = fold_moments(df, [*columns, outcome], by, fold_of(df[id_col], folds))
    width = len(columns) + 1
    weight = np.array([0.0 if c in free else 1.0 for c in columns])
    shares = np.geomspace(1.0, least_share, lambdas)
    schema = ("model long, share double, penalty double, n_obs long, n_nonzero int, intercept double, betas array<double>, cv_error double, "
              "cv_se double, fold_sse array<double>, is_min boolean, is_1se boolean")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        centre = np.asarray(rows["means"].iloc[0])
        parts = []
        for _, fold in rows.sort_values(["fold", "at"]).groupby("fold"):
            value = fold["value"].to_numpy()
            parts.append(Moments(value[0], value[1:width + 1], symmetric(value[width + 1:], width)))
        total = Moments(sum(m.n for m in parts), sum(m.sums for m in parts), sum(m.products for m in parts))
        top, _ = largest_lambda(total, mix, weight)
        path = solve_path(total, shares * top, mix, weight)
        out = pd.DataFrame({
            "model": rows["model"].iloc[0], "share": shares, "penalty": shares * top, "n_obs": int(total.n),
            "n_nonzero": [int(np.count_nonzero(b)) for _, b in path],
            "intercept": [i + centre[-1] - b @ centre[:-1] for i, b in path], "betas": [b.tolist() for _, b in path],
            "cv_error": None, "cv_se": None, "fold_sse": None, "is_min": False, "is_1se": False})
        if len(parts) > 1:
            sse = np.array([[m.squared_error(*fit) for fit in solve_path(total.less(m), shares * top, mix, weight)] for m in parts])
            n = np.array([m.n for m in parts])
            error = sse.sum(axis=0) / total.n
            spread = np.sqrt((n[:, None] * (sse / n[:, None] - error) ** 2).sum(axis=0) / total.n / (len(parts) - 1))
            best = int(np.argmin(error))
            out["cv_error"], out["cv_se"], out["fold_sse"] = error, spread, sse.T.tolist()
            out["is_min"] = np.arange(len(path)) == best
            out["is_1se"] = np.arange(len(path)) == int(np.argmax(error <= error[best] + spread[best]))
        return out

    # A key has no more rows than folds times sums.
    keyed = join_small(sums, means.select("model", "means"), ["model"], "inner")
    solved = materialize(keyed.groupBy("model").applyInPandas(solve, schema), "path")
    return join_small(solved, means.select("model", *by), ["model"], "inner").select(*by, *[c for c in solved.columns if c != "model"])


def net_coefficients(path: DataFrame, columns: Sequence[str], by: Sequence[str] = (), rule: str = "is_1se") -> DataFrame:
    """``term`` and ``estimate`` (0 for terms left out) at the penalty marked by ``rule``, intercept first."""
    terms = F.concat(F.array(F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"))), F.zip_with(
        F.array(*[F.lit(c) for c in columns]), "betas", lambda t, b: F.struct(t.alias("term"), b.alias("estimate"))))
    return path.where(rule).select(*by, "penalty", F.inline(terms))


def moderator_columns(df: DataFrame, numeric: Sequence[str], factors: Sequence[str], pre: str, group: str = "group",
                      levels: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of a moderator model, and their names: baseline, arm, predictors, and arm times predictor.

    Factors are coded against their first sorted level. Levels that are not given are gathered, up to ``MOST_LEVELS`` a factor.
    Rows of undeclared arms are left out.
    """
    levels = dict(levels or {})
    unknown = [f for f in factors if f not in levels]
    if unknown:
        seen = df.agg(*[F.count_distinct(f).alias(f) for f in unknown]).first()
        wide = [f for f in unknown if seen[f] > MOST_LEVELS]
        if wide:
            raise ValueError(f"more than {MOST_LEVELS} levels: {', '.join(wide)}")
        found = df.agg(*[F.sort_array(F.collect_set(F.col(f).cast("string"))).alias(f) for f in unknown]).first()
        levels |= {f: found[f] for f in unknown}
    main = {p: F.col(p).cast("double") for p in numeric}
    for f in factors:
        for level in levels[f][1:]:
            main[f"{f}{level}"] = (F.col(f).cast("string") == level).cast("double")
    arm = group_dummy(group).cast("double")
    made = {pre: F.col(pre).cast("double"), "groupIntervention": arm, **main, **{f"groupIntervention:{n}": arm * c for n, c in main.items()}}
    others = [c for c in df.columns if c not in made]
    return df.where(F.col(group).isin(*GROUPS)).select(*others, *[c.alias(n) for n, c in made.items()]), list(made)


def moderator_net(df: DataFrame, numeric: Sequence[str], factors: Sequence[str], pre: str, post: str, group: str = "group",
                  id_col: str = "patient", by: Sequence[str] = (), **options) -> tuple[DataFrame, list[str]]:
    """Elastic-net path of ``post`` on baseline, arm, predictors and their interactions with the arm, and the terms' names.

    Baseline and arm bear no penalty; an interaction that stays marks a moderator of the treatment response.
    """
    rows, terms = moderator_columns(df, numeric, factors, pre, group)
    return elastic_net(rows, post, terms, by, id_col, free=terms[:2], **options), terms
