"""Negative-binomial mixed model: score ~ group * time with a random intercept per patient.

A patient's likelihood is an integral over the intercept, taken by adaptive Gauss-Hermite quadrature: nodes are placed
around the mode, scaled by the curvature there. Its score and information come from the same nodes, as moments of the
derivatives under the intercept's posterior. Patients with the same visits and scores have the same likelihood, so they
are one weighted row. Every pass over these rows evaluates the proposals of all instruments at once, sums up likelihood,
gradient and Hessian in Spark and leaves six numbers per instrument to damped Newton steps on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.functions.categories import GROUPS, INTERVENTION, TIMES
from duowave.functions.gamma import digamma_rising, log_rising, trigamma_rising
from duowave.functions.tails import z_two_sided
from duowave.plans.scratch import Scratch

TERMS = ("(Intercept)", "groupIntervention", "timepost", "groupIntervention:timepost")
# The fixed effects, then the logarithms of the dispersion and of the intercepts' standard deviation.
SIZE = len(TERMS) + 2
NODES = 15
MAX_PASSES = 80
# Newton stops when a step promises less than this in log-likelihood; range of both logarithms; longest step.
ENOUGH = 1e-9
LIMITS = ((-8.0, 12.0), (-8.0, 4.0))
LONGEST_STEP = 2.0
# A deviation below this is tried at the lower end of its range, which stands for none, and stays there unless the likelihood
# falls by more than the loss.
NEAR_NONE, LOSS = 0.1, 1e-7
# Rows of patients evaluated together.
CHUNK = 4096
_UPPER = np.triu_indices(SIZE)


def patterns(long: DataFrame, by: Sequence[str] = ("instrument",), patient: str = "patient", group: str = "group",
             time: str = "time", value: str = "score") -> DataFrame:
    """Distinct sets of visits: ``cells`` (arrays ``g``, ``t``, ``y``, ``w`` of arm, visit, score and repeats) and ``n`` patients.

    Patients with fewer than two rows are left out; so are rows without patient, declared arm, visit or score. Equal
    scores of a patient's cell are one entry with its count before they are gathered, so an entry list is no longer
    than the different scores of one patient.
    """
    rows = long.where(F.col(patient).isNotNull() & F.col(group).isin(*GROUPS) & F.col(time).isin(*TIMES))
    counted = rows.groupBy(*by, patient, (F.col(group) == INTERVENTION).cast("double").alias("_g"),
                           (F.col(time) == TIMES[1]).cast("double").alias("_t"), F.col(value).cast("double").alias("_y")).count()
    entry = F.when(F.col("_y").isNotNull(), F.struct("_g", "_t", "_y", F.col("count").cast("double").alias("_w")))
    people = counted.groupBy(*by, patient).agg(F.sum("count").alias("_rows"), F.sort_array(F.collect_list(entry)).alias("cells"))
    return people.where("_rows >= 2 AND size(cells) > 0").groupBy(*by, "cells").agg(F.count("*").alias("n"))


def _patient_terms(params: np.ndarray, g: np.ndarray, t: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray,
                   nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and upper triangle of the Hessian per patient; ``first`` is where each one's entries begin."""
    beta, theta, sigma = params[:len(TERMS)], np.exp(params[-2]), np.exp(params[-1])
    x = np.stack([np.ones_like(g), g, t, g * t])
    eta = beta @ x
    count = np.diff(np.append(first, len(y)))
    owner = np.repeat(np.arange(len(first)), count)

    def total(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, first, axis=0)

    # Mode of the intercept: the log posterior is concave, so bounded Newton steps reach it.
    b = np.zeros(len(first))
    for _ in range(100):
        mu = np.exp(eta + b[owner])
        slope = total(w * theta * (y - mu) / (theta + mu)) - b / sigma**2
        bend = total(w * (y + theta) * theta * mu / (theta + mu) ** 2) + 1 / sigma**2
        step = np.clip(slope / bend, -1.0, 1.0)
        b += step
        if np.abs(step).max() < 1e-11:
            break
    mu = np.exp(eta + b[owner])
    scale = 1 / np.sqrt(total(w * (y + theta) * theta * mu / (theta + mu) ** 2) + 1 / sigma**2)

    place, weight = np.polynomial.hermite.hermgauss(nodes)
    b = b[:, None] + np.sqrt(2.0) * scale[:, None] * place
    mu = np.exp(eta[:, None] + b[owner])
    y, w = y[:, None], w[:, None]
    both = theta + mu
    constant = log_rising(np.full_like(y, theta), y) - log_rising(np.ones_like(y), y)
    log_p = constant - theta * np.log1p(mu / theta) + y * (np.log(mu) - np.log(both))
    joint = total(w * log_p) - b**2 / (2 * sigma**2) - np.log(sigma) - 0.5 * np.log(2 * np.pi)
    shares = joint + np.log(weight) + place**2
    top = shares.max(axis=1, keepdims=True)
    mass = np.exp(shares - top)
    log_l = top[:, 0] + np.log(mass.sum(axis=1)) + np.log(np.sqrt(2.0) * scale)
    mass /= mass.sum(axis=1, keepdims=True)

    # Derivatives of the joint density at the nodes, then their moments over the posterior.
    d_eta = w * theta * (y - mu) / both
    d_eta2 = -w * (y + theta) * theta * mu / both**2
    d_theta = digamma_rising(np.full_like(y, theta), y) - np.log1p(mu / theta) + (mu - y) / both
    d_theta2 = trigamma_rising(np.full_like(y, theta), y) + mu / (theta * both) - (mu - y) / both**2
    d_mixed = w * theta * (y - mu) * mu / both**2
    grad = np.stack([total(d_eta * x[i][:, None]) for i in range(len(TERMS))]
                    + [total(w * theta * d_theta), b**2 / sigma**2 - 1], axis=2)
    hess = np.zeros((*b.shape, len(_UPPER[0])))
    for at, (i, j) in enumerate(zip(*_UPPER)):
        if j < len(TERMS):
            hess[..., at] = total(d_eta2 * (x[i] * x[j])[:, None])
        elif j == len(TERMS):
            hess[..., at] = total(d_mixed * x[i][:, None]) if i < j else total(w * (theta**2 * d_theta2 + theta * d_theta))
        elif i == j:
            hess[..., at] = -2 * b**2 / sigma**2
    mean = np.einsum("pk,pki->pi", mass, grad)
    outer = np.einsum("pk,pki,pkj->pij", mass, grad, grad) - mean[:, :, None] * mean[:, None, :]
    return log_l, mean, np.einsum("pk,pku->pu", mass, hess) + outer[:, _UPPER[0], _UPPER[1]]


def _evaluate(rows: DataFrame, params: Mapping[int, np.ndarray], nodes: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and Hessian per model at the given parameters, from rows with ``model``, ``cells`` and ``n``."""
    width = 1 + SIZE + len(_UPPER[0])

    def compute(batches):
        for batch in batches:
            models = batch.column("model").to_numpy()
            for model in np.unique(models):
                if model not in params:
                    continue
                part = batch.filter(pa.array(models == model))
                sums = np.zeros(width)
                for start in range(0, part.num_rows, CHUNK):
                    chunk = part.slice(start, CHUNK)
                    cells, n = chunk.column("cells"), chunk.column("n").to_numpy().astype(float)
                    offsets = cells.offsets.to_numpy()
                    g, t, y, w = (c.to_numpy() for c in cells.flatten().flatten())
                    log_l, grad, hess = _patient_terms(params[model], g, t, y, w, offsets[:-1] - offsets[0], nodes)
                    sums += np.concatenate([[n @ log_l], n @ grad, n @ hess])
                yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([sums.tolist()])], ["model", "sums"])

    parts = rows.where(F.col("model").isin([int(m) for m in params])).mapInArrow(compute, "model long, sums array<double>")
    summed = parts.groupBy("model").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = {}
    # One row per instrument.
    for r in summed.collect():
        sums = np.array(r["sums"])
        hess = np.zeros((SIZE, SIZE))
        hess[_UPPER] = sums[1 + SIZE:]
        out[r["model"]] = float(sums[0]), sums[1:1 + SIZE], hess + np.triu(hess, 1).T
    return out


class _Climb:
    """Damped Newton steps of one model."""

    def __init__(self, start: np.ndarray):
        self.at, self.proposal, self.step = start, start, np.zeros(SIZE)
        self.value, self.hess, self.free = -np.inf, None, np.ones(SIZE, dtype=bool)
        self.converged, self.done, self.probed, self.probing = False, False, False, False

    def take(self, value: float, grad: np.ndarray, hess: np.ndarray) -> None:
        """Go on from the evaluated proposal, or half as far where it is no better."""
        if self.probing:
            # Back to where the search ended, or on from the end of the range.
            if value < self.value - max(LOSS, 1e-11 * abs(self.value)):
                self.done = self.converged = True
                return
            self.probing, self.value = False, -np.inf
        if value < self.value - 1e-11 * abs(self.value) or not np.isfinite(value):
            self.step = self.step / 2
            if np.abs(self.step).max() < 1e-9:
                self.done = True
            self.proposal = self._held(self.at + self.step)
            return
        self.at, self.value, self.hess = self.proposal, value, hess
        low, high = np.full(SIZE, -np.inf), np.full(SIZE, np.inf)
        low[-2:], high[-2:] = zip(*LIMITS)
        # At an end of its range a parameter stays as long as the likelihood rises beyond it.
        self.free = ~(((self.at <= low) & (grad < 0)) | ((self.at >= high) & (grad > 0)))
        roots, axes = np.linalg.eigh(-hess[np.ix_(self.free, self.free)])
        bend = np.maximum(np.abs(roots), 1e-8 * np.abs(roots).max() + 1e-12)
        step = np.zeros(SIZE)
        step[self.free] = axes @ ((axes.T @ grad[self.free]) / bend)
        promise = 0.5 * float(step @ grad)
        if promise < ENOUGH and (roots > 0).all():
            if self.at[-1] > LIMITS[1][0] and self.at[-1] < np.log(NEAR_NONE) and not self.probed:
                self.probed = self.probing = True
                self.proposal = np.append(self.at[:-1], LIMITS[1][0])
                return
            self.done = self.converged = True
        self.step = step * min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-300))
        self.proposal = self._held(self.at + self.step)

    @staticmethod
    def _held(params: np.ndarray) -> np.ndarray:
        ends = np.array(LIMITS)
        return np.concatenate([params[:-2], np.clip(params[-2:], ends[:, 0], ends[:, 1])])

    def spreads(self) -> list[float]:
        """Dispersion, and deviation of the intercepts, which is 0 at the lower end of its range."""
        return [float(np.exp(self.at[-2])), float(np.exp(self.at[-1])) if self.at[-1] > LIMITS[1][0] else 0.0]

    def errors(self) -> np.ndarray:
        """Standard errors of the parameters; NaN where the information does not give them."""
        out = np.full(SIZE, np.nan)
        info = -self.hess[np.ix_(self.free, self.free)]
        if (np.linalg.eigvalsh(info) > 0).all():
            out[self.free] = np.sqrt(np.diag(np.linalg.inv(info)))
        return out


def _cell_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per model its keys, rows, patients, least score, and rows and scores per cell."""
    entries = rows.select(*by, "model", "n", F.posexplode("cells").alias("at", "c")).select(
        *by, "model", "n", "at", F.col("c._g").alias("g"), F.col("c._t").alias("t"), F.col("c._y").alias("y"), F.col("c._w").alias("w"))
    weight = F.col("n") * F.col("w")
    cell = [(g, t) for t in (0.0, 1.0) for g in (0.0, 1.0)]

    def here(g: float, t: float, v: Column) -> Column:
        return F.sum(F.when((F.col("g") == g) & (F.col("t") == t), v).otherwise(0.0))

    return entries.groupBy(*by, "model").agg(
        F.sum(weight).cast("long").alias("n_obs"), F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n_patients"), F.min("y").alias("least"),
        F.array(*[here(g, t, weight) for g, t in cell]).alias("rows"),
        F.array(*[here(g, t, weight * F.col("y")) for g, t in cell]).alias("scores"))


def start_values(rows: Sequence[float], scores: Sequence[float], theta: float = 2.0, sigma: float = 0.5) -> np.ndarray:
    """Fixed effects from the logarithms of the cell means (one half added), with given dispersion and deviation."""
    c0, i0, c1, i1 = (np.log((s + 0.5) / n) for s, n in zip(scores, rows))
    return np.array([c0, i0 - c0, c1 - c0, i1 - i0 - c1 + c0, np.log(theta), np.log(sigma)])


def _prepared(long: DataFrame, by: Sequence[str], patient: str, group: str, time: str, value: str, min_rows: int):
    """Written patterns, the models' sums and why a model cannot be fitted (or ``None``)."""
    scratch = Scratch(long.sparkSession, "mixed_counts")
    found = patterns(long, by, patient, group, time, value).withColumn("model", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    rows = scratch.write(found, "patterns")
    # One row per instrument.
    sums = _cell_sums(rows, by).collect()

    def refusal(r) -> str | None:
        if r["n_obs"] < min_rows:
            return "too few rows"
        if min(r["rows"]) == 0:
            return "empty cell"
        return "negative scores" if r["least"] < 0 else None

    return rows, sums, {r["model"]: refusal(r) for r in sums}


def nb_mixed_model(long: DataFrame, by: Sequence[str] = ("instrument",), patient: str = "patient", group: str = "group",
                   time: str = "time", value: str = "score", nodes: int = NODES, min_rows: int = 3,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """Fixed effects on the log scale per key, with dispersion, deviation of the intercepts and log-likelihood.

    Variance is mean + mean squared / ``theta``; ``sigma`` is the standard deviation of the patients' intercepts, 0 where none
    fits as well. A ``theta`` of exp(12), the end of its range, stands for Poisson counts. Scores need not be whole: factorials are gamma functions. Keys with negative scores, an empty cell or too few rows give
    ``status`` and null estimates, as do those that a limit of passes stopped (``status`` tells). Each key is one model,
    so keys are few; the rows are not: a pass reads the distinct patterns once for all keys.
    """
    by = list(by)
    rows, sums, refused = _prepared(long, by, patient, group, time, value, min_rows)
    climbs = {r["model"]: _Climb(start_values(r["rows"], r["scores"])) for r in sums if refused[r["model"]] is None}
    for _ in range(max_passes):
        waiting = {m: c.proposal for m, c in climbs.items() if not c.done}
        if not waiting:
            break
        for model, terms in _evaluate(rows, waiting, nodes).items():
            climbs[model].take(*terms)

    out = []
    for r in sums:
        climb, nan = climbs.get(r["model"]), [None] * SIZE
        fitted = climb is not None and climb.converged
        status = refused[r["model"]] or ("fitted" if fitted else "not converged")
        at = climb.at.tolist() if fitted else nan
        error = [None if np.isnan(e) else float(e) for e in climb.errors()] if fitted else nan
        for i, term in enumerate(TERMS):
            out.append((*[r[c] for c in by], term, at[i], error[i], *(climb.spreads() if fitted else (None, None)),
                        climb.value if fitted else None, r["n_obs"], r["n_patients"], status))
    kinds = dict(rows.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    made = long.sparkSession.createDataFrame(
        out, keys + "term string, estimate double, std_error double, theta double, sigma double, log_lik double, n_obs long, n_patients long, status string")
    return made.withColumn("statistic", F.try_divide("estimate", "std_error")).withColumn("p_value", z_two_sided("statistic")).select(
        *by, "term", "estimate", "std_error", "statistic", "p_value", "theta", "sigma", "log_lik", "n_obs", "n_patients", "status")


def nb_log_likelihood(long: DataFrame, theta: float, sigma: float, by: Sequence[str] = ("instrument",), patient: str = "patient",
                      group: str = "group", time: str = "time", value: str = "score", nodes: int = NODES) -> DataFrame:
    """Log-likelihood and its gradient per key where the fixed effects are those of the cell means (``start_values``)."""
    by = list(by)
    rows, sums, refused = _prepared(long, by, patient, group, time, value, 1)
    at = {r["model"]: start_values(r["rows"], r["scores"], theta, sigma) for r in sums if refused[r["model"]] is None}
    found = _evaluate(rows, at, nodes)
    out = [(*[r[c] for c in by], found[r["model"]][0], *found[r["model"]][1].tolist()) for r in sums if r["model"] in found]
    kinds = dict(rows.dtypes)
    names = ["log_lik", "d_intercept", "d_group", "d_time", "d_interaction", "d_log_theta", "d_log_sigma"]
    return long.sparkSession.createDataFrame(out, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"{c} double" for c in names]))
