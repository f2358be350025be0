"""Models that take more than moments: normality of residuals, counts with random intercepts, elastic net."""

import hashlib
import math
import random
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from duowave.functions import gamma
from duowave.operators import diagnostics, elastic_net, mixed_counts


# --- helpers of gamma and normal distributions ---


@pytest.mark.parametrize("a", [0.01, 0.7, 3.0, 80.0, 1e6])
def test_rising_factorials(a):
    for y in (0.0, 0.5, 1.0, 7.0, 400.0):
        want = math.lgamma(a + y) - math.lgamma(a)
        assert gamma.log_rising(np.array(a), np.array(y)) == pytest.approx(want, rel=1e-9, abs=1e-8 * max(1.0, math.lgamma(a + 1)))
        if y == int(y):
            steps = [a + j for j in range(int(y))]
            assert gamma.digamma_rising(np.array(a), np.array(y)) == pytest.approx(math.fsum(1 / s for s in steps), rel=1e-11, abs=1e-14)
            assert gamma.trigamma_rising(np.array(a), np.array(y)) == pytest.approx(-math.fsum(1 / s**2 for s in steps), rel=1e-9, abs=1e-14)


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.6, 0.925, 0.9999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(gamma.normal_quantile(F.col("p"))).collect()
    for p, (x,) in zip(ps, got):
        want = NormalDist().inv_cdf(p)
        assert x == pytest.approx(want, rel=1e-9, abs=1e-12)


# --- Shapiro-Wilk ---


def _shapiro_brute(values):
    """Statistic and p-value by weights for every value (algorithm AS R94)."""
    x, n = sorted(values), len(values)
    if n < 3 or x[0] == x[-1]:
        return None, None
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)

    def poly(c, v):
        return sum(k * v**i for i, k in enumerate(c))

    a = [0.0] * n
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        a[-1] = poly(diagnostics.LARGEST, n**-0.5) + m[-1] / math.sqrt(mm)
        two = 1
        if n > 5:
            a[-2], two = poly(diagnostics.SECOND, n**-0.5) + m[-2] / math.sqrt(mm), 2
        rest = (mm - 2 * sum(v * v for v in m[-two:])) / (1 - 2 * sum(v * v for v in a[-two:]))
        for i in range(two, n - two):
            a[i] = m[i] / math.sqrt(rest)
        a[1] = -a[-2] if n > 5 else a[1]
    a[0] = -a[-1]
    mean = sum(x) / n
    w = sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    rest = math.log(1 - w)
    if n <= 11:
        if rest >= poly(diagnostics.FEW_BOUND, n):
            return w, 1e-99
        z = (-math.log(poly(diagnostics.FEW_BOUND, n) - rest) - poly(diagnostics.FEW_MEAN, n)) / math.exp(poly(diagnostics.FEW_SPREAD, n))
    else:
        z = (rest - poly(diagnostics.MANY_MEAN, math.log(n))) / math.exp(poly(diagnostics.MANY_SPREAD, math.log(n)))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


@pytest.fixture(scope="module")
def residual_rows():
    rng = random.Random(4)
    rows = []
    for name, n in {"three": 3, "four": 4, "five": 5, "six": 6, "eleven": 11, "twelve": 12, "many": 900, "two": 2, "one": 1}.items():
        for i in range(n):
            rows.append((name, "g", rng.choice(["pre", "post"]) if n > 20 else "pre", rng.gauss(0, 1) ** 3 if n > 100 else float(rng.randint(0, 9)) + i))
    rows += [("ties", "g", "pre", float(rng.randint(0, 3))) for _ in range(200)]
    rows += [("flat", "g", "pre", 5.0)] * 8 + [("nulls", "g", None, 1.0), ("nulls", None, "pre", 2.0), ("nulls", "g", "pre", None), (None, "g", "pre", 1.0)]
    # A published example.
    rows += [("weights", "g", "pre", v) for v in (148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0)]
    return rows


def test_shapiro_wilk(spark, residual_rows):
    df = spark.createDataFrame(residual_rows, "instrument string, group string, time string, score double").repartition(4)
    df = df.selectExpr("*", "1 AS _n", "2 AS n")
    cells = defaultdict(list)
    for name, group, time, score in residual_rows:
        if None not in (name, group, time, score):
            cells[name, time].append(score)
    residuals = defaultdict(list)
    for (name, _), scores in cells.items():
        residuals[name] += [s - sum(scores) / len(scores) for s in scores]
    got = {r["instrument"]: r for r in diagnostics.shapiro_wilk(df).collect()}
    assert set(got) == {r[0] for r in residual_rows}
    for name, row in got.items():
        w, p = _shapiro_brute(residuals[name])
        assert row["n_resid"] == len(residuals[name]) and row["n_obs"] == sum(r[0] == name for r in residual_rows)
        if w is None or name == "flat":
            assert row["w"] is None and row["p_value"] is None
        else:
            assert (row["w"], row["p_value"]) == pytest.approx((w, p), rel=1e-8)
    assert (got["weights"]["w"], got["weights"]["p_value"]) == pytest.approx((0.78881, 0.006704), rel=1e-4)
    # Cut into ranges, as instruments with very many rows are, the result is the same.
    cut = {r["instrument"]: r for r in diagnostics.shapiro_wilk(df, max_rows=10, bucket_rows=37).collect()}
    assert all((cut[k]["w"] is None) == (r["w"] is None) and (r["w"] is None or cut[k]["w"] == pytest.approx(r["w"], rel=1e-10)) for k, r in got.items())
    assert diagnostics.shapiro_wilk(df.limit(0)).count() == 0


def test_shapiro_wilk_beyond_five_thousand(spark):
    rng = random.Random(9)
    normal = [("normal", "g", "pre", rng.gauss(10, 3)) for _ in range(20_000)]
    skewed = [("skewed", "g", "pre", rng.expovariate(1)) for _ in range(20_000)]
    df = spark.createDataFrame(normal + skewed, "instrument string, group string, time string, score double")
    got = {r["instrument"]: r for r in diagnostics.shapiro_wilk(df).collect()}
    assert got["normal"]["p_value"] > 0.01 and got["skewed"]["p_value"] < 1e-9 and got["normal"]["n_resid"] == 20_000


# --- counts with random intercepts ---


def _simulated(people, seed, beta=(2.0, 0.3, -0.4, 0.25), theta=4.0, sigma=0.6, name="a"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(people):
        g, b = i % 2, rng.normal(0, sigma)
        for t in (0, 1):
            mu = math.exp(beta[0] + beta[1] * g + beta[2] * t + beta[3] * g * t + b)
            rows.append((name, i, "Intervention" if g else "Control", "post" if t else "pre", float(rng.poisson(mu * rng.gamma(theta, 1 / theta)))))
    return rows


LONG = "instrument string, patient long, group string, time string, score double"


def _log_lik_brute(rows, params):
    """Sum over patients of the integral over the intercept on a fine grid."""
    theta, sigma = math.exp(params[4]), math.exp(params[5])
    b = np.linspace(-9, 9, 1201) * sigma
    people = defaultdict(list)
    for _, who, group, time, y in rows:
        people[who].append((float(group == "Intervention"), float(time == "post"), y))
    total = 0.0
    for visits in people.values():
        f = -0.5 * (b / sigma) ** 2 - math.log(sigma) - 0.5 * math.log(2 * math.pi)
        for g, t, y in visits:
            mu = np.exp(params[0] + params[1] * g + params[2] * t + params[3] * g * t + b)
            f = f + math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) - theta * np.log1p(mu / theta) + y * np.log(mu / (theta + mu))
        top = f.max()
        total += top + math.log(np.exp(f - top).sum() * (b[1] - b[0]))
    return total


def test_mixed_counts_maximise_the_likelihood(spark):
    rows = _simulated(60, 1)
    noise = [("a", 900, "Control", "pre", 3.0), ("a", None, "Control", "pre", 3.0), ("a", 5, "Control", "pre", None), ("a", 6, None, "pre", 9.0)]
    refused = [("neg", i, g, t, -1.0) for i, g in ((1, "Control"), (2, "Intervention")) for t in ("pre", "post")]
    refused += [("cell", i, "Control", t, 2.0) for i in (1, 2, 3) for t in ("pre", "post")]
    df = spark.createDataFrame(rows + noise + refused, LONG).selectExpr("*", "1 AS n", "2 AS model", "3 AS cells").repartition(5)
    got = mixed_counts.nb_mixed_model(df, nodes=21).collect()
    status = {r["instrument"]: r["status"] for r in got}
    assert status == {"a": "fitted", "neg": "negative scores", "cell": "empty cell"}
    assert all(r["estimate"] is None and r["p_value"] is None for r in got if r["instrument"] != "a")
    fit = {r["term"]: r for r in got if r["instrument"] == "a"}
    assert list(fit) == list(mixed_counts.TERMS)
    first = fit["(Intercept)"]
    assert first["n_obs"] == len(rows) and first["n_patients"] == 60
    params = np.array([fit[t]["estimate"] for t in mixed_counts.TERMS] + [math.log(first["theta"]), math.log(first["sigma"])])
    assert first["log_lik"] == pytest.approx(_log_lik_brute(rows, params), abs=1e-6)
    step = 1e-4 * np.eye(6)
    slopes = [(_log_lik_brute(rows, params + e) - _log_lik_brute(rows, params - e)) / 2e-4 for e in step]
    assert np.abs(slopes).max() < 1e-3
    info = -np.array([[(_log_lik_brute(rows, params + 10 * (e + f)) - _log_lik_brute(rows, params + 10 * (e - f)) - _log_lik_brute(rows, params - 10 * (e - f))
                        + _log_lik_brute(rows, params - 10 * (e + f))) / 4e-6 for e in step] for f in step])
    errors = np.sqrt(np.diag(np.linalg.inv(info)))[:4]
    assert [fit[t]["std_error"] for t in mixed_counts.TERMS] == pytest.approx(errors.tolist(), rel=1e-3)
    z = fit["timepost"]["estimate"] / fit["timepost"]["std_error"]
    assert fit["timepost"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert mixed_counts.nb_mixed_model(df.limit(0)).count() == 0


def test_mixed_counts_recover_parameters_of_several_models(spark):
    df = spark.createDataFrame(_simulated(6000, 2, name="a") + _simulated(6000, 3, (1.0, 0.0, 0.5, -0.3), 2.0, 0.4, "b"), LONG)
    got = defaultdict(dict)
    for r in mixed_counts.nb_mixed_model(df).collect():
        got[r["instrument"]][r["term"]] = r
    for name, beta, theta, sigma in (("a", (2.0, 0.3, -0.4, 0.25), 4.0, 0.6), ("b", (1.0, 0.0, 0.5, -0.3), 2.0, 0.4)):
        for term, want in zip(mixed_counts.TERMS, beta):
            row = got[name][term]
            assert abs(row["estimate"] - want) < 4 * row["std_error"] and row["status"] == "fitted"
        assert got[name]["timepost"]["theta"] == pytest.approx(theta, rel=0.15) and got[name]["timepost"]["sigma"] == pytest.approx(sigma, rel=0.15)
    # Equal visits of different patients are one row.
    assert mixed_counts.patterns(df).count() < 0.6 * 12000


def test_mixed_counts_without_variation_between_patients(spark):
    rng = np.random.default_rng(8)
    rows = [("p", i, "Intervention" if i % 2 else "Control", t, float(rng.poisson(5))) for i in range(400) for t in ("pre", "post")]
    got = mixed_counts.nb_mixed_model(spark.createDataFrame(rows, LONG)).collect()
    # Poisson counts: the dispersion goes to the end of its range, or the deviation to that of its.
    assert {r["status"] for r in got} == {"fitted"} and got[0]["sigma"] < 0.15 and got[0]["theta"] > 20
    assert got[0]["estimate"] == pytest.approx(math.log(5), abs=0.1)


# --- elastic net ---


def _net_brute(x, y, lam, mix, weight):
    """Coordinate descent on rows; intercept and slopes."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0)
    beta, rest = np.zeros(x.shape[1]), y - y.mean()
    for _ in range(20000):
        moved = 0.0
        for j in range(x.shape[1]):
            if sd[j] == 0:
                continue
            pull = z[:, j] @ rest / len(y) + beta[j]
            new = np.sign(pull) * max(abs(pull) - lam * mix * weight[j], 0) / (1 + lam * (1 - mix) * weight[j])
            rest -= z[:, j] * (new - beta[j])
            moved, beta[j] = max(moved, abs(new - beta[j])), new
        if moved < 1e-12:
            break
    slopes = np.divide(beta, sd, out=np.zeros_like(beta), where=sd > 0)
    return y.mean() - slopes @ mean, slopes


def _people(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 1000, 5, 0]
    x[:, 3] = x[:, 0] * 0.9 + x[:, 3] * 0.2
    y = 3 + 2 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=n)
    return [(int(i), *map(float, r), 7.0, float(v)) for i, (r, v) in enumerate(zip(x, y))]


NET = "patient long, a double, b double, c double, d double, flat double, y double"
COLUMNS = ["a", "b", "c", "d", "flat"]


@pytest.mark.parametrize("mix, free", [(0.5, []), (1.0, ["a"]), (0.2, ["a", "c"])])
def test_elastic_net_equals_descent_on_rows(spark, mix, free):
    people = _people(120, 3)
    rows = [("k", *r) for r in people] + [(None, *r) for r in _people(40, 5)] + [("k", 900, 1.0, None, 1.0, 1.0, 7.0, 1.0), ("k", 901, 1.0, 1.0, 1.0, 1.0, 7.0, float("nan"))]
    df = spark.createDataFrame(rows, "key string, " + NET).selectExpr("*", "1 AS model", "2 AS fold", "3 AS x").repartition(4)
    path = elastic_net.elastic_net(df, "y", COLUMNS, ["key"], mix=mix, free=free, folds=4, lambdas=6).orderBy("key", F.desc("share")).collect()
    assert [r["key"] for r in path] == [None] * 6 + ["k"] * 6
    x, y = np.array([r[1:6] for r in people]), np.array([r[6] for r in people])
    weight = np.array([0.0 if c in free else 1.0 for c in COLUMNS])
    mine = [r for r in path if r["key"] == "k"]
    assert mine[0]["n_nonzero"] == len(free) and mine[0]["n_obs"] == 120 and mine[-1]["n_nonzero"] >= 2
    fold = np.array([int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % 4 for r in people])
    for r in mine:
        intercept, slopes = _net_brute(x, y, r["penalty"], mix, weight)
        assert r["betas"] == pytest.approx(slopes.tolist(), abs=1e-6) and r["intercept"] == pytest.approx(intercept, abs=1e-4)
        sse = []
        for k in range(4):
            i, b = _net_brute(x[fold != k], y[fold != k], r["penalty"], mix, weight)
            sse.append(float(((y[fold == k] - i - x[fold == k] @ b) ** 2).sum()))
        assert r["fold_sse"] == pytest.approx(sse, rel=1e-5) and r["cv_error"] == pytest.approx(sum(sse) / 120, rel=1e-6)
        # Subgradient conditions: the pull on a column is its penalty, or within it where the column is left out.
        spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        pull = ((x - x.mean(axis=0)) / spread).T @ (y - r["intercept"] - x @ np.array(r["betas"])) / len(y)
        scaled = np.array(r["betas"]) * spread
        due = weight * r["penalty"] * (mix * np.sign(scaled) + (1 - mix) * scaled)
        assert np.abs((pull - due)[scaled != 0]).max(initial=0.0) < 1e-6
        assert (np.abs(pull)[scaled == 0] <= weight[scaled == 0] * r["penalty"] * mix + 1e-6).all()
    errors = [r["cv_error"] for r in mine]
    best = int(np.argmin(errors))
    assert [r["is_min"] for r in mine] == [i == best for i in range(6)]
    one = next(i for i in range(6) if errors[i] <= errors[best] + mine[best]["cv_se"])
    assert [r["is_1se"] for r in mine] == [i == one for i in range(6)]


def test_elastic_net_small_tables(spark):
    df = spark.createDataFrame(_people(30, 4), NET)
    one = elastic_net.elastic_net(df, "y", COLUMNS, folds=1, lambdas=3).collect()
    assert all(r["cv_error"] is None and not r["is_min"] and not r["is_1se"] for r in one)
    assert elastic_net.elastic_net(df.limit(0), "y", COLUMNS).count() == 0
    terms = elastic_net.net_coefficients(elastic_net.elastic_net(df, "y", COLUMNS, folds=3), COLUMNS, rule="is_min").collect()
    assert [r["term"] for r in terms] == ["(Intercept)", *COLUMNS]


def test_moderators_are_found(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        arm, pre, age, hours = int(rng.integers(2)), rng.normal(40, 8), rng.normal(60, 10), rng.normal(20, 5)
        site = rng.choice(["x", "y", "z"])
        post = 5 + 0.8 * pre - 4 * arm + 0.3 * arm * (age - 60) + 2 * (site == "y") + rng.normal(0, 2)
        rows.append((i, "Intervention" if arm else "Control", pre, age, hours, None if i % 50 == 0 else str(site), post))
    rows.append((9999, None, 1.0, 1.0, 1.0, "x", 1.0))
    df = spark.createDataFrame(rows, "patient long, group string, pre double, age double, hours double, site string, post double")
    path, terms = elastic_net.moderator_net(df, ["age", "hours"], ["site"], "pre", "post")
    assert terms[:2] == ["pre", "groupIntervention"] and "groupIntervention:sitez" in terms and len(terms) == 10
    got = {r["term"]: r["estimate"] for r in elastic_net.net_coefficients(path, terms).collect()}
    assert got["groupIntervention:age"] > 0.15 and got["pre"] == pytest.approx(0.8, abs=0.05) and got["sitey"] > 0.5
    assert abs(got["groupIntervention:hours"]) < 0.05
    wide = df.withColumn("site", F.col("patient").cast("string"))
    with pytest.raises(ValueError):
        elastic_net.moderator_net(wide, ["age"], ["site"], "pre", "post")
