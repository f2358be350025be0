import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from duowave.checks.views import Tables
from duowave.operators import (
    anova, diagnostics, effects, imputation, joins, linear, ranking, reshape, response, scoring, summary, visits,
)
from duowave.plans.skew import running_index

FOLDER = "/root/testdata/sf0.01"


# --- scoring ---

@pytest.mark.parametrize("n", [6, 12, 15, 17, 21, 22, 25, 28, 29])
def test_tolerance_counts_whole_items(spark, n):
    items = [f"i{k}" for k in range(n)]
    values = [[None] * 4 + [1.0] * (n - 4), [None] * 5 + [1.0] * (n - 5)]
    df = spark.createDataFrame(values, ", ".join(f"{c} double" for c in items))
    scored = scoring.impute_scale(df, items, "total", max_missing_count=4)
    assert sorted([r["total"] for r in scored.collect()], key=repr) == [None, float(n)] or \
        sorted([r["total"] for r in scored.collect()], key=repr) == [float(n), None]


def test_imputation_leaves_rows_beyond_tolerance(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, None, None), (None, None, None)], "a double, b double, c double")
    got = scoring.impute_scale(df, ["a", "b", "c"], "total", max_missing_prop=0.34).select("a", "b", "c", "total")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3, 6), (1, None, None, None), (None,) * 4]


def test_scale_scores(spark):
    df = spark.createDataFrame([(4.0, 5.0, 3.0, 4.0, None), (1.0, None, None, 1.0, 1.0)],
                               ", ".join(f"i{k} double" for k in range(5)))
    items = df.columns
    got = df.select(scoring.score_percent(items), scoring.score_prorated(items), scoring.score_observed(items, 1),
                    scoring.row_mean(items), scoring.row_missing(items)).collect()
    assert tuple(got[0]) == (80.0, 20.0, 16.0, 4.0, 1)
    assert tuple(got[1]) == (None, None, None, 1.0, 2)


def test_mixed_types_are_applied_column_by_column(spark):
    df = spark.createDataFrame([("1", 2)], "a string, b int")
    assert rows(scoring.apply_across(df, ["a", "b"], lambda c: c.cast("double") * 2)) == [(2.0, 4.0)]


# --- visits ---

def visit_rows(spark):
    day = dt.datetime
    data = [
        ("a", day(2024, 1, 3), 1, 30.0), ("a", day(2024, 1, 1), 2, 10.0), ("a", day(2024, 1, 2), 3, None),
        ("b", day(2024, 1, 1), 4, 5.0), ("b", day(2024, 1, 1), 5, 6.0), ("b", None, 6, 7.0),
        ("c", day(2024, 1, 1), 7, 1.0), ("d", None, 8, 1.0), ("d", None, 9, 2.0),
    ]
    return spark.createDataFrame(data, "patient string, when_dt timestamp_ntz, tie long, score double")


def test_first_and_last_visit(spark):
    got = visits.add_pre_post(visit_rows(spark), ["patient"], "when_dt", "tie")
    assert rows(got, "patient", "time", "tie") == [("a", "post", 1), ("a", "pre", 2), ("b", "post", 5), ("b", "pre", 4)]
    fused = visits.pre_post_pairs(visit_rows(spark), ["patient"], "when_dt", "tie")
    assert rows(fused) == [("a", 10.0, 30.0, 20.0), ("b", 5.0, 6.0, 1.0)]


def test_pairs_are_chosen_before_scores_are_seen(spark):
    df = visit_rows(spark).withColumn("score", F.when(F.col("tie") != 1, F.col("score")))
    got = visits.pre_post_pairs(df, ["patient"], "when_dt", "tie")
    assert ("a", 10.0, None, None) in rows(got)


@pytest.mark.parametrize("parts", [1, 7])
def test_visits_do_not_depend_on_partitions(spark, parts):
    t = Tables(spark, FOLDER)
    keys = ["patient", "instrument"]
    base = visits.pre_post_pairs(t["fx_visits"], keys, "when_dt", "tie")
    moved = visits.pre_post_pairs(t["fx_visits"].repartition(parts, F.rand(3)), keys, "when_dt", "tie")
    assert rows(base) == rows(moved)


def test_baseline_and_latest_rows(spark):
    first = visits.baseline_row(visit_rows(spark), ["patient"], "when_dt", "tie")
    assert rows(first, "patient", "tie") == [("a", 2), ("b", 4), ("c", 7), ("d", 8)]
    last = visits.latest_per_cell(visit_rows(spark), ["patient"], "when_dt", "tie")
    assert rows(last, "patient", "tie") == [("a", 1), ("b", 5), ("c", 7), ("d", 9)]


def test_row_order_stands_in_for_missing_times(spark):
    df = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("b", 4, None)], "patient string, seq long, authored string")
    got = visits.get_when(df, "seq")
    assert sorted((r.patient, r.seq, r.when_dt.second) for r in got.collect()) == [("a", 3, 1), ("a", 5, 2), ("b", 4, 1)]
    assert visits.get_when(df.drop("authored"), "seq").count() == 3


def test_first_parsed_candidate_wins(spark):
    df = spark.createDataFrame([("a", 1, "?", "02.01.2024"), ("b", 2, "2024-05-01", None)],
                               "patient string, seq long, authored string, datum string")
    assert [r.when_dt.month for r in visits.get_when(df, "seq").orderBy("patient").collect()] == [1, 5]


def test_numbering_splits_hot_keys(spark):
    # One key holds a third of the rows, another is NULL.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(40)).alias("at"), F.col("id").alias("tie"))
    plain = running_index(df, ["k"], ["at", "tie"], "n")
    split = running_index(df, ["k"], ["at", "tie"], "n", max_rows=100, bucket_rows=90)
    assert rows(plain) == rows(split)


# --- reshape, joins, ranking ---

def test_merge_completes_group_and_drops_rows_without(spark):
    a = spark.createDataFrame([("p", None, 1.0), ("q", "Control", 2.0)], "patient string, group string, x double")
    b = spark.createDataFrame([("q", 5.0), ("r", 6.0)], "patient string, y double")
    dim = spark.createDataFrame([("p", "Intervention")], "patient_id string, group string")
    got = joins.full_outer_merge([a, b], "patient", dim)
    assert rows(got, "patient", "group", "x", "y") == [("p", "Intervention", 1.0, None), ("q", "Control", 2.0, 5.0)]


def test_rows_without_key_survive_exclusion(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(joins.anti_not_in(df, spark.createDataFrame([("a",)], "k string"), ["k"])) == [(None,)]


def test_top_changes_with_and_without_ties(spark):
    df = spark.createDataFrame([("z", "a", 9.0), ("z", "b", -9.0), ("z", "c", 9.0), ("z", "d", 1.0), ("z", "e", None)],
                               "instrument string, patient string, change double")
    assert rows(ranking.top_changes_ties(df, 2), "patient") == [("a",), ("b",), ("c",)]
    assert rows(ranking.top_changes_n(df, 2), "patient") == [("a",), ("b",)]
    assert [r.patient for r in ranking.rank_changes(df).collect()] == ["a", "b", "c", "d", "e"]


def test_empty_results_keep_their_schema(spark):
    schema = spark.createDataFrame([], "instrument string, p double").schema
    empty = reshape.bind_results([], spark, schema)
    assert empty.schema == schema and empty.count() == 0


# --- statistics ---

def ols(x, y):
    """Plain least squares for comparison: coefficients, standard errors, residual degrees of freedom."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    dof = len(y) - x.shape[1]
    return beta, np.sqrt(rest @ rest / dof * np.diag(np.linalg.inv(x.T @ x))), dof


def baseline(spark):
    return Tables(spark, FOLDER)["fx_baseline"]


def test_anova_known_answer(spark):
    t = Tables(spark, FOLDER)
    patients = spark.sql(
        "SELECT user_id AS patient_id, CASE WHEN user_id % 7 <> 0 AND user_id % 2 = 0 THEN 'Intervention' ELSE 'Control' END AS group "
        "FROM (SELECT DISTINCT user_id FROM {events}) u WHERE user_id % 29 <> 0", events=t["events"])
    pairs = joins.join_group(visits.pre_post_pairs(t["fx_visits"], ["patient", "instrument"], "when_dt", "tie"), patients)
    got = {(r.instrument, r.effect): r for r in anova.mixed_anova(pairs).collect()}
    known = {"click": (113, 0.045082, 2.836537, 0.027681, 0.000249), "error": (116, 0.101239, 1.272545, 1.150993, 0.009996),
             "purchase": (113, 1.023774, 0.626016, 0.025690, 0.000231), "signup": (121, 2.546992, 0.001677, 0.106548, 0.000895),
             "view": (120, 2.118170, 0.173667, 0.017215, 0.000146)}
    for name, (n, f_group, f_time, f_both, eta) in known.items():
        assert got[name, "group"].df2 == n - 2
        assert got[name, "group"].f_value == pytest.approx(f_group, abs=1e-6)
        assert got[name, "time"].f_value == pytest.approx(f_time, abs=1e-6)
        assert got[name, "group:time"].f_value == pytest.approx(f_both, abs=1e-6)
        assert got[name, "group:time"].pes == pytest.approx(eta, abs=1e-6)


def test_interaction_equals_squared_t_of_change(spark):
    b = baseline(spark).select(F.lit("s").alias("instrument"), "patient", F.col("grp").alias("group"),
                               F.col("score_pre").alias("pre"), F.col("score_post").alias("post"))
    f = anova.mixed_anova(b).where("effect = 'group:time'").first()
    fit = imputation.mi_delta_fit(b.withColumn("imp", F.lit(1))).first()
    assert f.f_value == pytest.approx(fit.estimate ** 2 / fit.variance, rel=1e-9)


def test_design_that_is_too_small_gives_no_rows(spark):
    one_group = spark.createDataFrame([("s", f"p{i}", "Control", float(i), i * 2.0) for i in range(5)],
                                      "instrument string, patient string, group string, pre double, post double")
    assert anova.mixed_anova(one_group).count() == 0
    two = spark.createDataFrame([("s", "a", "Control", 1.0, 2.0), ("s", "b", "Intervention", 1.0, 2.0)], one_group.schema)
    assert anova.mixed_anova(two).count() == 0


def complete(spark, *extra):
    cols = ["grp", "score_pre", "score_post", *extra]
    return baseline(spark).select(*cols).dropna().toPandas()


def test_numeric_moderator_is_the_ols_interaction(spark):
    p = complete(spark, "acctbal")
    g = (p.grp == "Intervention").to_numpy(float)
    x = np.column_stack([np.ones(len(p)), p.score_pre, g, p.acctbal, g * p.acctbal])
    beta, se, dof = ols(x, p.score_post.to_numpy())
    got = linear.moderator_numeric(baseline(spark), ["acctbal"], "score_pre", "score_post", "grp").first()
    assert (got.estimate, got.std_error, got.dof) == (pytest.approx(beta[4]), pytest.approx(se[4]), dof)
    frame = baseline(spark).withColumn("g", F.when(F.col("grp") == "Intervention", 1.0).otherwise(0.0)).withColumn(
        "gp", F.col("g") * F.col("acctbal"))
    full = {r.term: r for r in linear.ols_moments(frame, "score_post", ["score_pre", "g", "acctbal", "gp"]).collect()}
    for i, term in enumerate(["(Intercept)", "score_pre", "g", "acctbal", "gp"]):
        assert full[term].estimate == pytest.approx(beta[i], rel=1e-6)
        assert full[term].std_error == pytest.approx(se[i], rel=1e-6)


def test_factor_moderator_is_the_ols_interaction(spark):
    p = complete(spark, "segment")
    g = (p.grp == "Intervention").to_numpy(float)
    levels = sorted(p.segment.unique())
    dummies = [(p.segment == v).to_numpy(float) for v in levels[1:]]
    x = np.column_stack([np.ones(len(p)), p.score_pre, g, *dummies, *[g * d for d in dummies]])
    beta, se, dof = ols(x, p.score_post.to_numpy())
    got = {r.term: r for r in
           linear.moderator_factor(baseline(spark), ["segment"], "score_pre", "score_post", "grp").collect()}
    for i, level in enumerate(levels[1:]):
        r = got[f"groupIntervention:segment{level}"]
        at = 3 + len(dummies) + i
        assert (r.estimate, r.std_error, r.dof) == (pytest.approx(beta[at]), pytest.approx(se[at]), dof)


def test_reference_level_can_be_chosen(spark):
    got = linear.uni_lm_factor(baseline(spark), ["score_pre"], ["segment"], refs={"segment": "MACHINERY"})
    terms = {r.term for r in got.collect()}
    assert len(terms) == 4 and "segmentMACHINERY" not in terms


def test_constant_predictor_has_no_estimate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    got = linear.uni_lm_numeric(df, ["y"], ["x"]).first()
    assert (got.estimate, got.p_value, got.n_obs) == (None, None, 3)


def test_empty_cell_gives_no_interaction(spark):
    data = [("Control", "a", 1.0, 2.0), ("Control", "b", 2.0, 1.0), ("Intervention", "a", 3.0, 5.0),
            ("Control", "a", 4.0, 2.5), ("Intervention", "a", 0.0, 1.0), ("Control", "b", 7.0, 3.0)]
    df = spark.createDataFrame(data, "group string, p string, pre double, post double")
    got = linear.moderator_factor(df, ["p"], "pre", "post").collect()
    assert [(r.term, r.estimate) for r in got] == [("groupIntervention:pb", None)]


def test_effect_sizes_need_spread(spark):
    df = spark.createDataFrame([("s", "Control", 1.0), ("s", "Control", 1.0), ("s", "Intervention", 2.0)],
                               "instrument string, group string, change double")
    assert [r.dz for r in effects.effect_dz(df).collect()] == [None, None]
    assert effects.effect_hedges_g(df).first().g is None


def test_group_size_may_count_unknown_changes(spark):
    df = spark.createDataFrame([("s", "Control", 1.0), ("s", "Control", 3.0), ("s", "Control", None),
                                ("s", "Intervention", 2.0), ("s", "Intervention", 5.0)],
                               "instrument string, group string, change double")
    assert effects.effect_hedges_g(df).first().n_c == 2
    assert effects.effect_hedges_g(df, n_mode="all").first().n_c == 3


def test_residual_moments_match_row_residuals(spark):
    t = Tables(spark, FOLDER)
    long = visits.add_pre_post(t["fx_visits"], ["patient", "instrument"], "when_dt", "tie").withColumn(
        "group", F.when(F.col("patient") % 2 == 0, "Control").otherwise("Intervention"))
    got = {r.instrument: r for r in diagnostics.residual_diagnostics(long).collect()}
    res = diagnostics.cell_residual(long).toPandas()
    for name, part in res.groupby("instrument"):
        e = part.residual.to_numpy()
        skew, kurt = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2 - 3
        assert got[name].jb == pytest.approx(len(e) / 6 * (skew**2 + kurt**2 / 4))
        assert got[name].n_resid == len(e) <= got[name].n_obs


def test_regression_imputation_keeps_rows_without_group(spark):
    df = spark.createDataFrame([("Control", 2.0), ("Control", None), ("Control", 4.0), (None, None)], "group string, s double")
    assert rows(imputation.regression_impute(df, "s"), "group", "total_imp") == [
        ("Control", 2.0), ("Control", 3.0), ("Control", 4.0), (None, None)]


def test_empty_cell_has_no_odds_ratio(spark):
    df = spark.createDataFrame([("s", "Control", True), ("s", "Control", False), ("s", "Intervention", True)],
                               "instrument string, group string, responder boolean")
    got = {r.term: r.estimate for r in response.logit_or(df).collect()}
    assert got["groupIntervention"] is None and got["(Intercept)"] == 0.0


def test_pooling_without_spread_between_copies(spark):
    fits = spark.createDataFrame([(i, "s", 2.0, 4.0, 10) for i in range(5)],
                                 "imp int, instrument string, estimate double, variance double, dof long")
    got = imputation.rubin_pool(fits).first()
    assert (got.estimate, got.std_error) == (2.0, 2.0)
    assert got.dof == pytest.approx(11 / 13 * 10)


# --- summaries ---

def test_exact_median_by_bracket_and_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(50, 9, 4001), np.full(2000, 44.0)])
    df = spark.createDataFrame([(float(v), float(i % 5)) for i, v in enumerate(values)], "a double, b double")
    monkeypatch.setattr(summary, "MEDIAN_BUCKET", 40)
    monkeypatch.setattr(summary, "MEDIAN_ACCURACY", 100)
    got = summary.exact_medians(df, ["a", "b"])
    assert got == {"a": float(np.median(values)), "b": 2.0}
    even = df.where("a <> 44").limit(4000)
    assert summary.exact_medians(even, ["a"])["a"] == even.toPandas().a.median()


def test_age_column_choice(spark):
    df = spark.createDataFrame([(1, "30", "x", 30.0, 5.0), (2, "40", "41", 45.0, 5.0), (3, None, "3", None, 5.0)],
                               "id int, alter_text string, age_mixed string, alter_num double, birth_const double")
    assert summary.pick_plausible_column(df) == "alter_num"
    assert summary.pick_plausible_column(df.select("id")) is None


def test_sex_column_search(spark):
    df = spark.createDataFrame([("weiß", "Frau Müller", "x", "Weiblich"), (None, "w-lan", "", None)],
                               "a string, b string, c string, d string")
    assert summary.find_column_by_token(df.select("a", "c", "d")) == "d"
    assert summary.find_column_by_token(df.select("a", "c")) is None
    assert summary.find_column_by_token(df) == "b"


def test_baseline_lines_for_absent_levels(spark):
    df = spark.createDataFrame([("Control", "a", 1.0), ("Control", None, None), ("Intervention", "b", 3.0), (None, "a", 9.0)],
                               "group string, c string, x double")
    got = {(r.variable, r.level, r.group): r for r in summary.baseline_table(df, ["x"], {"c": ["a", "b"]}).collect()}
    assert len(got) == 6
    assert (got["c", "a", "Control"].n, got["c", "a", "Control"].pct, got["c", "a", "Control"].n_missing) == (1, 100.0, 1)
    assert (got["c", "b", "Control"].n, got["c", "b", "Control"].pct) == (0, 0.0)
    assert (got["x", None, "Control"].n, got["x", None, "Control"].n_missing, got["x", None, "Control"].n_overall) == (1, 1, 2)


def test_frames_by_value_read_one_written_table(spark):
    df = spark.createDataFrame([("a/b", 1), ("c", 2), (None, 3), ("c", 4)], "kind string, x int")
    frames = reshape.frames_by(df, "kind")
    assert {k: sorted(r["x"] for r in v.collect()) for k, v in frames.items()} == {"a/b": [1], "c": [2, 4]}
    assert "PartitionFilters: [isnotnull(kind" in frames["c"]._jdf.queryExecution().executedPlan().toString()
    assert reshape.frames_by(df.limit(0), "kind") == {}
