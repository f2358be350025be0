import pytest
from pyspark.sql import functions as F

from duowave.checks.studies import study
from duowave.checks.views import Tables
from duowave.operators import visits
from duowave.plans.instruments import BURDEN, DEPRESSION, FATIGUE, WELLBEING, score_form
from duowave.plans.study import read_study

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def made(tables):
    return study(tables)


def test_outcomes_have_two_visits_per_patient(made):
    counts = made.long.groupBy("instrument", "patient").agg(
        F.count("*").alias("n"), F.count_distinct("time").alias("t"),
        (F.max_by("when_dt", F.col("time") == "post") >= F.min_by("when_dt", F.col("time") == "post")).alias("ordered"))
    assert counts.where("n <> 2 or t <> 2 or not ordered").count() == 0
    assert made.long.select("instrument").distinct().count() == 3


def test_instrument_without_items_is_skipped(tables):
    assert score_form(tables["fx_items"], FATIGUE) is None
    with pytest.raises(ValueError):
        score_form(tables["fx_items"], DEPRESSION)


def test_raw_score_ignores_filled_items(tables):
    got = score_form(tables["fx_items"], BURDEN).select("score_raw", "score_imp", "score")
    assert got.where("score_imp > score_raw").count() > 0
    assert got.where("score <> coalesce(score_imp, score_raw)").count() == 0


def test_reports_are_written_and_read_back(spark, made, tmp_path):
    names = made.write_reports(str(tmp_path), m=2, rounds=1)
    tables = {n: spark.read.option("header", True).csv(f"{tmp_path}/{n}") for n in names}
    assert all(t.count() > 0 for t in tables.values())
    assert tables["anova"].count() == 9
    assert tables["outlier_sensitivity"].select("model").distinct().count() == 2
    assert tables["imputed_effects"].count() == 3
    assert tables["residual_shapiro"].where("w > 0 and w <= 1").count() == 3
    assert tables["count_models"].where("status = 'fitted'").count() == 12
    assert tables["moderator_net"].where("term = 'groupIntervention'").count() == 1
    assert tables["moderators"].where("not term rlike '^group.*:'").count() == 0
    assert spark.read.parquet(f"{tmp_path}/wide_scales").columns == [
        "patient", "who5_pre", "who5_post", "bdi_pre", "bdi_post", "zbi_pre", "zbi_post", "group"]
    # The forest lists every univariate model of the report in order of its estimate.
    forest = tables["forest"].where("model = 'Baseline ZBI (univariate)'")
    assert [int(r.label_order) for r in forest.orderBy(F.col("estimate").cast("double")).collect()] == list(
        range(1, forest.count() + 1))


def test_study_from_exports(spark, tables, made, tmp_path):
    for name, view in (("people", "fx_people"), ("zbi", "fx_items"), ("who5", "fx_wellbeing"), ("bdi", "fx_depression"),
                       ("crf", "fx_case_form")):
        rows = tables[view].drop("tie") if view != "fx_people" else tables[view]
        order = "patient_id" if view == "fx_people" else tables[view].columns[2] if view != "fx_case_form" else "patient"
        ordered = tables[view].orderBy(order) if order in tables[view].columns else tables[view]
        ordered.select(*rows.columns).coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}")
    again = read_study(spark, f"{tmp_path}/people", {"ZBI": f"{tmp_path}/zbi", "WHO-5": f"{tmp_path}/who5",
                                                     "BDI-II": f"{tmp_path}/bdi"}, f"{tmp_path}/crf")

    def table(s):
        return sorted(map(tuple, s.pairs.select("patient", "instrument", "group", "pre", "post").collect()), key=repr)

    assert table(again) == table(made)


def test_effects_use_imputed_scores(made):
    pairs = made.regression_imputed_pairs()
    assert pairs.where("pre is null or post is null").count() == 0
    assert made.effect_sizes().count() == 3


def test_wellbeing_is_a_percentage(tables):
    got = score_form(tables["fx_wellbeing"], WELLBEING)
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 100
    dated = visits.get_when(got, "tie", "patient")
    assert dated.where("when_dt is null").count() == 0


def test_tables_are_written_when_first_asked_for(tables, monkeypatch):
    made = study(tables)
    names = []
    plain = made.scratch.write
    monkeypatch.setattr(made.scratch, "write", lambda df, name: names.append(name) or plain(df, name))
    assert made.baseline_rows().count() > 0 and names == []
    made.missing_scores().count()
    made.anova().count()
    made.means().count()
    made.effect_sizes().count()
    assert names == ["scored_0", "scored_1", "scored_2", "long", "pairs"]
    made.remove()
    assert made.anova().count() == 9 and names[5:] == ["scored_0", "scored_1", "scored_2", "long", "pairs"]
