import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from duowave.operators.mice import _Cuts, _impute_step, _spread, mice_pmm
from duowave.plans.scratch import Scratch


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(0, 1, n)
    y = 2 * x + rng.normal(0, 0.5, n)
    # A third of the rows share one predictor value.
    x[: n // 3] = 0.0
    miss = rng.random(n)
    data = [(i, float(x[i]), None if miss[i] < 0.3 else float(y[i]), None if miss[i] > 0.8 else float(i % 7))
            for i in range(n)]
    return spark.createDataFrame(data, "patient long, x double, y double, z double")


@pytest.fixture(scope="module")
def filled(people):
    return mice_pmm(people, "patient", ["x", "y", "z"], m=3, rounds=2).toPandas()


def test_copies_are_complete_and_keep_observed_cells(people, filled):
    observed = people.toPandas().set_index("patient").sort_index()
    assert len(filled) == 3 * len(observed) and not filled.isna().any().any()
    for _, copy in filled.groupby("imp"):
        copy = copy.set_index("patient").sort_index()
        for c in ["x", "y", "z"]:
            seen = observed[c].notna()
            assert (copy[c][seen] == observed[c][seen]).all()
            assert set(copy[c][~seen]) <= set(observed[c].dropna())


def test_filled_values_follow_the_relation(people, filled):
    missing = people.where("y is null and x <> 0").select("patient").toPandas().patient
    part = filled[filled.patient.isin(missing)]
    assert np.corrcoef(part.x, part.y)[0, 1] > 0.9
    assert part.groupby("imp").y.apply(tuple).nunique() == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(people, filled, parts):
    again = mice_pmm(people.repartition(parts, F.rand(1)), "patient", ["x", "y", "z"], m=3, rounds=2)
    key = ["imp", "patient"]
    assert again.toPandas().sort_values(key, ignore_index=True).round(9).equals(
        filled.sort_values(key, ignore_index=True).round(9))


def test_range_buckets_give_the_same_donors(people, filled):
    cut = mice_pmm(people, "patient", ["x", "y", "z"], m=3, rounds=2, bucket_rows=60).toPandas()
    key = ["imp", "patient"]
    assert cut.sort_values(key, ignore_index=True).round(9).equals(filled.sort_values(key, ignore_index=True).round(9))


def test_fewer_donors_than_wanted(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None), (3, 3.0, None), (4, 4.0, 9.0)],
                               "patient long, x double, y double")
    got = mice_pmm(df, "patient", ["x", "y"], m=2, rounds=1)
    assert {r.y for r in got.where("patient in (2, 3)").collect()} <= {5.0, 9.0}
    with pytest.raises(ValueError):
        mice_pmm(df.withColumn("y", F.lit(None).cast("double")), "patient", ["x", "y"], m=2, rounds=1)


def test_complete_data_is_only_copied(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "patient long, x double")
    assert rows(mice_pmm(df, "patient", ["x"], m=2)) == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 2.0)]


@pytest.mark.parametrize("positions", [1, 2, 7, 1000])
def test_matching_step_does_not_depend_on_cuts(spark, tmp_path, positions):
    rng = np.random.default_rng(positions)
    n = 2000
    missing = rng.random(n) < 1 / 3
    data = [(1 + i % 2, i, None if missing[i] else float(i), bool(~missing[i]), float(rng.integers(positions)), int(rng.integers(1 << 40)),
             float(rng.random())) for i in range(n)]
    df = spark.createDataFrame(data, "imp int, patient long, y double, is_donor boolean, at double, tie long, pick double")
    results = [rows(_impute_step(df.repartition(parts), "y", n // 2, 2, Scratch(spark, "step"), 5, bucket).select("imp", "patient", "y"))
               for bucket in (100, 1_000_000) for parts in (1, 5)]
    assert all(r == results[0] for r in results)
    filled = {r[1]: r[2] for r in results[0]}
    # Equal positions reach many donors.
    if positions == 1:
        assert len({filled[i] for i in np.flatnonzero(missing)}) > missing.sum() / 4


def test_only_gaps_are_written(spark, people, monkeypatch):
    written = {}
    plain = Scratch.write

    def counting(self, df, name):
        out = plain(self, df, name)
        written.setdefault(name.split("_")[0], []).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counting)
    mice_pmm(people, "patient", ["x", "y", "z"], m=3, rounds=2, bucket_rows=60)
    gaps = people.selectExpr("count_if(y is null) as y", "count_if(z is null) as z").first()
    assert written["input"] == [400] and written["partial"][0] < 400
    assert sorted(set(written["gaps"])) == sorted({3 * gaps["y"], 3 * gaps["z"]}) and len(written["gaps"]) == 6
    # The borders of buckets keep a few donors each.
    assert max(written["edges"]) <= 3 * 10 * 8


def test_cuts_split_positions_of_many_rows():
    cuts = _Cuts({1: [1.0, 2.0, 2.0, 2.0, 5.0]})
    at = np.array([0.5, 1.0, 1.5, 2.0, 2.0, 2.0, 3.0, 5.0, 9.0])
    tie = np.array([0, 0, 0, -(2**63), 0, 2**63 - 1, 0, 0, 0])
    assert cuts.buckets(1, at, tie).tolist() == [0, 0, 1, 2, 3, 4, 5, 5, 6]
    rng = np.random.default_rng(1)
    at, tie = rng.choice([1.0, 2.0, 2.0, 2.0, 3.0, 5.0], 2000), rng.integers(-(2**63), 2**63 - 1, 2000)
    order = np.lexsort([tie, at])
    assert (np.diff(cuts.buckets(1, at, tie)[order]) >= 0).all()


def test_repeated_keys_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, None), (2, 3.0, 9.0), (3, 1.0, 4.0), (None, 2.0, None)], "patient long, x double, y double")
    got = mice_pmm(df, "patient", ["x", "y"], m=2, rounds=1)
    assert got.count() == 10 and got.where("y is null").count() == 0


def test_rows_are_sent_once_per_range(spark):
    df = spark.createDataFrame([(1, [1.0, 1.5, 9.0]), (2, [8.0, 9.0, 8.5]), (3, [3.0, 1.0, 5.0])], "patient long, at array<double>")
    sent = _spread(df, 3, _Cuts({0: [2.0, 4.0]}), True)
    assert rows(sent, "patient", "bucket", "copies", "at") == [
        (1, 0, [1, 2], [1.0, 1.5]), (1, 2, [3], [9.0]), (2, 2, [1, 2, 3], [8.0, 9.0, 8.5]),
        (3, 0, [2], [1.0]), (3, 1, [1], [3.0]), (3, 2, [3], [5.0])]
    assert _spread(df, 3, _Cuts({0: [2.0, 4.0]}), False).where("at is not null").count() == 0


def test_donors_within_a_range_are_not_read_again(people, monkeypatch):
    written, moved = {}, []
    plain, deal = Scratch.write, type(people).repartition

    def counting(self, df, name):
        out = plain(self, df, name)
        written.setdefault(name.split("_")[0], []).append(out.count())
        return out

    def dealing(self, *by):
        if by[1:] == ("bucket",):
            moved.append(self.count())
        return deal(self, *by)

    monkeypatch.setattr(Scratch, "write", counting)
    monkeypatch.setattr(type(people), "repartition", dealing)
    mice_pmm(people, "patient", ["x", "y", "z"], m=3, rounds=2, bucket_rows=100)
    gaps = people.selectExpr("count_if(y is null) as y", "count_if(z is null) as z").first()
    # Gaps and, per copy and range, the outermost donors.
    assert len(written["found"]) == 6 and max(written["found"]) <= 3 * max(gaps) + 3 * 4 * 20
    # One exchange per step; a row comes at most once for each of its copies.
    assert len(moved) == 6 and all(400 <= n <= 3 * 400 for n in moved)
