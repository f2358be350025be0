"""First and last rows of many keys: a filter before the shuffle instead of a broadcast."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duowave.operators import visits
from duowave.plans import bloom


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        for _ in range(rng.choice([1, 2, 5, 40])):
            rows.append((f"k{i % 390}" if i % 97 else None, rng.choice(["a", "b"]),
                         None if rng.random() < 0.05 else start + timedelta(hours=rng.randint(0, 300)), rng.randint(0, 10**6), rng.random()))
    # One key holds a third of all rows, many of them at one time.
    rows += [("hot", "a", start + timedelta(hours=rng.randint(0, 50) // 25), i, rng.random()) for i in range(len(rows) // 2)]
    return spark.createDataFrame(rows, "key string, kind string, at timestamp_ntz, tie long, score double").repartition(6).cache()


CALLS = {
    "add_pre_post": lambda df: visits.add_pre_post(df, ["key", "kind"], "at", "tie"),
    "pre_post_pairs": lambda df: visits.pre_post_pairs(df, ["key", "kind"], "at", "tie"),
    "baseline_row": lambda df: visits.baseline_row(df, ["key"], "at", "tie"),
    "latest_per_cell": lambda df: visits.latest_per_cell(df, ["key", "kind"], "at", "tie"),
    "first_by_key": lambda df: visits.first_by_key(df, ["key"], ["at", "tie"]),
}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", CALLS)
@pytest.mark.parametrize("filter_from", [0, 10**9])
def test_same_rows_with_and_without_broadcasts(spark, events, monkeypatch, name, filter_from):
    want = _rows(CALLS[name](events))
    monkeypatch.setattr(visits, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(visits, "FILTER_FROM", filter_from)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _rows(CALLS[name](events)) == want
        assert CALLS[name](events.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_rows_at_an_end_are_shuffled(spark, events, monkeypatch):
    monkeypatch.setattr(visits, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(visits, "FILTER_FROM", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CALLS["latest_per_cell"](events)._jdf.queryExecution().sparkPlan().toString()
        # The rows meet the filter's pages first, and are dealt by key and time after.
        rows_side = plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else 0:]
        assert "BroadcastHashJoin" in rows_side and "bitmap" in rows_side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_keeps_all_items_and_few_others(spark):
    items = spark.range(5000).select((F.col("id") * 7).alias("a"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("x"), F.col("id"))).alias("b"))
    bits = bloom.filter_bits(5000)
    assert bits == 131_072 and bloom.filter_bits(0) == bloom.PAGE_BITS and bloom.filter_bits(10**12) == bloom.MOST_BITS
    pages = bloom.bitmap_pages(items, ["a", "b"], bits)
    assert pages.count() <= bits // bloom.PAGE_BITS
    assert bloom.maybe_among(items.withColumn("_page", F.lit(1)), [F.col("a"), F.col("b")], pages, bits).count() == 5000
    others = spark.range(40_000).select((-F.col("id") - 1).alias("a"), F.lit("y").alias("b"))
    passed = bloom.maybe_among(others, [F.col("a"), F.col("b")], pages, bits).count()
    assert passed < 40_000 / 16
    assert bloom.maybe_among(others, [F.col("a"), F.col("b")], bloom.bitmap_pages(items.limit(0), ["a", "b"], bits), bits).count() == 0
