"""Quantiles and user-defined forms on cases that the tables lack; plans of hints and theta joins."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import forms, quantiles
from chronoloom.functions import sketches as stored
from chronoloom.plans import registry

SF = "/root/testdata/sf0.001"
DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_quantiles_by_brute_force(spark):
    rng = random.Random(2)
    groups = {"even": [float(i) for i in range(500)], "hot": [7.0] * 900 + [float(i) for i in range(100)], "far": [rng.paretovariate(0.3) for _ in range(700)], None: [1.5, None, 2.5], "one": [4.0], "none": [None]}
    rows = [(k, x) for k, values in groups.items() for x in values]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.k, r.q): r.quantile for r in quantiles.exact_quantiles(df, ["k"], "x", qs, parts=8).collect()}
    want = {(k, q): float(np.quantile([x for x in values if x is not None], q)) for k, values in groups.items() if k != "none" for q in qs}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    every = {r.q: r.quantile for r in quantiles.exact_quantiles(df, [], "x", [0.5]).collect()}
    assert every == {0.5: pytest.approx(float(np.quantile([x for _, x in rows if x is not None], 0.5)))}
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "x", qs).count() == 0


def test_forms_on_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", DAY(0), 2.0), ("a", DAY(0), 4.0), ("a", DAY(2), 9.0), ("a", DAY(1), None), (None, DAY(0), 1.0), ("b", None, 3.0)], "k string, ts timestamp_ntz, v double")
    smooth = {(r.k, r.bucket_start): r.smooth for r in forms.smoothed(df, "ts", "v", "day", ["k"], 0.5).collect()}
    assert smooth == {("a", DAY(0)): 3.0, ("a", DAY(2)): 6.0, (None, DAY(0)): 1.0}
    other = spark.createDataFrame([("a", DAY(0), 3.0), ("a", DAY(3), 8.0), ("a", DAY(4), 9.0), ("c", DAY(0), 1.0)], "k string, ts timestamp_ntz, v double")
    found = lambda band: {r.k: r.distance for r in forms.banded_dtw(df, other, "ts", "v", "day", ["k"], band).collect()}
    assert found(5) == {"a": 1.0} and found(0) == {}
    assert forms.smoothed(df.limit(0), "ts", "v", "day", ["k"], 0.5).count() == 0 == forms.banded_dtw(df.limit(0), other, "ts", "v", "day", ["k"], 5).count()
    texts = spark.createDataFrame([("é  b",), (None,), ("",)], "t string")
    assert {r.n for r in texts.select(forms.nfc("t").alias("n")).collect()} == {"é  b", None, ""}
    assert sorted(map(tuple, texts.lateralJoin(forms.Words(F.col("t").outer())).select("word", "at").collect())) == [("b", 4), ("é", 0)]


@pytest.mark.parametrize(
    "name,node",
    [("join_merge_hint", "SortMergeJoin"), ("join_shuffle_hash_hint", "ShuffledHashJoin"), ("join_broadcast_hint", "BroadcastHashJoin"), ("theta_join", "BroadcastNestedLoopJoin"), ("join_mixed", "BroadcastHashJoin")],
)
def test_hints_choose_the_join(spark, name, node):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert node in plan and "Cartesian" not in plan


def test_sketches_merge_like_rows(spark):
    """Hours rolled up to days and to all time: exact while a sketch holds all values, within its error beyond."""
    rows = [("a" if i % 3 else "b", DAY(i % 4 / 2), i % 50, float(i)) for i in range(600)] + [(None, DAY(0), 1, 1.0), ("a", None, 7000, 5.0), ("b", DAY(1), None, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, u int, v double")
    store = stored.summarised(df, "ts", "hour", ["k"], "u", "v")
    days = {(r.k, r.bucket_start): r for r in stored.estimates(stored.rolled_up(store, "day", ["k"]), 0.5).collect()}
    direct = {(r.k, r.bucket_start): r for r in stored.estimates(stored.summarised(df, "ts", "day", ["k"], "u", "v"), 0.5).collect()}
    assert set(days) == set(direct) and all((days[k].n, days[k].distinct_hll, days[k].distinct_theta, days[k]["quantile"]) == (direct[k].n, direct[k].distinct_hll, direct[k].distinct_theta, direct[k]["quantile"]) for k in days)
    every = stored.estimates(stored.rolled_up(store, None, []), 0.5).first()
    assert every.n == 602 and every.distinct_theta == 50 and every.distinct_hll == 50 and abs(every["quantile"] - 300) < 10
    many = spark.range(300_000).select(F.lit("x").alias("k"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), (F.col("id") % 200_000).alias("u"), F.col("id").cast("double").alias("v"))
    one = stored.estimates(stored.rolled_up(stored.summarised(many, "ts", "hour", ["k"], "u", "v"), None, ["k"]), 0.9).first()
    assert abs(one.distinct_hll / 200_000 - 1) < 0.065 and abs(one.distinct_theta / 200_000 - 1) < 0.065 and abs(one["quantile"] / 300_000 - 0.9) < 0.01
    assert stored.rolled_up(store.limit(0), "day", ["k"]).count() == 0


def test_admitted_rows_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), i, DAY(rng.randrange(4000) / 1000) if rng.random() < 0.97 else None) for i in range(25_000)]
    got = {r.i: (r.admitted, r.skipped) for r in forms.spaced(spark.createDataFrame(rows, "k string, i long, ts timestamp_ntz").repartition(5), "i", "ts", "1 minute", "k").collect()}
    want = {}
    for k in ("a", "b", None):
        last, skipped = None, 0
        for _, i, at in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or DAY(0), r[1])):
            good = at is not None and (last is None or at - last >= dt.timedelta(minutes=1))
            last, skipped = (at, 0) if good else (last, skipped + 1)
            want[i] = good, skipped
    assert got == want
    assert forms.spaced(spark.createDataFrame([], "k string, i long, ts timestamp_ntz"), "i", "ts", "1 minute", "k").count() == 0
