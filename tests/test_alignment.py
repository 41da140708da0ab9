"""Warping paths, nearest series and clocks against brute force and planted truth."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import clocks, warping
from chronoloom.plans import registry

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def _table(a, b):
    """Costs of all prefixes, by definition."""
    d = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d.get(p, math.inf) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return d


def _path(a, b):
    d, i, j, out = _table(a, b), len(a), len(b), []
    while i:
        out.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d.get(p, math.inf))
    return out[::-1]


@pytest.mark.parametrize("small", [1, 4, 30, 1024])
def test_path_by_divide_and_conquer(small):
    rng = np.random.default_rng(small)
    for n, m in ((1, 1), (1, 9), (9, 1), (2, 2), (3, 30), (30, 3), (25, 25), (47, 31)):
        a, b = rng.random(n), rng.random(m)
        _cheapest(warping.path(a, b, small), a, b)
    for _ in range(20):
        a, b = rng.integers(0, 3, 12).astype(float), rng.integers(0, 3, 17).astype(float)
        _cheapest(warping.path(a, b, small), a, b)


def _cheapest(got, a, b):
    """Several paths may be equally cheap; this is one of them."""
    assert got[0] == (0, 0) and got[-1] == (len(a) - 1, len(b) - 1) and all((p[0] - q[0], p[1] - q[1]) in ((1, 0), (0, 1), (1, 1)) for q, p in zip(got, got[1:]))
    assert sum(abs(a[i] - b[j]) for i, j in got) == pytest.approx(_table(a, b)[len(a), len(b)], rel=1e-12)


def _daily(df):
    out = {}
    for r in df.where("value is not null").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("v")).orderBy("t").collect():
        out.setdefault(r.user_id, []).append((r.t, r.v))
    return out


def test_warping_path_of_each_key(spark):
    events = registry._events(spark, SF)
    x, y = (_daily(events.where(f"event_type = '{t}'")) for t in ("view", "purchase"))
    got = {}
    for r in registry.queries()["warping_path_daily"](spark, SF).orderBy("user_id", "place").collect():
        got.setdefault(r.user_id, []).append((r.x_time, r.y_time))
    want = {k: [(x[k][i][0], y[k][j][0]) for i, j in _path([v for _, v in x[k]], [v for _, v in y[k]])] for k in set(x) & set(y)}
    assert got == want


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b, band = rng.random(rng.integers(1, 15)), rng.random(rng.integers(1, 15)), int(rng.integers(0, 6))
        whole = warping.banded(a, b, band)
        assert warping.bound(b, *warping.envelope(a, len(b), band)) <= whole + 1e-12
        assert warping.banded(a, b, band, whole * 0.99 - 1e-9) in (whole, math.inf) and warping.banded(a, b, band, whole) == whole


def test_nearest_series_by_brute_force(spark):
    got = {r.user_id: [] for r in []}
    for r in registry.queries()["nearest_series_daily"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.near, r.distance))
    daily = {k: np.array([v for _, v in s]) for k, s in _daily(registry._events(spark, "/root/testdata/sf0.01")).items()}
    asked = [k for k in daily if k % 20 == 0]
    assert len(asked) == 8
    for q in asked:
        found = sorted((warping.banded(daily[q], daily[k], 3), k) for k in daily if k != q)
        want = [(n, k, round(d, 4)) for n, (d, k) in enumerate(found[:3], 1) if d < math.inf]
        assert sorted(got.get(q, [])) == want


def test_nearest_series_ties_and_blocks(spark):
    rows = [(k, START + dt.timedelta(days=t), float(v)) for k, s in {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3], 4: [9, 9, 9], 5: [1, 2]}.items() for t, v in enumerate(s)]
    df = spark.createDataFrame([*rows, (None, START, 1.0), (6, None, 1.0), (7, START, None)], "k int, ts timestamp_ntz, v double")
    run = lambda **o: sorted(tuple(r) for r in warping.nearest_series(df, df.where("k in (1, 4, 5)"), "ts", "v", "day", "k", 1, **o).collect())
    assert run(k=2) == run(k=2, block=1) == [(1, 2, 0.0, 1), (1, 3, 0.0, 2), (4, 1, 21.0, 1), (4, 2, 21.0, 2), (5, 1, 1.0, 1), (5, 2, 1.0, 2)]
    assert warping.nearest_series(df.limit(0), df, "ts", "v", "day", "k", 1).count() == warping.nearest_series(df, df.limit(0), "ts", "v", "day", "k", 1).count() == 0


def _seen(spark, offsets, jitter, gap=600, n=300, strays=0.0):
    """The same events by two clocks: per clock an offset in seconds and a drift."""
    rng = random.Random(4)
    x, y = [], []
    for c, (offset, drift) in offsets.items():
        at = 0.0
        for _ in range(n):
            at += rng.expovariate(1 / gap) + 60
            x.append((c, START + dt.timedelta(seconds=at)))
            if rng.random() < 0.8:  # some are missed
                stray = rng.uniform(-20, 20) if rng.random() < strays else 0
                y.append((c, START + dt.timedelta(seconds=at + offset + drift * (at - 60) + rng.gauss(0, jitter) + stray)))
    kind = "c string, ts timestamp_ntz"
    return spark.createDataFrame([*x, (None, START), ("a", None)], kind), spark.createDataFrame([*y, (None, START), ("a", None)], kind)


@pytest.mark.parametrize("strays", [0.0, 0.15])
def test_planted_clocks_are_recovered(spark, strays):
    planted = {"a": (2.5, 40e-6), "b": (-11.0, -15e-6), "d": (0.0, 0.0)}
    x, y = _seen(spark, planted, 0.0005, strays=strays)
    got = {r.c: r for r in clocks.clock_drift(x, y, "ts", ["c"], ["c"], "30 seconds").where("c is not null").collect()}
    first = {r.c: (r.t - START).total_seconds() for r in x.groupBy("c").agg(F.min("ts").alias("t")).collect() if r.c}
    for c, (offset, drift) in planted.items():
        assert abs(got[c].offset_us - 1e6 * (offset + drift * (first[c] - 60))) < 400 and abs(got[c].drift_ppm - 1e6 * drift) < 0.004, got[c]
        assert got[c].matched > 0.75 * (1 - strays) * 300


def test_one_clock_for_all(spark):
    x, y = _seen(spark, {"a": (3.0, 20e-6), "b": (3.0, 20e-6)}, 0.0)
    r = clocks.clock_drift(x, y, "ts", ["c"], tolerance="30 seconds").first()
    assert abs(r.offset_us - 3e6) < 20_000 and abs(r.drift_ppm - 20) < 0.01
    assert clocks.clock_drift(x.limit(0), y, "ts", ["c"]).count() == 0 and clocks.clock_drift(x, y.limit(0), "ts", ["c"], ["c"]).count() == 0


def test_the_registered_clock(spark):
    r = registry.queries()["clock_drift"](spark, "/root/testdata/sf0.01").first()
    first = registry._events(spark, "/root/testdata/sf0.01").agg(F.min("ts")).first()[0] - START
    assert abs(r.offset_us - 2.5e6 - 40 * first.total_seconds()) < 60 and abs(r.drift_ppm - 40) < 0.0001 and r.matched > 8000


def test_many_series_at_once_equal_one_by_one():
    """Lengths of 1 to 14 (one far longer), ties and not-a-number: the same costs to the last bit, the same nearest."""
    rng = np.random.default_rng(5)
    series = [np.round(rng.random(n) * 4, 1) for n in [*rng.integers(1, 15, 150), 400]]
    series[7][0] = math.nan
    series += series[20:60]
    table = lambda keys: pa.table({"key": pa.array(keys, pa.int64()), "s": pa.array([series[n].tolist() for n in keys])})
    for band in (0, 1, 3):
        b, lengths = warping._columns(table(range(len(series)))["s"].combine_chunks())
        for q in (0, 5, 31, 150):
            whole = [warping.banded(series[q], s, band) for s in series]
            got = warping.banded_all(series[q], b, lengths, band)
            assert [x for n, x in enumerate(got.tolist()) if n != 7] == [x for n, x in enumerate(whole) if n != 7]
            assert not got[7] < math.inf
        asked = [n for n in range(0, len(series), 9)]
        got = warping.nearest_of(table(asked), table(range(len(series))), band, 4, first=6)
        costs = {q: sorted((warping.banded(series[q], s, band), n) for n, s in enumerate(series) if n not in (q, 7)) for q in asked}
        want = [(q, n, d) for q in asked for d, n in costs[q][:4] if d < math.inf]
        assert sorted(got) == sorted(want)


def test_nearest_series_takes_one_plan_for_any_number_of_blocks(spark):
    """Series are made once, not once a block of queries, and no query goes through the driver."""
    df = spark.range(400).select((F.col("id") % 40).alias("k"), F.timestamp_add("DAY", F.col("id") % 7, F.lit(START).cast("timestamp_ntz")).alias("ts"), F.rand(3).alias("v"))
    plan = lambda block: warping.nearest_series(df, df, "ts", "v", "day", "k", 1, block=block)._jdf.queryExecution().executedPlan().toString()
    for block in (2, 256):
        assert plan(block).count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan(block) and "calendar" not in plan(block)
