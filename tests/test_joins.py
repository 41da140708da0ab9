"""Lag correlation by blocks, inequality joins, chains and one-shuffle alignment against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from chronoloom.operators import chains, lags, ranges, series
from chronoloom.plans import registry

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lags_equal_the_hourly_form(spark):
    x, y = (registry._events(spark, SF, k) for k in ("view", "purchase"))
    want = {r.lag_hours: r for r in series.cross_correlation(x, y, "ts", "value", 60).collect()}
    got = {r.lag: r for r in lags.lag_correlation(x, y, "ts", "value", "1 hour", 60).collect()}
    assert set(got) == set(want) and all(got[k].n == want[k].n for k in want)
    assert all(got[k].corr == pytest.approx(want[k].corr, abs=1e-9) for k in want if want[k].n > 5)


def test_ten_thousand_lags_of_a_second(spark):
    """A copy 1234 seconds late is found among 10,001 lags, each equal to the definition; times lie on both sides of the epoch."""
    rng = np.random.default_rng(3)
    at = np.unique(rng.integers(-20_000, 40_000, 5000))
    values = {int(t): float(v) for t, v in zip(at, rng.normal(1e6, 1, len(at)))}
    kind = "ts timestamp_ntz, v double"
    epoch = dt.datetime(1970, 1, 1)
    x = spark.createDataFrame([(epoch + dt.timedelta(seconds=t + 0.5), v) for t, v in values.items()] + [(None, 1.0), (epoch, None)], kind)
    later = {t + 1234: v + float(rng.normal(0, 0.1)) for t, v in values.items() if rng.random() < 0.7}
    y = spark.createDataFrame([(epoch + dt.timedelta(seconds=t), v) for t, v in later.items()], kind)
    got = {r.lag: r for r in lags.lag_correlation(x, y, "ts", "v", "1 second", 5000).collect()}
    assert max((r for r in got.values() if r.n > 100), key=lambda r: r.corr).lag == 1234
    for lag in (-5000, -4999, -7, 0, 3, 1234, 5000):
        both = [(v, later[t + lag]) for t, v in values.items() if t + lag in later]
        assert got[lag].n == len(both) and got[lag].corr == pytest.approx(np.corrcoef(*zip(*both))[0, 1], abs=1e-7)
    steady = x.withColumn("v", F.lit(5.0))
    assert {r.corr for r in lags.lag_correlation(steady, y, "ts", "v", "1 second", 3).collect()} == {None}
    assert lags.lag_correlation(x.limit(0), y, "ts", "v", "1 second", 3).count() == 0 == lags.lag_correlation(x, y.limit(0), "ts", "v", "1 second", 3).count()


@pytest.mark.parametrize("or_equal", [False, True])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_inequality_join(spark, parts, or_equal):
    rng = random.Random(parts)
    value = lambda: rng.choice([7.0, 7.0, None, rng.randrange(20) / 2, rng.random() * 30])
    a, b = [(i, value()) for i in range(150)], [(i, value()) for i in range(120)]
    got = ranges.inequality_join(spark.createDataFrame(a, "x int, p double"), spark.createDataFrame(b, "y int, q double"), "p", "q", or_equal, parts)
    want = sorted((x, y) for x, p in a for y, q in b if p is not None and q is not None and (p < q or or_equal and p == q))
    assert sorted((r.x, r.y) for r in got.collect()) == want
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)


def test_a_shared_value_is_compared_with_nothing_of_its_own(spark):
    """Half of all rows have one value; under < no cell holds them against each other."""
    a = spark.range(2000).select(F.col("id").alias("x"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 100).alias("p"))
    b = a.toDF("y", "q")
    got = ranges.inequality_join(a, b, "p", "q", parts=16)
    rows = [r.p for r in a.collect()]
    assert got.count() == sum(p < q for p in rows for q in rows)
    assert ranges.inequality_join(a.limit(0), b, "p", "q").count() == 0 == ranges.inequality_join(a, b.limit(0), "p", "q").count()


def _roots(rows):
    parent = {i: p for i, p in rows if i is not None}
    out = {}
    for i in parent:
        at, n = i, 0
        while parent[at] in parent:
            at, n = parent[at], n + 1
        out[i] = (at, n)
    return out


def test_chains(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(i) if i and rng.random() < 0.95 else rng.choice([None, -5])) for i in range(300)]
    rows += [(1000 + i, 999 + i if i else None) for i in range(70)]  # a long chain
    rows += [(2000 + i, 2000 if i else None) for i in range(80)]  # a star
    rows += [(None, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, parent long")
    got = chains.roots(df, "id", "parent").collect()
    assert {r.id: (r.root, r.depth) for r in got} == _roots(rows) and len(got) == 450
    assert chains.roots(df.limit(0), "id", "parent").count() == 0
    with pytest.raises(ValueError, match="circle"):
        chains.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, None)], "id long, parent long"), "id", "parent")


def test_alignment_in_one_shuffle(spark):
    df = registry.queries()["align_five"](spark, SF)
    assert len(re.findall(r"Exchange", _plan(df))) == 1 and "Join" not in _plan(df)
    chain = None
    for kind in ("click", "error", "purchase", "signup", "view"):
        one = series.calendar_bucket(registry._events(spark, SF, kind), "ts", "day", ["user_id"], [F.round(F.avg("value"), 4).alias(kind)])
        chain = one if chain is None else chain.join(one, ["user_id", "bucket_start"], "full")
    key = lambda r: (r.user_id, r.bucket_start)
    assert sorted(df.collect(), key=key) == sorted(chain.collect(), key=key)


@pytest.mark.parametrize("or_equal", [False, True])
def test_inequality_join_joins_bounded_arrays(spark, or_equal):
    """The join itself meets arrays of right rows, none much over ``chunk``, though one value has a third of them."""
    rng = random.Random(3)
    value = lambda: rng.choice([4.0, None, rng.random() * 9])
    a, b = [(i, value()) for i in range(90)], [(i, value()) for i in range(240)]
    got = ranges.inequality_join(spark.createDataFrame(a, "x int, p double"), spark.createDataFrame(b, "y int, q double").repartition(3), "p", "q", or_equal, 4, chunk=16)
    want = sorted((x, p, y, q) for x, p in a for y, q in b if p is not None and q is not None and (p < q or or_equal and p == q))
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["x", "p", "y", "q"]
    plan = _plan(got)
    assert plan.index("Generate inline") < plan.index("SortMergeJoin") < plan.index("collect_list")
    # 240 rows by 16: fifteen chunks of even size, of which a block has a part.
    assert ", 15)" in plan


def _shuffled(spark, act):
    """What ``act`` returns, and the bytes that its stages have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    stages = lambda: sc.dagScheduler().nextStageId()
    first, out = stages(), act()
    sc.listenerBus().waitUntilEmpty()
    written = 0
    for k in range(first, stages()):
        try:
            written += sc.statusStore().lastStageAttempt(k).shuffleWriteBytes()
        except Py4JJavaError:  # a stage whose shuffle was there already is not known
            pass
    return out, written


def test_inequality_join_moves_few_bytes(spark):
    """Fifteen left rows to a right one: the larger side is not sent to every block of the other."""
    a = spark.range(60_000).select(F.col("id").alias("x"), (F.xxhash64("id") % 1_000_000 / 100).alias("p"))
    b = spark.range(4000).select(F.col("id").alias("y"), (F.xxhash64(F.col("id") + 7_000_000) % 1_000_000 / 100).alias("q"))
    n, written = _shuffled(spark, lambda: ranges.inequality_join(a, b, "p", "q").count())
    ps, qs = (np.sort([r[0] for r in df.collect()]) for df in (a.select("p"), b.select("q")))
    assert n == int(np.searchsorted(ps, qs).sum())
    assert written < 14 * 16 * 64_000


def test_inequality_join_is_kept_in_few_bytes(spark, tmp_path):
    """Pairs come in an order that files of columns keep at a fraction of a byte each."""
    a = spark.range(6000).select(F.col("id").alias("x"), (F.xxhash64("id") % 1_000_000).alias("p"))
    b = spark.range(4000).select(F.col("id").alias("y"), (F.xxhash64(F.col("id") + 7_000_000) % 1_000_000).alias("q"))
    pairs = ranges.inequality_join(a, b, "p", "q", parts=2).select("x", "y")
    pairs.write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 10_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * n
    # What comes of one row is held by Spark before it is handed on, so left arrays are cut after the join.
    plan = _plan(pairs)
    assert plan.index("Generate inline") < plan.index("Generate explode(transform") < plan.index("SortMergeJoin")


@pytest.mark.parametrize("or_equal", [False, True])
@pytest.mark.parametrize("sizes", [(900, 7), (7, 900), (300, 300), (600, 1)])
def test_inequality_join_of_uneven_sides(spark, sizes, or_equal):
    """Ends of doubles, NaN (above all others), null and values that many rows share, on either side."""
    rng = random.Random(sizes[0])
    nan, inf = float("nan"), float("inf")
    value = lambda: rng.choice([3.0, 3.0, 8.0, -0.0, 0.0, nan, inf, -inf, None, rng.random() * 20])
    a, b = ([(i, value()) for i in range(n)] for n in sizes)
    place = lambda v: (v != v, 0 if v != v else v)
    want = sorted((x, y) for x, p in a for y, q in b if p is not None and q is not None and (place(p) < place(q) or or_equal and place(p) == place(q)))
    got = ranges.inequality_join(spark.createDataFrame(a, "x int, p double"), spark.createDataFrame(b, "y int, q double"), "p", "q", or_equal, 6, chunk=100)
    assert sorted((r.x, r.y) for r in got.collect()) == want


def test_inequality_join_of_dates_and_maps(spark):
    """Values need an order only, other columns not even that."""
    a = spark.range(200).select(F.create_map(F.lit("k"), "id").alias("x"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("p"))
    b = a.toDF("y", "q")
    rows = [r.p for r in a.collect()]
    got = ranges.inequality_join(a, b, "p", "q", parts=5).collect()
    assert len(got) == sum(p < q for p in rows for q in rows) and all(r.p < r.q and r.x["k"] % 40 < r.y["k"] % 40 for r in got)
