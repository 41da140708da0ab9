"""Plans and cases that the tables lack: ties, nulls, tolerance edges, empty sides."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import series
from chronoloom.plans import registry

SF = "/root/testdata/sf0.001"
AT = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["asof_backward", "asof_forward", "asof_nearest", "asof_backward_stretches", "dtw_daily", "interval_join", "interval_join_keyed", "interpolate_hourly", "sessions", "rolling_time"])
def test_no_nested_loop_and_no_python(spark, name):
    plan = _plan(registry.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["asof_backward", "asof_forward", "asof_nearest", "interpolate_hourly", "rolling_time", "fill_forward", "differences"])
def test_one_shuffle(spark, name):
    assert _plan(registry.queries()[name](spark, SF)).count("Exchange") == 1


def _gaps(spark):
    """Ties, null times, null keys and null values in random order, on one huge key and two small ones."""
    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), AT(rng.randrange(400)) if rng.random() < 0.95 else None, i, rng.choice([None, float(i % 17)])) for i in range(300)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v double").repartition(3)


def _aggs():
    return [F.count("*").alias("n"), F.sum("v").alias("v"), F.max("id").alias("id")]


def _row_gap():
    """Some reach over several stretches; some are zero or null."""
    return F.when(F.col("id") % 40 == 0, "45 seconds").when(F.col("id") % 3 == 0, "0 seconds").when(F.col("id") % 7 == 0, None).otherwise("2 seconds")


STRETCHED = {
    "sessions": lambda df, s: series.sessions(df, "ts", "3 seconds", ["k"], _aggs(), s and "4 seconds"),
    "sessions by row": lambda df, s: series.sessions(df, "ts", _row_gap(), ["k"], _aggs(), s and "10 seconds"),
    "sessions without a key": lambda df, s: series.sessions(df.where("id % 9 = 0"), "ts", "3 seconds", [], _aggs(), s and "5 seconds"),
    "fill forward": lambda df, s: series.fill(df, "ts", "v", ["k"], tie=["id"], stretch=s and "30 seconds"),
    "fill backward": lambda df, s: series.fill(df, "ts", "v", ["k"], "backward", tie=["id"], stretch=s and "30 seconds"),
    "interpolate": lambda df, s: series.interpolate(df, "ts", "v", "7 seconds", ["k"], s and "20 seconds"),
    "rolling time": lambda df, s: series.rolling(df, "ts", ["k"], "25 seconds", {"n": "count(v)", "high": "max(v)"}, s and "25 seconds"),
    "rolling rows": lambda df, s: series.rolling(df, "ts", ["k"], 6, {"n": "sum(v)"}, s and 6, tie=["id"]),
    "delta": lambda df, s: series.delta(df.where("ts is not null").dropDuplicates(["k", "ts"]).orderBy("id"), "ts", "v", ["k"], s and "11 seconds"),
    "asof": lambda df, s: series.asof(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "ts", ["k"], ["v", "id"], "nearest", "20 seconds", stretch=s and "9 seconds"),
}


@pytest.mark.parametrize("name", STRETCHED)
def test_stretches_change_nothing(spark, name):
    df = _gaps(spark)
    run = lambda s: Counter(map(repr, STRETCHED[name](df, s).collect()))
    assert run(True) == run(False)
    assert STRETCHED[name](df.limit(0), True).count() == 0


@pytest.mark.parametrize("name", STRETCHED)
def test_a_huge_key_spreads_over_its_stretches(spark, name):
    """The rows are shuffled on the key and the stretch, never on the key alone; only one row a stretch is."""
    plan = _plan(STRETCHED[name](_gaps(spark), True))
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert any(x.startswith("_s#") for x in dealt) and not any(re.fullmatch(r"k#\d+", x) for x in dealt), dealt


def test_interval_join_by_brute_force(spark):
    df = _gaps(spark)
    a, b = df.where("id % 2 = 0").select("k", F.col("id").alias("x"), F.col("ts").alias("s")), df.where("id % 2 = 1").select("k", F.col("id").alias("y"), F.col("ts").alias("t"))
    left, right = a.collect(), b.collect()
    for lower, upper, by in ((0, 9, ["k"]), (-12, -3, ["k"]), (-5, 5, None), (0, 0, ["k"]), (3, 3, None)):
        got = series.interval_join(a.drop(*([] if by else ["k"])), b.drop(*([] if by else ["k"])), "s", "t", f"{upper} seconds", by, f"{lower} seconds").select("x", "y").collect()
        want = [(p.x, q.y) for p in left for q in right if p.s and q.t and (not by or p.k is not None and p.k == q.k) and lower <= (q.t - p.s).total_seconds() <= upper]
        assert sorted(map(tuple, got)) == sorted(want)
    dealt = _plan(series.interval_join(a, b, "s", "t", "9 seconds", ["k"]))
    assert re.search(r"\[k#\d+, _bin#\d+L?\]", dealt)


def _sides(spark):
    left = spark.createDataFrame([("a", AT(10), 1), ("a", AT(5), 2), (None, AT(10), 3), ("b", AT(10), 4), ("a", None, 5)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", AT(5), 1.0, 1), ("a", AT(5), None, 2), ("a", AT(15), 3.0, 1), (None, AT(1), 9.0, 1), ("a", None, 9.0, 1)], "k string, ts timestamp_ntz, v double, seq int")
    return left, right


def test_asof_ties_nulls_and_tolerance(spark):
    left, right = _sides(spark)
    run = lambda **o: {r.id: (r.right_ts, r.right_v) for r in series.asof(left, right, "ts", ["k"], ["v"], tie=["seq"], **o).collect()}
    none = (None, None)
    # The later of the tied rows matches, though its value is null.
    assert run() == {1: (AT(5), None), 2: (AT(5), None), 3: none, 4: none, 5: none}
    assert run(allow_exact=False) == {1: (AT(5), None), 2: none, 3: none, 4: none, 5: none}
    assert run(tolerance="5 seconds")[1] == (AT(5), None) and run(tolerance="4 seconds")[1] == none
    assert run(direction="forward")[1] == (AT(15), 3.0)
    assert run(direction="nearest")[1] == (AT(5), None)
    assert series.asof(left, right.limit(0), "ts", ["k"], ["v"]).where("right_v is not null").count() == 0
    assert series.asof(left.limit(0), right, "ts", ["k"], ["v"]).count() == 0


def test_asof_stretches_change_nothing(spark):
    left, right = _sides(spark)
    for o in ({}, {"allow_exact": False}, {"direction": "forward"}, {"direction": "nearest"}, {"tolerance": "5 seconds"}):
        run = lambda **e: sorted(map(repr, series.asof(left, right, "ts", ["k"], ["v"], tie=["seq"], **o, **e).collect()))
        assert run() == run(stretch="2 seconds") == run(stretch="7 seconds")


def test_fill_and_grid(spark):
    df = spark.createDataFrame([("a", AT(0), 1, None), ("a", AT(1800), 2, 5.0), ("a", AT(3600), 3, None), ("b", AT(10), 4, None), ("b", None, 5, None)], "k string, ts timestamp_ntz, id int, v double")
    values = lambda m: {r.id: r.v for r in series.fill(df, "ts", "v", ["k"], m).collect()}
    assert values("forward") == {1: None, 2: 5.0, 3: 5.0, 4: None, 5: None}
    assert values("backward") == {1: 5.0, 2: 5.0, 3: None, 4: None, 5: None}
    assert {(r.k, r.ts) for r in series.grid(df, "ts", "1 hour", ["k"]).collect()} == {("a", AT(0)), ("a", AT(3600))}


def test_dtw_by_brute_force(spark):
    events = registry._events(spark, SF)
    x, y = (events.where(f"event_type = '{t}'") for t in ("view", "purchase"))

    def means(df):
        out = {}
        for r in series.calendar_bucket(df, "ts", "day", ["user_id"], [F.avg("value").alias("v")]).orderBy("bucket_start").collect():
            out.setdefault(r.user_id, []).append(r.v)
        return out

    def distance(a, b):
        d = {(0, 0): 0.0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d.get(p, float("inf")) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        return d[len(a), len(b)]

    a, b = means(x), means(y)
    got = {r.user_id: r.distance for r in registry.queries()["dtw_daily"](spark, SF).collect()}
    assert set(got) == set(a) & set(b) and all(got[k] == pytest.approx(distance(a[k], b[k]), abs=1e-4) for k in got)


def test_interpolation_meets_its_anchors(spark):
    df = spark.createDataFrame([("a", AT(0), 0.0), ("a", AT(7200), 20.0), ("a", AT(5000), None)], "k string, ts timestamp_ntz, v double")
    rows = {r.ts: r.linear for r in series.interpolate(df, "ts", "v", "1 hour", ["k"]).collect()}
    assert rows == {AT(0): 0.0, AT(3600): 10.0, AT(7200): 20.0}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["lateral_top", "lateral_frame"])
def test_lateral_rows_are_numbered_in_their_order(spark, name):
    """The window that numbers a customer's orders sorts them itself; an order made before the shuffle does not hold after it."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    numbers = re.findall(r"row_number\(\) windowspecdefinition\((.*?), specifiedwindowframe", plan)
    assert numbers and all("o_totalprice" in n and "DESC" in n and n.rindex("o_orderkey") > n.index("DESC") for n in numbers)
    assert "rangepartitioning" not in plan and "NestedLoop" not in plan


def test_the_dearest_of_equal_rows_has_the_least_key(spark, tmp_path):
    """Copies with shifted keys in any order; the rows of a missing key or price don't count, nor does a missing flag match nothing."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    odd = lines.limit(3).withColumns({"l_orderkey": F.lit(None).cast("bigint"), "l_extendedprice": F.lit(9e9)})
    copies = [lines.withColumn("l_orderkey", F.col("l_orderkey") + 10_000 * n) for n in (2, 0, 3, 1)]
    for df, mode in zip([odd, *copies, lines.limit(3).withColumn("l_extendedprice", F.lit(None).cast("double"))], ["overwrite"] + 5 * ["append"]):
        df.coalesce(1).write.mode(mode).parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_returnflag: r.dearest for r in registry.queries()["aggregates"](spark, str(tmp_path)).collect()}
    best = {}
    for r in lines.collect():
        best[r.l_returnflag] = max(best.get(r.l_returnflag, (0, 0)), (r.l_extendedprice, -r.l_orderkey))
    assert got == {flag: -key for flag, (_, key) in best.items()} and None in got
