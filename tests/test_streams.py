"""Streams over several micro-batches: state that is carried, evicted and resumed; sinks read back."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import series
from chronoloom.sources import tables
from chronoloom.streaming import streams

AT = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
ROWS = "k string, ts timestamp, id long, v double"


def _arrive(spark, folder, *files):
    """Files of rows, to be met in this order, one in each micro-batch."""
    for rows in files:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(folder))


def _stream(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_asof_carries_state_between_batches(spark, tmp_path):
    big = 2**60 + 1
    _arrive(spark, tmp_path / "l", [("a", AT(10), big, None), (None, AT(11), 2, None), ("a", None, 9, None)], [("a", AT(30), 3, None)], [("b", AT(90), 4, None)], [("z", AT(500), 5, None)])
    _arrive(spark, tmp_path / "r", [("a", AT(8), 1, 1.5), (None, AT(1), 1, 7.0)], [("a", AT(9), 2, None)], [("a", AT(30), 3, 3.5)], [("z", AT(500), 9, 9.0)])
    out = streams.asof(_stream(spark, tmp_path / "l").select("k", "ts", "id"), _stream(spark, tmp_path / "r").select("k", "ts", "v"), "ts", ["k"], ["v"], "60 seconds")
    got = {r.id: (r.k, r.ts, r.right_ts, r.right_v) for r in streams.drain(out).collect()}
    # The match at 9 has a null value and is a match still; the last row is open when input ends.
    assert got == {big: ("a", AT(10), AT(9), None), 2: (None, AT(11), None, None), 3: ("a", AT(30), AT(30), 3.5), 4: ("b", AT(90), None, None)}


def test_asof_at_the_watermark(spark, tmp_path):
    # The watermark ends at 440: the row at 440 comes out, with the right row of the same time; the one after it stays open.
    _arrive(spark, tmp_path / "l", [("a", AT(440), 1, None), ("a", AT(440.001), 2, None)], [("b", AT(500), 3, None)])
    _arrive(spark, tmp_path / "r", [("a", AT(440), 1, 4.5)], [("c", AT(500), 9, 9.0)])
    out = streams.asof(_stream(spark, tmp_path / "l").select("k", "ts", "id"), _stream(spark, tmp_path / "r").select("k", "ts", "v"), "ts", ["k"], ["v"], "60 seconds")
    assert {r.id: r.right_v for r in streams.drain(out).collect()} == {1: 4.5}


def test_state_of_a_key_is_read_by_timers_only(spark, tmp_path):
    """Many batches of one key, each far behind the watermark's delay but the last: all rows match, in order."""
    files = [[("a", AT(10 * i), i, float(i))] for i in range(6)] + [[("b", AT(5000), 99, 0.0)]]
    _arrive(spark, tmp_path / "l", *files)
    _arrive(spark, tmp_path / "r", *[[("a", AT(10 * i - 1), i, float(i))] for i in range(6)], [("b", AT(5000), 99, 0.0)])
    out = streams.asof(_stream(spark, tmp_path / "l").select("k", "ts", "id"), _stream(spark, tmp_path / "r").select("k", "ts", "v"), "ts", ["k"], ["v"], "1000 seconds")
    assert {r.id: r.right_v for r in streams.drain(out).collect()} == {i: float(i) for i in range(6)}


def test_drain_goes_on_where_it_stopped(spark, tmp_path):
    _arrive(spark, tmp_path / "in", [("a", AT(0), 1, 1.0), ("a", AT(100), 2, None)])
    run = lambda: {r.id: r.filled for r in streams.drain(streams.fill_forward(_stream(spark, tmp_path / "in"), "ts", "v", ["k"], "10 seconds"), str(tmp_path / "out")).collect()}
    assert run() == {1: 1.0}
    _arrive(spark, tmp_path / "in", [("a", AT(300), 3, None)])
    assert run() == {1: 1.0, 2: 1.0}


def test_late_rows_are_dropped(spark, tmp_path):
    _arrive(spark, tmp_path / "in", [("a", AT(1000), 1, 1.0)], [("a", AT(1001), 4, 1.0)], [("a", AT(1), 2, 1.0)], [("a", AT(9000), 3, 1.0)])
    # Lateness is judged by the watermark of the batch before, so the late row comes two batches on.
    df = streams.follow(spark, str(tmp_path / "in"), "ts", "10 seconds", maxFilesPerTrigger=1)
    out = streams.distinct_within(df, ["id"])
    assert {r.id for r in streams.drain(out).collect()} == {1, 3, 4}


def test_tables_round_trip_and_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\n\"b\"", 0.1), (2, None, None)], "id int, t string, x double")
    for format, options in (("csv", {"header": True, "multiLine": True, "escape": '"'}), ("json", {}), ("orc", {}), ("parquet", {})):
        tables.save(df, str(tmp_path / format), format, **options)
        assert sorted(tables.scan(spark, str(tmp_path / format), format, "id int, t string, x double", **options).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        tables.scan(spark, str(tmp_path / "json"), "json", "id int, t int, x double").collect()


def test_a_database_table_is_read_in_ranges(spark):
    """Over Spark's own embedded Derby, which lives in this JVM."""
    url, driver = "jdbc:derby:memory:chronoloom;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i, f"name {i}" if i % 7 else None, i / 3) for i in range(-5, 60)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    df.write.jdbc(url, "things", mode="overwrite", properties={"driver": driver})
    back = tables.jdbc(spark, url, "things", "ID", 0, 50, 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    few = back.where("id > 55").select("id")
    assert few.count() == 4 and "PushedFilters: [*IsNotNull(id), *GreaterThan(id,55)]" in few._jdf.queryExecution().executedPlan().toString()


def _states(spark, folder, variable):
    """Keys with their stored values at the end of a drained stream."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, streams._ROCKSDB)
    try:
        return spark.read.format("statestore").option("stateVarName", variable).load(f"{folder}/progress").collect()
    finally:
        spark.conf.unset(conf)


def _pair(spark, tmp_path):
    return _stream(spark, tmp_path / "l").select("k", "ts", "id"), _stream(spark, tmp_path / "r").select("k", "ts", "v")


@pytest.mark.parametrize("direction", ["nearest", "forward", "backward"])
def test_asof_within_equals_batch(spark, tmp_path, direction):
    """Rows out of order over seven micro-batches, with ties, null keys and matches at the tolerance's very edge."""
    rng = random.Random(6)
    at = lambda b: AT(100 * b + rng.randrange(0, 160) / 2)
    left = [[(rng.choice(["a", "a", "b", None]), at(b), 100 * b + i, None) for i in range(40)] for b in range(6)]
    right = [[(rng.choice(["a", "a", "b", None]), at(b), 0, float(100 * b + i)) for i in range(40)] for b in range(6)]
    end = [("z", AT(9000), -1, 0.0)]
    _arrive(spark, tmp_path / "l", *left, end, [("z", AT(9001), -2, 0.0)])
    _arrive(spark, tmp_path / "r", *right, end, [("z", AT(9001), -2, 0.0)])
    sides = _pair(spark, tmp_path)
    folder = str(tmp_path / "out")
    got = streams.drain(streams.asof_within(*sides, "ts", ["k"], ["v"], "150 seconds", "7 seconds", direction), folder)
    got = {r.id: (r.k, r.ts, r.right_ts, r.right_v) for r in got.where("id >= 0").collect()}
    batch = [spark.createDataFrame(sum(rows, []), ROWS).withColumn("ts", F.col("ts").cast("timestamp_ntz")) for rows in (left, right)]
    want = series.asof(batch[0].select("k", "ts", "id"), batch[1].select("k", "ts", "v"), "ts", ["k"], ["v"], direction, "7 seconds")
    assert got == {r.id: (r.k, r.ts, r.right_ts, r.right_v) for r in want.collect()}
    assert sum(v[3] is not None for v in got.values()) > 60
    # All rows but the last key's have gone from the state.
    assert {r.key.k for r in _states(spark, folder, "open")} == {"z"}


def test_row_windows_carry_a_bounded_state(spark, tmp_path):
    rng = random.Random(9)
    files, n = [], 0
    for b in range(5):
        files.append([(rng.choice("aab"), AT(50 * b + rng.randrange(90) + i / 100), n + i, rng.choice([None, float(rng.randrange(50))])) for i in range(30)])
        n += 30
    _arrive(spark, tmp_path / "in", *files, [("z", AT(2000), -1, 1.0)], [("z", AT(2001), -2, 1.0)])
    folder = str(tmp_path / "out")
    out = streams.row_windows(_stream(spark, tmp_path / "in"), "ts", ["k"], "v", 4, 3, "100 seconds", idle="10000 seconds")
    got = {r.id: (r.rows_before, r.top_values) for r in streams.drain(out, folder).where("id >= 0").collect()}
    want = {}
    for k in "ab":
        own = sorted((r for f in files for r in f if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(own):
            want[r[2]] = [x[3] for x in own[max(0, i - 4) : i]], sorted((x[3] for x in own[: i + 1] if x[3] is not None), reverse=True)[:3]
    assert got == want
    kept = {r.key.k: r.value for r in _states(spark, folder, "kept")}
    assert set(kept) == {"a", "b"} and all(len(json.loads(v.ring)) == 4 and len(json.loads(v.best)) == 3 for v in kept.values())
    assert {r.key.k for r in _states(spark, folder, "open")} == {"z"}


def test_row_windows_forget_idle_keys(spark, tmp_path):
    _arrive(spark, tmp_path / "in", [("a", AT(0), 1, 5.0)], [("b", AT(100), 2, 1.0)], [("b", AT(400), 3, 2.0)], [("a", AT(410), 4, 3.0)], [("b", AT(900), 5, 1.0)], [("b", AT(901), 6, 1.0)])
    out = streams.row_windows(_stream(spark, tmp_path / "in"), "ts", ["k"], "v", 2, 1, "10 seconds", idle="60 seconds")
    got = {r.id: (r.rows_before, r.top_values) for r in streams.drain(out).collect()}
    assert got[1] == ([], [5.0]) and got[4] == ([], [3.0])


def test_open_rows_are_kept_by_the_micro_batch(spark, tmp_path):
    """A key's state has an element for each micro-batch or reading of it, not for each row, and rows put back come out once."""
    rng = random.Random(2)
    rows = [("a", AT(i + rng.random()), i, float(rng.randrange(9))) for i in range(240)]
    _arrive(spark, tmp_path / "in", rows[:100], rows[100:200])
    folder = str(tmp_path / "out")
    run = lambda: streams.drain(streams.row_windows(_stream(spark, tmp_path / "in"), "ts", ["k"], "v", 2, 1, "150 seconds"), folder)
    first = {r.id for r in run().collect()}
    assert 30 < len(first) < 60
    held = [json.loads(r.list_element.rows) for r in _states(spark, folder, "open")]
    assert 1 <= len(held) <= 2 and sorted(at for part in held for at, _, _ in part) == sorted(round((r[1] - AT(0)).total_seconds() * 1_000_000) + 1_704_067_200_000_000 for r in rows[:200] if r[2] not in first)
    _arrive(spark, tmp_path / "in", rows[200:], [("z", AT(9000), -1, 0.0)])
    got = [(r.id, r.rows_before, r.top_values) for r in run().orderBy("id").collect()]
    values = [r[3] for r in rows]
    assert got == [(i, values[max(0, i - 2) : i], [max(values[: i + 1])]) for i in range(240)]
