"""Registered queries over the tables of a folder, with DuckDB SQL beside each.

Sums and means of doubles are rounded to 4 places on both sides, since their
last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import forms, quantiles
from chronoloom.functions import sketches as stored
from chronoloom.operators import chains, clocks, lags, ranges, series, warping
from chronoloom.plans.relational import RELATIONAL
from chronoloom.plans.streams import STREAMS
from chronoloom.sources.tables import read, save
from chronoloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str]] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.where(F.col("event_type") == kind) if kind else e


_R = lambda c, name: F.round(c, 4).alias(name)
_P = "(SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') p"
_V = "(SELECT ts, user_id, event_id, value FROM events WHERE event_type = 'view') v"


def _matched(spark: SparkSession, d: str, **options) -> DataFrame:
    left = _events(spark, d, "purchase").select("event_id", "ts", "user_id")
    right = _events(spark, d, "view")
    out = series.asof(left, right, "ts", ["user_id"], ["event_id", "value"], **options)
    return out.select("event_id", "user_id", F.col("right_event_id").alias("view_id"), F.col("right_value").alias("view_value"))


_ASOF = "SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM {p} ASOF LEFT JOIN {v} ON p.user_id = v.user_id AND p.ts {op} v.ts"


@_query(_ASOF.format(p=_P, v=_V, op=">="))
def asof_backward(spark, d):
    return _matched(spark, d)


@_query(_ASOF.format(p=_P, v=_V, op="<="))
def asof_forward(spark, d):
    return _matched(spark, d, direction="forward")


@_query(
    "SELECT event_id, user_id, CASE WHEN near THEN view_id END AS view_id, CASE WHEN near THEN view_value END AS view_value FROM ("
    "SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value, p.ts - v.ts <= INTERVAL 1 HOUR AS near "
    f"FROM {_P} ASOF LEFT JOIN {_V} ON p.user_id = v.user_id AND p.ts >= v.ts)"
)
def asof_tolerance(spark, d):
    return _matched(spark, d, tolerance="1 hour")


@_query(
    "SELECT b.event_id, b.user_id, CASE WHEN b.t IS NOT NULL AND (f.t IS NULL OR b.ts - b.t <= f.t - b.ts) THEN b.i ELSE f.i END AS view_id, "
    "CASE WHEN b.t IS NOT NULL AND (f.t IS NULL OR b.ts - b.t <= f.t - b.ts) THEN b.x ELSE f.x END AS view_value FROM "
    f"(SELECT p.event_id, p.user_id, p.ts, v.ts AS t, v.event_id AS i, v.value AS x FROM {_P} ASOF LEFT JOIN {_V} ON p.user_id = v.user_id AND p.ts >= v.ts) b JOIN "
    f"(SELECT p.event_id, v.ts AS t, v.event_id AS i, v.value AS x FROM {_P} ASOF LEFT JOIN {_V} ON p.user_id = v.user_id AND p.ts <= v.ts) f USING (event_id)"
)
def asof_nearest(spark, d):
    return _matched(spark, d, direction="nearest")


@_query(
    "SELECT s.o_orderkey, max(t.o_orderdate) AS earlier FROM orders s LEFT JOIN orders t ON s.o_custkey = t.o_custkey AND t.o_orderdate < s.o_orderdate GROUP BY s.o_orderkey"
)
def asof_strict(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return series.asof(o, o, "o_orderdate", ["o_custkey"], [], allow_exact=False).select("o_orderkey", F.col("right_o_orderdate").alias("earlier"))


@_query(
    "SELECT user_id, time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
)
def bucket_tumbling(spark, d):
    return series.bucket(_events(spark, d), "ts", "7 minutes", ["user_id"], [F.count("*").alias("n"), _R(F.sum("value"), "total")])


@_query(
    "SELECT event_type, s AS bucket_start, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE "
    "FOR k IN [0, 1, 2, 3]]) AS s FROM events) GROUP BY 1, 2"
)
def bucket_sliding(spark, d):
    return series.bucket(_events(spark, d), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")], slide="15 minutes")


@_query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket_start, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def bucket_calendar(spark, d):
    return series.calendar_bucket(_events(spark, d), "ts", "day", ["event_type"], [F.count("*").alias("n"), _R(F.avg("value"), "mean"), F.min("value").alias("low"), F.max("value").alias("high")])


@_query(
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ("
    "SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"
)
def sessions(spark, d):
    return series.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])


@_query(
    "SELECT user_id, t AS ts, v0 AS before, v1 AS after, round(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * date_sub('microsecond', t0, t) / date_sub('microsecond', t0, t1) END, 4) AS linear FROM ("
    "SELECT *, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, t0 + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), coalesce(t1 - INTERVAL 1 MICROSECOND, t0), INTERVAL 1 HOUR)) AS t "
    "FROM (SELECT user_id, ts AS t0, value AS v0, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t1, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS v1 FROM events))"
)
def interpolate_hourly(spark, d):
    return series.interpolate(_events(spark, d), "ts", "value", "1 hour", ["user_id"]).withColumn("linear", F.round("linear", 4))


@_query(
    "SELECT a.event_id AS click_id, b.event_id AS error_id FROM events a JOIN events b ON b.ts BETWEEN a.ts AND a.ts + INTERVAL 5 SECOND WHERE a.event_type = 'click' AND b.event_type = 'error'"
)
def interval_join(spark, d):
    a = _events(spark, d, "click").select(F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    b = _events(spark, d, "error").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return series.interval_join(a, b, "click_ts", "error_ts", "5 seconds").select("click_id", "error_id")


@_query(
    "SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'"
)
def interval_join_keyed(spark, d):
    a = _events(spark, d, "view").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("a"))
    b = _events(spark, d, "purchase").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("b"))
    return series.interval_join(a, b, "a", "b", "1 hour", ["user_id"]).select("view_id", "purchase_id")


@_query(
    "SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 3 HOUR AND a.ts - INTERVAL 10 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'purchase'"
)
def interval_join_before(spark, d):
    a = _events(spark, d, "view").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("a"))
    b = _events(spark, d, "purchase").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("b"))
    return series.interval_join(a, b, "a", "b", "-10 minutes", ["user_id"], lower="-3 hours").select("view_id", "purchase_id")


@_query(
    "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"
)
def rolling_time(spark, d):
    out = series.rolling(_events(spark, d), "ts", ["user_id"], "1 day", {"n": "count(*)", "total": "sum(value)"})
    return out.select("event_id", "n", F.round("total", 4).alias("total"))


@_query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS high FROM events")
def rolling_rows(spark, d):
    return series.rolling(_events(spark, d), "ts", ["user_id"], 4, {"high": "max(value)"}).select("event_id", "high")


@_query(
    "SELECT event_id, round(value - lag(value) OVER w, 4) AS change, date_sub('microsecond', lag(ts) OVER w, ts) AS elapsed_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
)
def differences(spark, d):
    return series.delta(_events(spark, d), "ts", "value", ["user_id"]).select("event_id", _R(F.col("change"), "change"), "elapsed_us")


@_query(
    "SELECT user_id, bucket_start, round(a, 4) AS views, round(b, 4) AS purchases FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket_start, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1, 2) "
    "FULL JOIN (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket_start, avg(value) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) USING (user_id, bucket_start)"
)
def align_daily(spark, d):
    out = series.align({"views": _events(spark, d, "view"), "purchases": _events(spark, d, "purchase")}, "ts", "day", "value", ["user_id"])
    return out.select("user_id", "bucket_start", _R(F.col("views"), "views"), _R(F.col("purchases"), "purchases"))


@_query(
    "WITH x AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1), "
    "y AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, avg(value) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) "
    "SELECT k::INTEGER AS lag_hours, round(corr(a, b), 4) AS corr, count(*) AS n FROM (SELECT unnest(range(-3, 4)) AS k) CROSS JOIN x JOIN y ON y.h = x.h + k * INTERVAL 1 HOUR GROUP BY k"
)
def cross_correlation(spark, d):
    return series.cross_correlation(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", 3).withColumn("corr", F.round("corr", 4))


@_query(_ASOF.format(p=_P, v=_V, op=">="))
def asof_backward_stretches(spark, d):
    return _matched(spark, d, stretch="5 days")


@_query(_ASOF.format(p=_P, v=_V, op="<="))
def asof_forward_stretches(spark, d):
    return _matched(spark, d, direction="forward", stretch="5 days")


@_query(_QUERIES["asof_nearest"][1])
def asof_nearest_stretches(spark, d):
    return _matched(spark, d, direction="nearest", stretch="5 days")


@_query(_QUERIES["interpolate_hourly"][1])
def interpolate_hourly_stretches(spark, d):
    return series.interpolate(_events(spark, d), "ts", "value", "1 hour", ["user_id"], "7 days").withColumn("linear", F.round("linear", 4))


@_query(_QUERIES["rolling_time"][1])
def rolling_time_stretches(spark, d):
    out = series.rolling(_events(spark, d), "ts", ["user_id"], "1 day", {"n": "count(*)", "total": "sum(value)"}, "3 days")
    return out.select("event_id", "n", F.round("total", 4).alias("total"))


@_query(_QUERIES["rolling_rows"][1])
def rolling_rows_stretches(spark, d):
    return series.rolling(_events(spark, d), "ts", ["user_id"], 4, {"high": "max(value)"}, 10, ["event_id"]).select("event_id", "high")


@_query(_QUERIES["differences"][1])
def differences_stretches(spark, d):
    return series.delta(_events(spark, d), "ts", "value", ["user_id"], "2 days").select("event_id", _R(F.col("change"), "change"), "elapsed_us")


@_query(
    "SELECT user_id, min(ts) AS session_start, max(e) AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM ("
    "SELECT *, CASE WHEN ts < max(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh "
    "FROM (SELECT *, ts + CASE WHEN event_type = 'purchase' THEN INTERVAL 6 HOUR ELSE INTERVAL 1 HOUR END AS e FROM events))) GROUP BY user_id, s"
)
def sessions_by_row(spark, d):
    gap = F.when(F.col("event_type") == "purchase", "6 hours").otherwise("1 hour")
    return series.sessions(_events(spark, d), "ts", gap, ["user_id"], [F.count("*").alias("n")])


@_query(_QUERIES["sessions"][1])
def sessions_stretches(spark, d):
    return series.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")], stretch="2 days")


@_query(_QUERIES["sessions_by_row"][1])
def sessions_by_row_stretches(spark, d):
    gap = F.when(F.col("event_type") == "purchase", "6 hours").otherwise("1 hour")
    return series.sessions(_events(spark, d), "ts", gap, ["user_id"], [F.count("*").alias("n")], stretch="3 hours")


@_query(
    "SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, a + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01'), b, INTERVAL 1 HOUR)) AS ts "
    "FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)"
)
def grid_hourly(spark, d):
    return series.grid(_events(spark, d), "ts", "1 hour", ["user_id"])


_GAPS = "SELECT event_id, last_value({v} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events"


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("value", F.when(F.col("event_type") == "view", F.col("value")))


@_query(_GAPS.format(v="CASE WHEN event_type = 'view' THEN value END", o=""))
def fill_forward(spark, d):
    return series.fill(_gappy(spark, d), "ts", "value", ["user_id"]).select("event_id", "value")


@_query(_GAPS.format(v="CASE WHEN event_type = 'view' THEN value END", o="DESC"))
def fill_backward(spark, d):
    return series.fill(_gappy(spark, d), "ts", "value", ["user_id"], "backward").select("event_id", "value")


@_query(_GAPS.format(v="CASE WHEN event_type = 'view' THEN value END", o=""))
def fill_forward_stretches(spark, d):
    return series.fill(_gappy(spark, d), "ts", "value", ["user_id"], stretch="1 day").select("event_id", "value")


@_query(_GAPS.format(v="CASE WHEN event_type = 'view' THEN value END", o="DESC"))
def fill_backward_stretches(spark, d):
    return series.fill(_gappy(spark, d), "ts", "value", ["user_id"], "backward", stretch="1 day").select("event_id", "value")


@_query(
    "WITH x AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1), "
    "y AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, avg(value) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) "
    "SELECT arg_max(k, r)::INTEGER AS lag_hours, round(max(r), 4) AS corr FROM ("
    "SELECT k, corr(a, b) AS r FROM (SELECT unnest(range(-3, 4)) AS k) CROSS JOIN x JOIN y ON y.h = x.h + k * INTERVAL 1 HOUR GROUP BY k)"
)
def clock_offset(spark, d):
    return series.clock_offset(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", 3).withColumn("corr", F.round("corr", 4))


@_query(
    "WITH p AS (SELECT user_id, event_type, list(v ORDER BY t) AS s FROM (SELECT user_id, event_type, date_trunc('day', ts) AS t, avg(value) AS v FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL) GROUP BY ALL) "
    "SELECT a.user_id, round(list_reduce(list_transform(a.s, lambda v: [v]), lambda before, x: "
    "list_reduce(list_transform(b.s, lambda v: [v]), lambda row, y: list_append(row, abs(x[1] - y[1]) + least(row[len(row)], before[len(row) + 1], before[len(row)])), ['inf'::DOUBLE]), "
    "list_prepend(0::DOUBLE, list_transform(b.s, lambda v: 'inf'::DOUBLE)))[-1], 4) AS distance FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'"
)
def dtw_daily(spark, d):
    return series.dtw(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", "day", ["user_id"]).withColumn("distance", F.round("distance", 4))


@_query(_QUERIES["dtw_daily"][1])
def dtw_cogrouped(spark, d):
    # A band as wide as the longest series leaves every path open.
    return forms.banded_dtw(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", "day", ["user_id"], 400).withColumn("distance", F.round("distance", 4))


@_query(
    "SELECT user_id, bucket_start, round(list_reduce(list(v) OVER (PARTITION BY user_id ORDER BY bucket_start), lambda a, b: a * 2 / 3 + b / 3), 4) AS smooth "
    "FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket_start, avg(value) AS v FROM events GROUP BY 1, 2)"
)
def smoothed_daily(spark, d):
    return forms.smoothed(_events(spark, d), "ts", "value", "day", ["user_id"], 1 / 3).withColumn("smooth", F.round("smooth", 4))


@_query("SELECT p_partkey, nfc_normalize(p_name || 'e' || chr(769)) AS composed FROM part")
def composed_names(spark, d):
    return read(spark, d, "part").select("p_partkey", forms.nfc(F.concat("p_name", F.lit("e\u0301"))).alias("composed"))


@_query(
    "SELECT p_partkey, w AS word, (instr(' ' || p_name || ' ', ' ' || w || ' ') - 1)::INTEGER AS at FROM (SELECT p_partkey, p_name, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) WHERE w <> ''"
)
def part_words(spark, d):
    words = forms.Words(F.col("p_name").outer())
    found = read(spark, d, "part").select("p_partkey", "p_name").lateralJoin(words)
    return found.groupBy("p_partkey", "word").agg(F.min("at").alias("at"))


@_query("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t WHERE c_nationkey < 5")
def lateral_frame(spark, d):
    # As in lateral_top, the row number has its own order, which a correlated orderBy().limit() has not.
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    ranked = read(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("rn"))
    top = ranked.where(F.col("o_custkey") == F.col("c_custkey").outer()).where("rn <= 2").select("o_orderkey")
    return read(spark, d, "customer").where("c_nationkey < 5").lateralJoin(top).select("c_custkey", "o_orderkey")


@_query("SELECT event_type, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS q2 FROM events GROUP BY event_type")
def percentiles(spark, d):
    found = quantiles.exact_quantiles(_events(spark, d), ["event_type"], "value", [0.25, 0.5])
    pick = lambda q, name: F.round(F.max(F.when(F.col("q") == q, F.col("quantile"))), 4).alias(name)
    return found.groupBy("event_type").agg(pick(0.25, "q1"), pick(0.5, "q2"))


def _two_clocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events, and six in seven of them as another clock saw them: 2.5 s and 40 ppm off, and up to a millisecond of noise."""
    x = _events(spark, d).select("event_id", "ts", "user_id")
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    seen = 2_500_000 + F.floor(us / 25_000) + F.col("event_id") * 7919 % 2001 - 1000
    return x.drop("event_id"), x.where("event_id % 7 <> 0").select("user_id", F.timestamp_add("MICROSECOND", seen, F.col("ts")).alias("ts"))


@_query(
    "WITH x AS (SELECT user_id, ts FROM events), y AS (SELECT user_id, ts + to_microseconds(2500000 + date_sub('microsecond', TIMESTAMP '2024-01-01', ts) // 25000 + event_id * 7919 % 2001 - 1000) AS ts FROM events WHERE event_id % 7 <> 0), "
    "b AS (SELECT x.user_id, x.ts, y.ts AS m FROM x ASOF JOIN y ON x.user_id = y.user_id AND x.ts >= y.ts), f AS (SELECT x.user_id, x.ts, y.ts AS m FROM x ASOF JOIN y ON x.user_id = y.user_id AND x.ts <= y.ts), "
    "n AS (SELECT x.ts, CASE WHEN b.m IS NOT NULL AND (f.m IS NULL OR x.ts - b.m <= f.m - x.ts) THEN b.m ELSE f.m END AS m FROM x LEFT JOIN b USING (user_id, ts) LEFT JOIN f USING (user_id, ts)), "
    "p AS (SELECT date_sub('microsecond', (SELECT min(ts) FROM x), ts) AS since, date_sub('microsecond', ts, m) AS apart FROM n WHERE abs(date_sub('microsecond', ts, m)) <= 300000000) "
    "SELECT round(regr_intercept(apart, since), 0) AS offset_us, round(regr_slope(apart, since) * 1e6, 3) AS drift_ppm, count(*) AS matched FROM p"
)
def clock_fit_once(spark, d):
    x, y = _two_clocks(spark, d)
    out = clocks.clock_drift(x, y, "ts", ["user_id"], tolerance="5 minutes", rounds=1, robust=False)
    return out.select(F.round("offset_us", 0).alias("offset_us"), F.round("drift_ppm", 3).alias("drift_ppm"), "matched")


@_query("")
def clock_drift(spark, d):
    return clocks.clock_drift(*_two_clocks(spark, d), "ts", ["user_id"], tolerance="5 minutes")


@_query("")
def warping_path_daily(spark, d):
    return warping.warping_path(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", "day", ["user_id"])


@_query("")
def nearest_series_daily(spark, d):
    events = _events(spark, d)
    out = warping.nearest_series(events, events.where("user_id % 20 = 0"), "ts", "value", "day", "user_id", 3, k=3)
    return out.withColumn("distance", F.round("distance", 4))


@_query(
    "WITH x AS (SELECT epoch_us(ts) // 60000000 AS bin, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1), y AS (SELECT epoch_us(ts) // 60000000 AS bin, avg(value) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) "
    "SELECT y.bin - x.bin AS lag, round(corr(a, b), 4) AS corr, count(*) AS n FROM x JOIN y ON y.bin - x.bin BETWEEN -2000 AND 2000 GROUP BY 1"
)
def lag_correlation_minutes(spark, d):
    out = lags.lag_correlation(_events(spark, d, "view"), _events(spark, d, "purchase"), "ts", "value", "1 minute", 2000)
    return out.withColumn("corr", F.round("corr", 4))


@_query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal < s_acctbal")
def inequality_join(spark, d):
    a, b = read(spark, d, "customer").select("c_custkey", "c_acctbal"), read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return ranges.inequality_join(a, b, "c_acctbal", "s_acctbal").select("c_custkey", "s_suppkey")


@_query(
    "WITH RECURSIVE p AS (SELECT event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN lag(event_id) OVER w END AS parent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "r AS (SELECT event_id, event_id AS root, 0::BIGINT AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.event_id, r.root, r.depth + 1 FROM p JOIN r ON p.parent = r.event_id) SELECT * FROM r"
)
def event_chains(spark, d):
    """Each event's chain: events of a user that follow one another within six hours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    near = F.lag("ts").over(w) >= F.col("ts") - F.expr("INTERVAL 6 HOURS")
    linked = _events(spark, d).select("event_id", F.when(near, F.lag("event_id").over(w)).alias("parent"))
    return chains.roots(linked, "event_id", "parent")


@_query(
    "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket_start, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 4) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1, 2"
)
def align_five(spark, d):
    kinds = ("click", "error", "purchase", "signup", "view")
    out = series.align({k: _events(spark, d, k) for k in kinds}, "ts", "day", "value", ["user_id"])
    return out.select("user_id", "bucket_start", *[_R(F.col(k), k) for k in kinds])


def _near_exact(rows: DataFrame, exact: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """Exact figures, and whether the sketches are within the errors that they promise (four standard deviations)."""
    both = rows.join(exact, by).join(ranks, by)
    within = lambda c: F.abs(F.col(c) - F.col("users")) <= F.ceil(0.065 * F.col("users"))
    return both.select(*by, "n", "users", F.round("middle", 4).alias("middle"), within("distinct_hll").alias("hll_near"), within("distinct_theta").alias("theta_near"), (F.col("rank_error") <= 0.02).alias("kll_near"))


def _rank_errors(events: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """How far the rank of each estimated median is from the middle, among the rows themselves."""
    held = events.join(rows.select(*by, "quantile"), by)
    below, upto = (F.avg((F.col("value") < F.col("quantile")).cast("int")), F.avg((F.col("value") <= F.col("quantile")).cast("int")))
    return held.groupBy(*by).agg(F.greatest(below - 0.5, 0.5 - upto, F.lit(0)).alias("rank_error"))


def _exact_figures(events: DataFrame, by: list[str]) -> DataFrame:
    middles = quantiles.exact_quantiles(events, by, "value", [0.5]).select(*by, F.col("quantile").alias("middle"))
    return events.groupBy(*by).agg(F.count_distinct("user_id").alias("users")).join(middles, by)


@_query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 4) AS middle, true AS hll_near, true AS theta_near, true AS kll_near FROM events GROUP BY event_type")
def sketches(spark, d):
    events = _events(spark, d)
    rows = stored.estimates(stored.rolled_up(stored.summarised(events, "ts", "hour", ["event_type"], "user_id", "value"), None, ["event_type"]), 0.5)
    return _near_exact(rows, _exact_figures(events, ["event_type"]), ["event_type"], _rank_errors(events, rows, ["event_type"]))


@_query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket_start, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 4) AS middle, true AS hll_near, true AS theta_near, true AS kll_near FROM events GROUP BY 1")
def sketch_rollup(spark, d):
    """Sketches stored by type and hour, read again, and rolled up to days of all types without the rows."""
    path = streams.shared_folder(spark, "sketches")
    save(stored.summarised(_events(spark, d), "ts", "hour", ["event_type"], "user_id", "value"), path)
    rows = stored.estimates(stored.rolled_up(spark.read.parquet(path), "day", []), 0.5)
    events = _events(spark, d).withColumn("bucket_start", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return _near_exact(rows, _exact_figures(events, ["bucket_start"]), ["bucket_start"], _rank_errors(events, rows, ["bucket_start"]))


@_query(
    "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1, 2) "
    "SELECT day, count(*) FILTER (WHERE v AND p) AS \"both\", true AS near FROM d GROUP BY day"
)
def sketch_overlap(spark, d):
    """Users who both viewed and bought on a day, from the theta sketches of views and of purchases."""
    store = stored.summarised(_events(spark, d), "ts", "hour", ["event_type"], "user_id", "value")
    daily = stored.rolled_up(store, "day", ["event_type"])
    side = lambda kind, name: daily.where(F.col("event_type") == kind).select("bucket_start", F.col("theta").alias(name))
    found = side("view", "a").join(side("purchase", "b"), "bucket_start", "full")
    found = found.select("bucket_start", F.coalesce(stored.overlap(F.col("a"), F.col("b")), F.lit(0)).alias("near"), F.coalesce(F.theta_sketch_estimate(F.coalesce(F.theta_union("a", "b"), "a", "b")), F.lit(0)).alias("all"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    exact = _events(spark, d).groupBy(day, "user_id").agg((has("view") & has("purchase")).alias("is_both")).groupBy("day").agg(F.sum(F.col("is_both").cast("long")).alias("both"))
    # An intersection errs by its sets' union, not by its own size.
    return exact.join(found, F.col("day") == F.col("bucket_start"), "left").select("day", "both", (F.abs(F.coalesce("near", F.lit(0)) - F.col("both")) <= F.ceil(0.065 * F.coalesce("all", F.lit(0)))).alias("near"))


@_query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), "
    "r AS (SELECT user_id, event_id, k, ts AS last, true AS admitted, 0 AS skipped FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ts >= r.last + INTERVAL 12 HOUR THEN e.ts ELSE r.last END, "
    "e.ts >= r.last + INTERVAL 12 HOUR, CASE WHEN e.ts >= r.last + INTERVAL 12 HOUR THEN 0 ELSE r.skipped + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, admitted, skipped FROM r"
)
def spaced_events(spark, d):
    return forms.spaced(_events(spark, d), "event_id", "ts", "12 hours", "user_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()} | {k: lambda spark, d, q=spark_sql: _sql(spark, d, q) for k, (spark_sql, _) in RELATIONAL.items()} | {k: f for k, (f, _) in STREAMS.items()}


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Spark SQL over the folder's tables, named in the text as {table}."""
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if "{" + n + "}" in text]
    return spark.sql(text, **{n: read(spark, d, n) for n in names})


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql} | {k: sql for k, (_, sql) in (RELATIONAL | STREAMS).items()}
