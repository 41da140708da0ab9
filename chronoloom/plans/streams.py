"""Registered streaming queries, drained over the files of a folder, and sinks read back.

The SQL keeps what the watermark has passed when the input ends: ``w`` is the
latest time, in milliseconds, less the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import series
from chronoloom.sources import sinks, tables
from chronoloom.streaming import streams

_DELAY = "10 minutes"
_W = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
_EACH_W = "(SELECT min(m) FROM (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS m FROM events WHERE event_type IN ('purchase', 'view') GROUP BY event_type))"
_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_type IN ('purchase', 'view'))"
_SEEN = "SELECT event_id, ts, user_id FROM events WHERE event_type = '{}'"
_count = lambda: F.count("*").alias("n")


#: A stream's input may be a folder or a pattern, but not the path of one file; this pattern fits either.
_PATH = "{}/events.parque[t]"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return streams.follow(spark, _PATH.format(d), "ts", _DELAY)


def _raw(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Events as a stream without a watermark."""
    schema = tables.read(spark, d, "events").schema
    df = spark.readStream.schema(schema).parquet(_PATH.format(d)).withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.select("event_id", "ts", "user_id", "event_type", "value")
    return df.where(F.col("event_type") == kind) if kind else df


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def stream_tumbling(spark, d):
    out = streams.windows(_events(spark, d), "ts", "1 hour", ["event_type"], [_count()])
    return _ntz(streams.drain(out))


def stream_sliding(spark, d):
    out = streams.windows(_events(spark, d), "ts", "1 hour", ["event_type"], [_count()], slide="30 minutes")
    return _ntz(streams.drain(out))


def stream_sessions(spark, d):
    return _ntz(streams.drain(streams.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"], [_count()])))


def stream_left_join(spark, d):
    bought = _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = _events(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("v_user"), F.col("ts").alias("v_ts"))
    out = streams.left_join_within(bought, seen, "ts", "v_ts", F.col("user_id") == F.col("v_user"), "1 hour")
    return streams.drain(out.select("event_id", "user_id", "view_id"))


def stream_distinct(spark, d):
    twice = _events(spark, d).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return streams.drain(streams.distinct_within(twice, ["event_id"]).select("event_id"))


def stream_asof(spark, d):
    bought = _raw(spark, d, "purchase").select("event_id", "ts", "user_id")
    seen = _raw(spark, d, "view").select("ts", "user_id", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = streams.asof(bought, seen, "ts", ["user_id"], ["view_id", "view_value"], _DELAY)
    out = out.select("event_id", "user_id", F.col("right_view_id").alias("view_id"), F.col("right_view_value").alias("view_value"))
    return streams.drain(out)


def stream_fill(spark, d):
    df = _raw(spark, d).select("event_id", "ts", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("v"))
    return streams.drain(streams.fill_forward(df, "ts", "v", ["user_id"], _DELAY)).select("event_id", "user_id", "filled")


def _bought_and_seen(spark, d, tolerance, direction):
    bought = _raw(spark, d, "purchase").select("event_id", "ts", "user_id")
    seen = _raw(spark, d, "view").select("ts", "user_id", F.col("event_id").alias("view_id"))
    out = streams.asof_within(bought, seen, "ts", ["user_id"], ["view_id"], _DELAY, tolerance, direction)
    return streams.drain(out.select("event_id", "user_id", F.col("right_view_id").alias("view_id")))


def stream_asof_nearest(spark, d):
    return _bought_and_seen(spark, d, "2 hours", "nearest")


def stream_asof_forward(spark, d):
    return _bought_and_seen(spark, d, "6 hours", "forward")


def stream_rows(spark, d):
    df = _raw(spark, d).select("event_id", "ts", "user_id", "value")
    rows = streams.drain(streams.row_windows(df, "ts", ["user_id"], "value", 3, 2, _DELAY))
    last = F.concat("rows_before", F.array("value"))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
    return rows.select("event_id", F.try_element_at("rows_before", F.lit(-1)).alias("before"), F.try_element_at("rows_before", F.lit(-3)).alias("third_before"), F.round(mean, 4).alias("mean"), F.element_at("top_values", 1).alias("best"), F.try_element_at("top_values", F.lit(2)).alias("second_best"))


def stream_late(spark, d):
    """Hourly counts of rows that arrive in three batches, each over the whole time: in the third, what the watermark of the one before last had passed is dropped."""
    folder = streams.shared_folder(spark, "late")
    df = tables.read(spark, d, "events").select("event_id", "ts", "event_type")
    for turn in (1, 2, 0):
        tables.save(df.where(F.col("event_id") % 3 == turn).coalesce(1), folder, mode="append")
    arriving = streams.follow(spark, folder, "ts", _DELAY, arrive=1)
    return _ntz(streams.drain(streams.windows(arriving, "ts", "1 hour", ["event_type"], [_count()])))


def sink_replayed(spark, d):
    """Events delivered in three micro-batches, each of which is brought twice, as after a failure; and which batch holds each."""
    folder = streams.shared_folder(spark, "delivered")
    df = tables.read(spark, d, "events").select("event_id", "ts", "value")
    for turn in range(3):
        tables.save(df.where(F.col("event_id") % 3 == turn).coalesce(1), f"{folder}/in", mode="append")
    write = sinks.to_files(f"{folder}/out")

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.deliver(arriving, twice, f"{folder}/progress")
    return sinks.read_batches(spark, f"{folder}/out", "event_id bigint, ts timestamp_ntz, value double")


def _kept_as(format: str, name: str, by: list[str] | None = None, **options):
    """A query that writes a table in a format and reads it again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = tables.read(spark, d, name)
        path = streams.shared_folder(spark, "table")
        tables.save(df, path, format, by, **options)
        schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
        return tables.scan(spark, path, format, schema, **options).select(*df.columns)

    return run


#: Name: the query and its SQL.
STREAMS = {
    "stream_tumbling": (stream_tumbling, f"SELECT event_type, s AS bucket_start, n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS s, count(*) AS n FROM events GROUP BY 1, 2) WHERE s + INTERVAL 1 HOUR <= {_W}"),
    "stream_sliding": (stream_sliding, f"SELECT event_type, s AS bucket_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE FOR k IN [0, 1]]) AS s FROM events) WHERE s + INTERVAL 1 HOUR <= {_W} GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, f"SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_W}"),
    "stream_left_join": (stream_left_join, f"SELECT p.event_id, p.user_id, v.event_id AS view_id FROM events p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts WHERE p.event_type = 'purchase' AND (v.event_id IS NOT NULL OR p.ts <= {_EACH_W})"),
    "stream_distinct": (stream_distinct, "SELECT DISTINCT event_id FROM events"),
    "stream_asof": (stream_asof, f"SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_type IN ('purchase', 'view'))"),
    "stream_fill": (stream_fill, f"SELECT event_id, user_id, filled FROM (SELECT event_id, user_id, ts, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS filled FROM events) WHERE ts <= {_W}"),
    "stream_asof_nearest": (
        stream_asof_nearest,
        f"WITH p AS ({_SEEN.format('purchase')}), v AS ({_SEEN.format('view')}), b AS (SELECT p.event_id, v.event_id AS b_id, p.ts - v.ts AS far FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts), "
        "f AS (SELECT p.event_id, v.event_id AS f_id, v.ts - p.ts AS far FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts) "
        "SELECT p.event_id, p.user_id, CASE WHEN b.far <= INTERVAL 2 HOUR AND (f.far IS NULL OR b.far <= f.far) THEN b_id WHEN f.far <= INTERVAL 2 HOUR THEN f_id END AS view_id "
        f"FROM p LEFT JOIN b USING (event_id) LEFT JOIN f USING (event_id) WHERE p.ts + INTERVAL 2 HOUR <= {_CLOSED}",
    ),
    "stream_asof_forward": (
        stream_asof_forward,
        f"SELECT p.event_id, p.user_id, CASE WHEN v.ts <= p.ts + INTERVAL 6 HOUR THEN v.event_id END AS view_id FROM ({_SEEN.format('purchase')}) p ASOF LEFT JOIN ({_SEEN.format('view')}) v ON p.user_id = v.user_id AND p.ts <= v.ts WHERE p.ts + INTERVAL 6 HOUR <= {_CLOSED}",
    ),
    "stream_rows": (
        stream_rows,
        "SELECT event_id, lag(value) OVER w AS before, lag(value, 3) OVER w AS third_before, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean, "
        "list_extract(list_reverse_sort(list(value) OVER w), 1) AS best, list_extract(list_reverse_sort(list(value) OVER w), 2) AS second_best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY ts <= " + _W,
    ),
    "stream_late": (
        stream_late,
        "SELECT event_type, s AS bucket_start, count(*) AS n FROM (SELECT event_id, event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events) "
        f"WHERE s + INTERVAL 1 HOUR <= {_W} AND (event_id % 3 <> 0 OR s + INTERVAL 1 HOUR > (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_id % 3 = 1)) GROUP BY 1, 2",
    ),
    "sink_replayed": (sink_replayed, "SELECT event_id, ts, value, (event_id % 3)::BIGINT AS batch FROM events"),
    "kept_csv": (_kept_as("csv", "customer", header=True), "SELECT * FROM customer"),
    "kept_json": (_kept_as("json", "supplier"), "SELECT * FROM supplier"),
    "kept_orc": (_kept_as("orc", "orders", ["o_orderstatus"]), "SELECT * FROM orders"),
}
