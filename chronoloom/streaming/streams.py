"""The time-series operators over unbounded input, with Structured Streaming.

Event times are ``timestamp`` (a watermark takes no other type) and the session
zone is UTC.  Rows at or before the watermark that the micro-batch before had
count as late and are dropped by the stateful operators; windows, sessions and unmatched rows come out once the
watermark has passed them, so a drained stream equals the batch operator on the
closed prefix.  State is evicted by the watermark, so its size follows the delay
and the number of live keys, not the length of the stream.  It is kept in RocksDB,
outside the executors' heap.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoloom.operators import series
from chronoloom.sources import sinks

#: Rows in one text of a state's list that is put back.
_PACKED = 10_000
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def follow(spark: SparkSession, path: str, time: str, delay: str, format: str = "parquet", arrive: int | None = None, **options) -> DataFrame:
    """A stream of the files under ``path`` with a watermark ``delay`` behind the latest ``time``; rows without a time are left out.

    With ``arrive``, a micro-batch takes that many files.
    """
    schema = spark.read.format(format).options(**options).load(path).schema
    files = spark.readStream.schema(schema).format(format).options(**options)
    df = (files.option("maxFilesPerTrigger", arrive) if arrive else files).load(path)
    return df.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, delay)


def windows(df: DataFrame, time: str, every: str, by: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of a watermarked stream."""
    return series.bucket(df, time, every, by, aggs, slide)


def sessions(df: DataFrame, time: str, gap: str | Column, by: list[str], aggs: list[Column]) -> DataFrame:
    """Sessions of a watermarked stream."""
    return series.sessions(df, time, gap, by, aggs)


def left_join_within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: Column, width: str) -> DataFrame:
    """Each left row with the right rows of the ``width`` before it; left rows without one come out when none can follow."""
    near = F.col(right_time).between(F.col(left_time) - F.expr(f"INTERVAL {width}"), F.col(left_time))
    return left.join(right, on & near, "left")


def distinct_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key among rows no farther apart than the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def asof(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], delay: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, once the watermark has passed it.

    Adds ``right_<time>`` and ``right_<value>``.  Per key the state holds, as a
    list, the rows that the watermark has not passed, and the latest right row that
    it has.  New rows are appended without reading the list; a timer has it read
    when the watermark passes some of them.  A null key matches nothing.  Of tied
    right rows the one whose values are largest as JSON text matches.  ``left`` and
    ``right`` come without a watermark of their own; the session's state store must
    be RocksDB, which ``drain`` sees to.
    """
    return _matched(left, right, time, by, values, delay, _AsOf())


def asof_within(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], delay: str, tolerance: str, direction: str = "nearest") -> DataFrame:
    """Each left row with its match no farther than ``tolerance``, once no row that could be a nearer one can come.

    ``forward`` takes the first right row at or after the left one, ``nearest`` the
    nearer of that and the last one at or before it (the earlier of two equally
    near), ``backward`` the latter.  A left row that looks ahead waits until the
    watermark has passed it by the tolerance; a right row goes when no left row can
    look as far.  So a key's state holds what the tolerance spans beside what the
    delay does, and is empty after that.  Ties, null keys and the rest are as in ``asof``.
    """
    ahead, behind = direction != "backward", direction != "forward"
    return _matched(left, right, time, by, values, delay, _AsOfWithin(_micros(tolerance), ahead, behind))


def _micros(interval: str) -> int:
    """Microseconds of an interval of weeks, days, hours, minutes, seconds or parts of them, as SQL text."""
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def _matched(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], delay: str, processor: StatefulProcessor) -> DataFrame:
    names = [time, *values]
    row = lambda cols: F.to_json(F.struct(*cols), _JSON)
    keyed = lambda df, side, text: df.where(F.col(time).isNotNull()).select(*by, F.col(time).cast("timestamp").alias("_at"), F.lit(side).alias("side_left"), text.alias("row_text"))
    usable = right.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    both = keyed(left, True, row(left.columns)).unionByName(keyed(usable, False, row(names)))
    both = both.withWatermark("_at", delay).withColumn("at_us", F.unix_micros("_at"))
    found = both.groupBy(*by).transformWithStateInPandas(processor, "_l string, _r string", "append", "EventTime")
    kinds = lambda df, cols: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    found = found.select(F.from_json("_l", kinds(left, left.columns), _JSON).alias("_l"), F.from_json("_r", kinds(right, names), _JSON).alias("_r"))
    return found.select("_l.*", *[F.col(f"_r.{c}").alias(f"right_{c}") for c in names])


class _Waiting(StatefulProcessor):
    """Rows of a key that wait, as (microseconds, is it a left row, row), for the watermark to pass the time at which they leave.

    Rows of a micro-batch are appended as one text, or a few, without reading the
    list: what a state costs goes with its calls, of which a key makes a handful,
    whatever its rows.  A timer for the first of those that are to leave has the list
    read, and what stays put back.  Right rows come before left ones of the same time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "rows string")

    def leaves(self, at: int, is_left: bool) -> int:
        """The time by which the row is done with."""
        return at

    def passed(self, rows: list[tuple], until: int) -> list[tuple]:
        """Output for all waiting rows, in order, of which those that leave by ``until`` are about to."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(zip(pdf["at_us"].tolist(), pdf["side_left"].tolist(), pdf["row_text"].tolist()))
            self._open.appendValue((json.dumps(new),))
            leave = min(self.leaves(at, is_left) for at, is_left, _ in new)
            first = leave if first is None else min(first, leave)
        # The rows after the first are seen to when it leaves.
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(x) for (text,) in self._open.get() for x in json.loads(text))
        out = self.passed(rows, until) if rows else []
        held = [x for x in rows if self.leaves(*x[:2]) > until]
        if held:
            if len(held) < len(rows):
                self._open.put([(json.dumps(held[k : k + _PACKED]),) for k in range(0, len(held), _PACKED)])
            self._wake(min(self.leaves(*x[:2]) for x in held))
        else:
            if rows:
                self._open.clear()
            self.idle(until)
        if out:
            yield pd.DataFrame(out, columns=["_l", "_r"], dtype=object)

    def idle(self, until: int) -> None:
        """No row of the key waits."""

    def _wake(self, us: int) -> None:
        """Has a timer, of whole milliseconds, go off once the watermark is at or past ``us``."""
        self._handle.registerTimer(-(-us // 1000) - 1)

    def close(self) -> None:
        pass


class _AsOf(_Waiting):
    """The latest right row that the watermark has passed, kept for the left rows after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._last = handle.getValueState("last", "row string")

    def passed(self, rows: list[tuple], until: int) -> list[tuple]:
        (last,) = self._last.get() or (None,)
        out, newer = [], False
        for at, is_left, text in rows:
            if at > until:
                break
            if is_left:
                out.append((text, last))
            else:
                last, newer = text, True
        if newer:
            self._last.update((last,))
        return out


class _AsOfWithin(_Waiting):
    """Matches no farther than ``tolerance`` microseconds, ``ahead`` of the left row, ``behind`` it, or either."""

    def __init__(self, tolerance: int, ahead: bool, behind: bool):
        self._tolerance, self._ahead, self._behind = tolerance, ahead, behind

    def leaves(self, at: int, is_left: bool) -> int:
        # A right row must still be there when the last left row that can look as far is decided.
        return at + self._tolerance * (self._ahead + (not is_left and self._behind))

    def passed(self, rows: list[tuple], until: int) -> list[tuple]:
        known = [(at, text) for at, is_left, text in rows if not is_left]
        times = [at for at, _ in known]
        out = []
        for at, is_left, text in rows:
            if not is_left or self.leaves(at, True) > until:
                continue
            near = []
            if self._behind and (k := bisect_right(times, at)):
                near.append((at - times[k - 1], 0, known[k - 1][1]))
            if self._ahead and (k := bisect_left(times, at)) < len(times):
                near.append((times[k] - at, 1, known[bisect_right(times, times[k]) - 1][1]))
            near = [x for x in near if x[0] <= self._tolerance]
            out.append((text, min(near)[2] if near else None))
        return out


def row_windows(df: DataFrame, time: str, by: list[str], value: str, before: int, top: int, delay: str, idle: str | None = None) -> DataFrame:
    """``df`` with windows over the rows of its key, which a stream's own window functions don't give.

    Once the watermark has passed a row it comes out with ``rows_before``, the
    values of up to ``before`` rows before it, oldest first, and ``top_values``, the
    ``top`` largest values of its key so far, its own included, largest first and
    nulls left out.  Rows of one time are in the order of their JSON text.  The
    k-th row before is ``try_element_at(rows_before, -k)``, and any aggregate of
    the last rows is one of that array.

    A key's state is that ring and that list, beside the rows which the watermark
    has not passed.  With ``idle``, it is forgotten once the watermark is that far
    past the key's last row; rows that come later begin anew.
    """
    kind = df.schema[value].dataType.simpleString()
    rows = df.where(F.col(time).isNotNull()).select(
        *by, F.col(time).cast("timestamp").alias("_at"), F.lit(True).alias("side_left"), F.to_json(F.struct(F.struct(*df.columns).alias("row"), F.col(value).alias("value")), _JSON).alias("row_text")
    )
    rows = rows.withWatermark("_at", delay).withColumn("at_us", F.unix_micros("_at"))
    found = rows.groupBy(*by).transformWithStateInPandas(_RowWindows(before, top, idle and _micros(idle)), "_l string, _r string", "append", "EventTime")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    found = found.select(F.from_json("_l", f"row struct<{kinds.replace('` ', '`: ')}>", _JSON).alias("_l"), F.from_json("_r", f"rows_before array<{kind}>, top_values array<{kind}>", _JSON).alias("_r"))
    return found.select("_l.row.*", "_r.*")


class _RowWindows(_Waiting):
    """A ring of the last values and a list of the largest, as JSON beside the time of the last row."""

    def __init__(self, before: int, top: int, idle: int | None):
        self._before, self._top, self._idle = before, top, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._kept = handle.getValueState("kept", "at bigint, ring string, best string")

    def passed(self, rows: list[tuple], until: int) -> list[tuple]:
        last, ring, best = self._kept.get() or (None, "[]", "[]")
        ring, best, out = json.loads(ring), json.loads(best), []
        for at, _, text in rows:
            if at > until:
                continue
            value = json.loads(text)["value"]
            if value is not None:
                best = sorted([*best, value], reverse=True)[: self._top]
            out.append((text, json.dumps({"rows_before": ring, "top_values": best})))
            ring, last = [*ring, value][-self._before :] if self._before else [], at
        if out:
            self._kept.update((last, json.dumps(ring), json.dumps(best)))
            if self._idle is not None:
                self._wake(last + self._idle)
        return out

    def idle(self, until: int) -> None:
        if self._idle is not None and (kept := self._kept.get()) and kept[0] + self._idle <= until:
            self._kept.clear()


def fill_forward(df: DataFrame, time: str, value: str, by: list[str], delay: str) -> DataFrame:
    """``value`` of each row, or else the latest one before it in its key (``filled``)."""
    known = df.where(F.col(value).isNotNull())
    out = asof(df, known, time, by, [value], delay)
    return out.select(*df.columns, F.coalesce(value, f"right_{value}").alias("filled"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) gets a temporary folder;
    on a cluster that is an error, since each executor would write to its own disk.
    The caller removes the folder when its rows are no longer read.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if top is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top or tempfile.mkdtemp(prefix='spark-shared-')}/{kind}-{uuid.uuid4().hex}"


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, folder: str | None = None, **trigger) -> DataFrame:
    """What the stream appends, up to the input that is there now, as files under ``folder``; a later call with the same folder goes on.

    Without a folder, a new one in the cluster's shared checkpoint folder.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "stream")
    query = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    store = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        query.trigger(**(trigger or {"availableNow": True})).outputMode("append").start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if store is None else spark.conf.set(_STORE, store)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def deliver(df: DataFrame, sink: sinks.Batch, progress: str, **trigger) -> None:
    """Brings the stream's micro-batches to ``sink``, up to the input that is there now; a later call with the same folder goes on.

    A batch that was under way when a call ended is brought again, so the sink must take it once (see ``sources.sinks``).
    """
    df.writeStream.foreachBatch(sink).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
