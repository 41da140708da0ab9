"""Operators that bring irregular timestamped rows onto common times.

Times are ``timestamp_ntz``.  All are compositions of built-in functions: one
shuffle on the series key, no join for as-of, equi-joins for interval joins.

Where rows follow each other, all rows of a key meet in one task.  For keys too
long for that, ``stretch`` (an interval) makes the window one on the key and that
stretch of time, so a key spreads over as many tasks as it has stretches.  What a
stretch takes over from those before it comes from one row a stretch; that small
table is joined on the same partitioning, so the rows are shuffled once still.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(later: Column, earlier: Column) -> Column:
    """Microseconds from ``earlier`` to ``later``."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def _since_epoch(c: Column) -> Column:
    return micros(c, F.lit("1970-01-01").cast("timestamp_ntz"))


def _length(interval: str) -> Column:
    """Microseconds of an interval given as SQL text."""
    return _since_epoch(F.lit("1970-01-01").cast("timestamp_ntz") + F.expr(f"INTERVAL {interval}"))


def _at(keys: list[str], time: str, stretch: str) -> Column:
    """The keys and the number of the stretch as one value; null equals null in it, as in a window."""
    return F.struct(*[F.col(c) for c in keys], F.floor(_since_epoch(F.col(time)) / _length(stretch)).alias("_n"))


def _taken_over(rows: DataFrame, keys: list[str], carried: Column, ahead: bool, joined: Callable[[str], Column] | None = None) -> DataFrame:
    """``_s, _c``: for each stretch ``_s`` the last ``carried`` (an aggregate) of those before it, or the next after it; or, ``joined``, an aggregate of them all."""
    number = F.col("_s._n")
    order = number.desc() if ahead else number.asc()
    w = Window.partitionBy(*[F.col(f"_s.`{c}`") for c in keys]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("_s").agg(carried.alias("_e")).select("_s", (joined("_e") if joined else F.last("_e", ignorenulls=True)).over(w).alias("_c"))


def bucket(df: DataFrame, time: str, every: str, by: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates per key and window [start, end); windows count from the epoch, calendar units are not windows."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    out = df.groupBy(*by, w.alias("_w")).agg(*aggs)
    return out.select(*by, F.col("_w.start").alias("bucket_start"), *[c for c in out.columns if c not in (*by, "_w")])


def calendar_bucket(df: DataFrame, time: str, unit: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per key and calendar unit (hour, day, week, month, quarter, year)."""
    return df.groupBy(*by, _ntz(F.date_trunc(unit, time)).alias("bucket_start")).agg(*aggs)


def sessions(df: DataFrame, time: str, gap: str | Column, by: list[str], aggs: list[Column], stretch: str | None = None) -> DataFrame:
    """Aggregates per key and session; a session ends ``gap`` after its last row.

    A row at the very end of a session still belongs to it.  Rows without a time,
    or whose gap is null or not above zero, are left out.

    With ``stretch`` each row learns its session's start inside its stretch, and
    takes over what reaches into the stretch: how far the rows before reach (one
    row's gap may span several stretches) and where the last session began.  Both
    come from one row a stretch.  The aggregates then combine in each task before
    their shuffle, so a session of any length is no single task's.
    """
    if stretch:
        rows = _with_session_start(df, time, gap, by, stretch)
        out = rows.groupBy(*by, F.col("_start").alias("session_start")).agg(F.max("_end").alias("session_end"), *aggs)
        return out.select(*by, "session_start", "session_end", *[c for c in out.columns if c not in (*by, "session_start", "session_end")])
    out = df.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(*aggs)
    return out.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in out.columns if c not in (*by, "_w")])


def _with_session_start(df: DataFrame, time: str, gap: str | Column, by: list[str], stretch: str) -> DataFrame:
    """``df`` with ``_end``, a row's time and gap, and ``_start``, the first time of its session."""
    after = F.expr(f"INTERVAL {gap}") if isinstance(gap, str) else gap.cast("interval")
    rows = df.withColumn("_end", F.col(time) + after).where(F.col("_end") > F.col(time)).withColumn("_s", _at(by, time, stretch))
    reach = _taken_over(rows, by, F.max("_end"), False, F.max)
    ordered = Window.partitionBy("_s").orderBy(time)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max("_end").over(before)).join(reach, "_s", "left")
    fresh = F.col(time) > F.greatest("_before", "_c")  # null when nothing came before
    rows = rows.withColumn("_fresh", F.when(F.coalesce(fresh, F.lit(True)), F.col(time))).drop("_before", "_c")
    begun = _taken_over(rows, by, F.max("_fresh"), False)
    rows = rows.withColumn("_start", F.max("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).join(begun, "_s", "left")
    return rows.withColumn("_start", F.coalesce("_start", "_c")).drop("_s", "_c", "_fresh")


def grid(df: DataFrame, time: str, every: str, by: list[str]) -> DataFrame:
    """Regular times of each key, multiples of ``every`` since the epoch, from its first to its last row."""
    ends = df.where(F.col(time).isNotNull()).groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    first = F.timestamp_add("MICROSECOND", F.pmod(-_since_epoch(F.col("_a")), _length(every)), F.col("_a"))
    ends = ends.withColumn("_a", first).where("_a <= _b")
    return ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {every}"))).alias(time))


def fill(df: DataFrame, time: str, value: str, by: list[str], method: str = "forward", tie: list[str] | None = None, stretch: str | None = None) -> DataFrame:
    """``df`` with nulls of ``value`` replaced by the last value before (``forward``) or the next after (``backward``)."""
    ahead = method == "backward"
    order = [F.col(c).desc() if ahead else F.col(c).asc() for c in (time, *(tie or []))]
    over = lambda *keys: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not stretch:
        return df.withColumn(value, over(*by))
    rows = df.withColumn("_s", _at(by, time, stretch))
    # Null times come first in a window's ascending order, and last in its descending one.
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).isNotNull(), F.col(time), *[F.col(c) for c in tie or []]))
    edges = _taken_over(rows, by, F.min_by(value, known) if ahead else F.max_by(value, known), ahead)
    filled = rows.withColumn(value, over("_s")).join(edges, "_s", "left")
    return filled.withColumn(value, F.coalesce(value, "_c")).select(*df.columns)


def interpolate(df: DataFrame, time: str, value: str, every: str, by: list[str], stretch: str | None = None) -> DataFrame:
    """Regular times of each series with the value before, the value after and the linear value between.

    Rows with a null time or value are no anchors; of equal times the largest value
    is one.  The rows are dealt by the series first, so that one shuffle serves both
    the anchors and their neighbours.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(*by, F.col(time).alias("t0"), F.col(value).alias("v0"))
    if stretch:
        rows = rows.withColumn("_s", _at(by, "t0", stretch))
    keys = ["_s"] if stretch else by
    rows = rows.repartition(*keys) if keys else rows
    anchors = rows.groupBy(*dict.fromkeys([*by, *keys]), "t0").agg(F.max("v0").alias("v0"))
    here = F.lead(F.struct("t0", "v0")).over(Window.partitionBy(*keys).orderBy("t0"))
    spans = anchors.withColumn("_next", here)
    if stretch:
        edges = _taken_over(rows, by, F.min(F.struct(F.col("t0"), (-F.col("v0")).alias("v"))), True)
        spans = spans.join(edges, "_s", "left").withColumn("_next", F.coalesce("_next", F.when(F.col("_c").isNotNull(), F.struct(F.col("_c.t0").alias("t0"), (-F.col("_c.v")).alias("v0")))))
    spans = spans.select(*by, "t0", "v0", F.col("_next.t0").alias("t1"), F.col("_next.v0").alias("v1"))
    step = F.expr(f"INTERVAL {every}")
    first = F.timestamp_add("MICROSECOND", F.pmod(-_since_epoch(F.col("t0")), _length(every)), F.col("t0"))
    last = F.coalesce(F.timestamp_add("MICROSECOND", F.lit(-1), F.col("t1")), F.col("t0"))
    grid = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<timestamp_ntz>"))
    points = spans.select(*by, "t0", "v0", "t1", "v1", F.explode(grid).alias("t"))
    part = micros(F.col("t"), F.col("t0")) / micros(F.col("t1"), F.col("t0"))
    between = F.when(F.col("t1").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part)
    return points.select(*by, F.col("t").alias(time), F.col("v0").alias("before"), F.col("v1").alias("after"), between.alias("linear"))


def asof(
    left: DataFrame,
    right: DataFrame,
    time: str,
    by: list[str],
    values: list[str],
    direction: str = "backward",
    tolerance: str | None = None,
    allow_exact: bool = True,
    tie: list[str] | None = None,
    stretch: str | None = None,
) -> DataFrame:
    """``left`` with ``right_<time>`` and ``right_<value>`` of its match, null without one.

    Both sides go through windows on the key, after one shuffle; no join.  Of right
    rows at one time the last by ``tie`` (then by its values) matches.  Null keys
    or times match nothing.  ``nearest`` looks both ways in the same partitions and
    takes the earlier of two equally near matches.
    """
    keyed = F.lit(True)
    for c in by:
        keyed &= F.col(c).isNotNull()
    packed_right = F.struct(*[F.col(c) for c in (time, *(tie or []), *values)])
    none = F.lit(None)
    right = right.where(keyed & F.col(time).isNotNull())
    kind = right.select(packed_right.alias("m")).schema["m"].dataType
    a = left.select(*by, F.col(time).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), none.cast(kind).alias("_m"))
    b = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), packed_right.alias("_m"))
    rows, keys = a.unionByName(b), list(by)
    if stretch:
        rows, keys = rows.withColumn("_s", _at(by, "_t", stretch)), ["_s"]
    side = F.when(F.col("_m").isNotNull(), 0 if allow_exact else 1).otherwise(1 if allow_exact else 0)
    ways = {"backward": [False], "forward": [True], "nearest": [False, True]}[direction]
    found = rows
    for ahead in ways:
        order = [F.col("_t").desc() if ahead else F.col("_t").asc(), side, F.col("_m").asc()]
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn(f"_f{ahead:d}", F.last("_m", ignorenulls=True).over(w))
    found = found.where("_l is not null")
    for ahead in ways if stretch else []:
        sign = -1 if ahead else 1
        edge = F.max(F.when(F.col("_m").isNotNull(), F.struct((sign * _since_epoch(F.col("_t"))).alias("t"), "_m")))
        edges = _taken_over(rows, by, edge, ahead).select("_s", F.col("_c._m").alias("_c"))
        found = found.join(edges, "_s", "left").withColumn(f"_f{ahead:d}", F.coalesce(f"_f{ahead:d}", "_c")).drop("_c")
    if direction == "nearest":
        before, after = F.col(f"_f0.{time}"), F.col(f"_f1.{time}")
        first = before.isNotNull() & (after.isNull() | (micros(F.col("_t"), before) <= micros(after, F.col("_t"))))
        found = found.withColumn("_f", F.when(first, F.col("_f0")).otherwise(F.col("_f1")))
    else:
        found = found.withColumnRenamed(f"_f{ways[0]:d}", "_f")
    fits = keyed & F.col("_t").isNotNull()
    if tolerance:
        fits &= F.abs(micros(F.col("_t"), F.col(f"_f.{time}"))) <= _length(tolerance)
    return found.select("_l.*", *[F.when(fits, F.col(f"_f.{c}")).alias(f"right_{c}") for c in (time, *values)])


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, upper: str, by: list[str] | None = None, lower: str = "0 seconds") -> DataFrame:
    """Pairs with right time in [left time + ``lower``, left time + ``upper``] and equal ``by``.

    Both sides are dealt to bins as long as that interval, the left to the two that
    it can meet, so the join is an equi-join on keys and bin, and a hot key spreads
    over its bins.  Null keys and times match nothing.
    """
    width = F.greatest(_length(upper) - _length(lower), F.lit(1))
    bin_of = lambda us: F.floor(us / width)
    first = bin_of(_since_epoch(F.col(left_time)) + _length(lower))
    a = left.select("*", F.explode(F.array(first, first + 1)).alias("_bin"))
    b = right.withColumn("_bin", bin_of(_since_epoch(F.col(right_time))))
    near = F.col(right_time).between(F.col(left_time) + F.expr(f"INTERVAL {lower}"), F.col(left_time) + F.expr(f"INTERVAL {upper}"))
    return a.join(b, [*(by or []), "_bin"]).where(near).drop("_bin")


def rolling(df: DataFrame, time: str, by: list[str], window: str | int, aggs: dict[str, str], stretch: str | int | None = None, tie: list[str] | None = None) -> DataFrame:
    """``df`` with aggregates (SQL text) over the rows within ``window`` before each row's time, or over that many rows before it.

    With ``stretch``, rows that a later stretch still looks back to are dealt to it
    as well, so it must be no shorter than the window.  A window of rows takes a
    number of rows as stretch, rows being numbered through the key first, and a
    ``tie`` that makes their order the same each time.
    """
    by_rows = isinstance(window, int)
    frame = f"ROWS BETWEEN {window} PRECEDING" if by_rows else f"RANGE BETWEEN INTERVAL {window} PRECEDING"
    order = ", ".join(f"`{c}`" for c in (time, *((tie or []) if by_rows else [])))
    over = lambda keys: {name: F.expr(f"{text} OVER (PARTITION BY {keys} ORDER BY {order} {frame} AND CURRENT ROW)") for name, text in aggs.items()}
    if not stretch:
        return df.withColumns(over(", ".join(f"`{c}`" for c in by)))
    keys = [F.col(c) for c in by]
    if by_rows:
        rows = _numbered(df, time, by, tie or [])
        number, back = F.floor(F.col("_at") / stretch), F.floor((F.col("_at") + window) / stretch)
    else:
        us = _since_epoch(F.col(time))
        rows, number, back = df, F.floor(us / _length(stretch)), F.floor((us + _length(window)) / _length(stretch))
    # Rows without a time are a stretch of their own.
    reach = F.coalesce(F.sequence(number, F.least(back, number + 1)), F.array(F.lit(None).cast("long")))
    rows = rows.select("*", number.alias("_own"), F.explode(reach).alias("_in")).withColumn("_s", F.struct(*keys, "_in"))
    return rows.withColumns(over("_s")).where("_own <=> _in").select(*df.columns, *aggs)


def _numbered(df: DataFrame, time: str, by: list[str], tie: list[str]) -> DataFrame:
    """``df`` and ``_at``: the number of each row in its key's order, counted day by day."""
    rows = df.withColumn("_s", _at(by, time, "1 day"))
    counts = rows.groupBy("_s").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*[F.col(f"_s.`{c}`") for c in by]).orderBy("_s._n").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_s", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy(time, *tie)) - 1
    return rows.withColumn("_at", place).join(before, "_s").withColumn("_at", F.col("_at") + F.col("_before")).drop("_s", "_before")


def delta(df: DataFrame, time: str, value: str, by: list[str], stretch: str | None = None) -> DataFrame:
    """``df`` with the change since the series' row before and the microseconds between."""
    before = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    if stretch:
        rows = df.withColumn("_s", _at(by, time, stretch))
        edges = _taken_over(rows, by, F.max_by(before, F.coalesce(_since_epoch(F.col(time)), F.lit(-(1 << 63)))), False)
        rows = rows.withColumn("_b", F.lag(before).over(Window.partitionBy("_s").orderBy(time))).join(edges, "_s", "left")
        rows = rows.withColumn("_b", F.coalesce("_b", "_c"))
    else:
        rows = df.withColumn("_b", F.lag(before).over(Window.partitionBy(*by).orderBy(time)))
    rows = rows.withColumns({"change": F.col(value) - F.col("_b.v"), "elapsed_us": micros(F.col(time), F.col("_b.t"))})
    return rows.select(*df.columns, "change", "elapsed_us")


def align(series: dict[str, DataFrame], time: str, unit: str, value: str, by: list[str]) -> DataFrame:
    """One row per key and calendar unit with the mean of each named series, null where it has none.

    The rows of all series are tagged and aggregated together: one shuffle for any
    number of them, after sums and counts in each task.  Null keys are one key.
    """
    rows = None
    for name, df in series.items():
        one = df.select(*by, time, F.lit(name).alias("_name"), F.col(value).alias("_value"))
        rows = one if rows is None else rows.unionByName(one)
    return calendar_bucket(rows, time, unit, by, [F.avg(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in series])


def cross_correlation(x: DataFrame, y: DataFrame, time: str, value: str, max_lag: int) -> DataFrame:
    """``lag_hours, corr, n`` of hourly means of x against y that many hours later."""
    hourly = lambda df, name: calendar_bucket(df, time, "hour", [], [F.avg(value).alias(name)])
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag_hours")
    moved = hourly(y, "b").select(lags, "bucket_start", "b").withColumn("bucket_start", F.timestamp_add("HOUR", -F.col("lag_hours"), F.col("bucket_start")))
    both = hourly(x, "a").join(moved, "bucket_start")
    return both.groupBy("lag_hours").agg(F.corr("a", "b").alias("corr"), F.count("*").alias("n"))


def clock_offset(x: DataFrame, y: DataFrame, time: str, value: str, max_lag: int) -> DataFrame:
    """``lag_hours, corr``: the lag at which y follows x best; of equal correlations the smallest lag."""
    found = cross_correlation(x, y, time, value, max_lag).where("corr is not null")
    best = F.max(F.struct("corr", (-F.col("lag_hours")).alias("l")))
    return found.agg(best.alias("b")).where("b is not null").select((-F.col("b.l")).alias("lag_hours"), F.col("b.corr").alias("corr"))


def dtw(x: DataFrame, y: DataFrame, time: str, value: str, unit: str, by: list[str]) -> DataFrame:
    """Dynamic time warping distance per key of the means per calendar ``unit``, the cost being the absolute difference.

    A series is packed into one array of its means, so the unit bounds its length
    whatever the number of rows.  Keys missing on one side, and means that are
    null, are left out.
    """

    def points(df: DataFrame, name: str) -> DataFrame:
        means = calendar_bucket(df, time, unit, by, [F.avg(value).alias("v")]).where("v is not null and bucket_start is not null")
        ordered = F.array_sort(F.collect_list(F.struct("bucket_start", "v")))
        return means.groupBy(*by).agg(F.transform(ordered, lambda p: p["v"]).alias(name))

    far = F.lit(float("inf"))
    ys = F.col("_y")

    def next_row(before: Column, a: Column) -> Column:
        cell = lambda row, j: F.abs(a - F.element_at(ys, j)) + F.least(F.element_at(row, j), F.element_at(before, j + 1), F.element_at(before, j))
        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), F.array(far), lambda row, j: F.concat(row, F.array(cell(row, j))))

    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(far, F.size(ys)))
    last = F.aggregate("_x", first, next_row, lambda row: F.element_at(row, -1))
    return points(x, "_x").join(points(y, "_y"), by).select(*by, last.alias("distance"))
