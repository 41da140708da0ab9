"""Offset and drift between clocks, from events that both have seen.

The other clock is taken to run as ``time + offset + drift * (time - origin)``.
Each round moves the events of x by the fit so far, matches each with the nearest
event of y, leaves out matches that stand apart from the rest, and fits the line
through the others again; the tolerance follows the spread of what is left.  A fit
is one row a clock, kept durably between rounds, so nothing goes to the driver but
whether the fits still move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import series
from chronoloom.sources.durable import durable


def _us(c: Column) -> Column:
    return series.micros(c, F.lit("1970-01-01").cast("timestamp_ntz"))


def _moved(time: Column, fit: Column) -> Column:
    """Microseconds by which a fit moves a time."""
    return fit["offset_us"] + fit["drift"] * (_us(time) - fit["origin_us"])


def matches(x: DataFrame, y: DataFrame, fits: DataFrame, time: str, by: list[str], clock: list[str], tolerance_us: Column) -> DataFrame:
    """``clock, fit, x_us, apart_us``: each event of x, moved by its clock's fit, with how far on its nearest event of y is from where it was."""
    rows = x.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_x"))
    rows = rows.join(fits, clock) if clock else rows.crossJoin(F.broadcast(fits))
    rows = rows.withColumn(time, F.timestamp_add("MICROSECOND", F.round(_moved(F.col("_x"), F.col("fit"))).cast("bigint"), F.col("_x")))
    found = series.asof(rows, y.select(*by, time), time, by, [], "nearest")
    found = found.where(F.abs(series.micros(F.col(time), F.col(f"right_{time}"))) <= tolerance_us)
    return found.select(*clock, "fit", _us(F.col("_x")).alias("x_us"), series.micros(F.col(f"right_{time}"), F.col("_x")).alias("apart_us"))


def fitted(matched: DataFrame, clock: list[str], robust: bool) -> DataFrame:
    """``clock, fit``: the line through the matches of each clock, and their spread about the fit before (median of absolute deviations)."""
    left = F.col("apart_us") - (F.col("fit.offset_us") + F.col("fit.drift") * (F.col("x_us") - F.col("fit.origin_us")))
    matched = matched.withColumn("left", left)
    if robust:
        middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
        center = matched.groupBy(*clock).agg(middle("left").alias("center"))
        with_center = matched.join(center, clock) if clock else matched.crossJoin(F.broadcast(center))
        with_center = with_center.withColumn("off", F.abs(F.col("left") - F.col("center")))
        spread = with_center.groupBy(*clock).agg(middle("off").alias("mad"))
        matched = with_center.join(spread, clock) if clock else with_center.crossJoin(F.broadcast(spread))
        # Five standard deviations of a normal spread; a millisecond at least, that exact clocks keep their matches.
        matched = matched.where(F.col("off") <= F.greatest(7.4 * F.col("mad"), F.lit(1000.0)))
    else:
        matched = matched.withColumn("mad", F.lit(None).cast("double"))
    x = F.col("x_us") - F.col("fit.origin_us")
    out = matched.groupBy(*clock).agg(
        F.regr_intercept("apart_us", x).alias("offset_us"), F.regr_slope("apart_us", x).alias("drift"), F.max("fit.origin_us").alias("origin_us"), F.count("*").alias("n"), F.max("mad").alias("mad")
    ).where("n > 0")
    # One match, or matches at one time, say nothing of drift.
    out = out.withColumn("offset_us", F.coalesce("offset_us", F.lit(0.0))).withColumn("drift", F.coalesce("drift", F.lit(0.0)))
    return out.select(*clock, F.struct("offset_us", "drift", "origin_us", F.col("n").alias("matched"), F.col("mad").alias("spread_us")).alias("fit"))


def clock_drift(x: DataFrame, y: DataFrame, time: str, by: list[str], clock: list[str] | None = None, tolerance: str = "1 minute", rounds: int = 8, robust: bool = True) -> DataFrame:
    """``clock, offset_us, drift_ppm, matched, spread_us`` of y's clock against x's.

    Events match within equal ``by``; ``clock`` (some of ``by``) names the clocks
    that are fitted apart, none means one for all.  The offset is that at the first
    event of x of each clock.  ``tolerance`` must cover the offset and what the drift
    adds to it, and should be short against the gaps between events of a key.
    Rounds end once no fit moves by a microsecond.  Null keys and times match nothing;
    clocks without a match are left out.
    """
    clock = clock or []
    us = series._length(tolerance)
    first = x.where(F.col(time).isNotNull()).groupBy(*clock).agg(_us(F.min(time)).alias("origin_us")).where("origin_us is not null")
    start = F.struct(F.lit(0.0).alias("offset_us"), F.lit(0.0).alias("drift"), "origin_us", F.lit(0).cast("bigint").alias("matched"), F.lit(None).cast("double").alias("spread_us"))
    fits = durable(first.select(*clock, start.alias("fit")))
    for n in range(rounds):
        # From the second round on only what lies within ten spreads of the fit can match.
        near = F.least(us, F.greatest(F.lit(2000), F.ceil(10 * F.coalesce("fit.spread_us", us.cast("double"))))) if robust else us
        new = durable(fitted(matches(x, y, fits, time, by, clock, near), clock, robust))
        moved = F.abs(F.col("fit.offset_us") - F.col("was.offset_us")) >= 1
        before = fits.withColumnRenamed("fit", "was")
        both = new.join(before, clock) if clock else new.crossJoin(F.broadcast(before))
        settled = n + 1 < rounds and both.where(moved | (F.abs(F.col("fit.drift") - F.col("was.drift")) >= 1e-9)).isEmpty()
        fits = new
        if settled:
            break
    return fits.select(*clock, "fit.offset_us", (F.col("fit.drift") * 1e6).alias("drift_ppm"), "fit.matched", "fit.spread_us")
