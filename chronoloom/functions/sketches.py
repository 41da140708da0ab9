"""Sketches that are stored once per key and hour, and then rolled up and combined without the rows.

A stored row holds a count, an HLL and a theta sketch of distinct values, and a KLL
sketch of a number's distribution.  All merge: days from hours, any set of keys
from each key, and the theta sketches also by intersection and difference.  Their
sizes don't grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import series


def summarised(df: DataFrame, time: str, unit: str, by: list[str], distinct: str, value: str, log_k: int = 12, kll_k: int = 800) -> DataFrame:
    """``by, bucket_start, n, hll, theta, kll``: one row of sketches a key and calendar unit.

    Of 2**log_k registers an HLL errs by 1.04 / sqrt(2**log_k) (a standard
    deviation), theta by 1 / sqrt(2**log_k); KLL's rank by about 2.3 / kll_k.  Null
    values are in none of the sketches; rows without a time are left out.
    """
    aggs = [F.count("*").alias("n"), F.hll_sketch_agg(distinct, log_k).alias("hll"), F.theta_sketch_agg(distinct, log_k).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), kll_k).alias("kll")]
    return series.calendar_bucket(df.where(F.col(time).isNotNull()), time, unit, by, aggs)


def rolled_up(store: DataFrame, unit: str | None, by: list[str], kll_k: int = 800) -> DataFrame:
    """The same rows for a longer calendar ``unit`` (or for all time) and fewer keys, from the stored sketches alone."""
    aggs = [F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll", kll_k).alias("kll")]
    return series.calendar_bucket(store, "bucket_start", unit, by, aggs) if unit else store.groupBy(*by).agg(*aggs)


def estimates(store: DataFrame, q: float) -> DataFrame:
    """The other columns, with ``distinct_hll``, ``distinct_theta`` and ``quantile`` (the q-th) in place of the sketches."""
    keep = [c for c in store.columns if c not in ("hll", "theta", "kll")]
    return store.select(*keep, F.hll_sketch_estimate("hll").alias("distinct_hll"), F.theta_sketch_estimate("theta").alias("distinct_theta"), F.kll_sketch_get_quantile_double("kll", F.lit(q)).alias("quantile"))


def overlap(a: Column, b: Column) -> Column:
    """Estimated distinct values that two theta sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
