"""Exact quantiles without a group's values in one task's buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], parts: int | None = None, part_rows: int = 1_000_000) -> DataFrame:
    """``by, q, quantile``: exact quantiles, interpolated between the two nearest ranks.

    Equal values are counted first.  Approximate quantiles cut a group into
    ``parts``, by default so many that the largest group has about ``part_rows``
    rows in each; counts of the parts tell which of them hold the wanted ranks, and
    only the values in these are put in order.  Null values are left out; a group
    without values has no rows; a null key is a group.
    """
    if parts is None:
        largest = df.where(F.col(value).isNotNull()).groupBy(*by).count().agg(F.max("count")).first()[0]
        parts = min(4096, max(8, (largest or 0) // part_rows))
    keys = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    counts = df.where(F.col(value).isNotNull()).groupBy(keys.alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = df.where(F.col(value).isNotNull()).groupBy(keys.alias("k")).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * parts).alias("cuts"))
    placed = counts.join(cuts, "k").select("k", "v", "n", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("part"))
    whole = Window.partitionBy("k")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("k", "part").agg(F.sum("n").alias("n")).select("k", "part", "n", before.alias("before"), F.sum("n").over(whole).alias("total"))
    ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(up).alias("up"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for q in qs for up in (False, True)])
    ranks = F.transform(ranks, lambda r: F.struct(r["q"].alias("q"), r["up"].alias("up"), r["at"].alias("at"), F.when(r["up"], F.ceil(r["at"])).otherwise(F.floor(r["at"])).alias("rank")))
    wanted = sizes.select("k", "part", "before", F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n"))).alias("ranks")).where(F.size("ranks") > 0)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.join(wanted, ["k", "part"]).withColumn("from", F.col("before") + inside)
    found = found.select("k", "v", "n", "from", F.explode("ranks").alias("r")).where("r.rank >= `from` AND r.rank < `from` + n")
    ends = found.groupBy("k", "r.q").agg(F.max(F.when(~F.col("r.up"), F.col("v"))).alias("low"), F.max(F.when(F.col("r.up"), F.col("v"))).alias("high"), F.max(F.col("r.at") - F.floor("r.at")).alias("share"))
    return ends.select(*[F.col(f"k.`{c}`") for c in by], "q", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile"))
