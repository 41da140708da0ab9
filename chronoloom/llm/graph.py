"""Connected components of an edge table, by alternating large and small stars.

Each step is an aggregation and a join on the node, so no neighbour list is ever
gathered.  In the aggregation a hot node shrinks before the shuffle.  Its result
is dealt by a hash of the node before the join, so both sides of the join have an
exchange of their own, which lets adaptive execution split a hot node.  Lineage is
cut after each star, and the edges before it are deleted; the rounds end as soon
as all edges are stars.

Defined cases: self loops and repeated edges are allowed, an edge with a null end
is none; no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, released, run_once


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(F.xxhash64("u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v: a node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least.repartition(F.xxhash64("u")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one none."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with run_once(edges.sparkSession):
        return ends.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, root`` for every node of ``edges`` (columns u, v); root is the smallest node reachable."""
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(edges):
            break
        stars = durable(_large_star(edges))
        released(edges)
        edges = durable(_small_star(stars))
        released(stars)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
