"""Chains and trees of rows that name the row before them, followed by pointer doubling.

Each round every row that has not met its root takes over the pointer of the row
it points to, so a chain of n rows needs log2(n) rounds.  Rows that have met it no
longer take part.  Rounds are cut durably.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.sources.durable import durable


def roots(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``id, root, depth``: the first row of each row's chain, and how many steps away it is.

    A row without a parent, or whose parent is no row, is a root of depth 0.  Ids
    are unique; rows with a null id are left out.  Rows on a circle, and those that
    lead to one, have no root, which is an error.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("to"))
    known = rows.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    rows = rows.join(known, "to", "left").select("id", F.when(F.col("there"), F.col("to")).alias("to"))
    done = [durable(rows.where("`to` IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth")))]
    waiting = durable(rows.where("`to` IS NOT NULL").select("id", "to", F.lit(1).cast("bigint").alias("steps")))
    while not waiting.isEmpty():
        if done[-1].isEmpty():
            raise ValueError("rows point in a circle")
        # A waiting row points to one that waits too, or to one that met its root in the round before.
        ends = done[-1].select(F.col("id").alias("to"), "root", "depth")
        step = durable(waiting.join(ends, "to", "left"))
        done.append(step.where("root IS NOT NULL").select("id", "root", (F.col("steps") + F.col("depth")).alias("depth")))
        rest = step.where("root IS NULL").select("id", "to", "steps")
        nexts = rest.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        doubled = rest.join(nexts, "to", "left")
        waiting = durable(doubled.select("id", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)
