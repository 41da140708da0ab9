"""Sharding as a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters every record by a seeded hash into a bucket of its shard.  How
many buckets a shard has follows from that shard's own bytes and rows, so a
bucket fits a task's memory whatever the sizes of the shards.  The scattered
records are written to the shared checkpoint folder.  Pass 2 gathers one bucket in
each task, puts it in the order of its hashes, Fisher-Yates shuffles it (Spark's
``shuffle``, whose random numbers start from the seed and the task's number, which
is the bucket's) and numbers it behind the buckets before it.

The law is ``key``: the shard is the one of the highest hash of (id, shard), so
it depends on the id and the shard count alone, and a further shard only takes
rows into itself.  The bucket hashes all columns of the row and, among rows alike
in all of them, the row's copy number: such rows spread over all buckets of their
shard.  Which of them has which number changes nothing in the result, so places
follow from rows and seed alone, not from files, partitions or attempts.

``bucket_bytes`` and ``bucket_rows`` are means: bucket sizes vary with chance by
some deviations of the root of their rows, and by the longest record.  There is a
task for each bucket, so raise them with the memory of the executors.

Defined cases: a null text has size 1 and CRC 0, like an empty one; all rows with
a null id share one shard; ids of any type; other columns may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, packed, whole

#: Up to this many rows of one or two numbers a side is broadcast.
_SMALL = 1 << 20


def _weights(id_col: Column, shards: range) -> Column:
    return F.array_max(F.array(*[F.struct(F.xxhash64(id_col, F.lit(j)).alias("w"), F.lit(j).alias("j")) for j in shards]))


def shard_of(id_col: Column, shards: int) -> Column:
    """The shard, from 0, that the id has the highest weight for."""
    return _weights(id_col, range(shards))["j"]


def _hashed(df: DataFrame, seed: int) -> Column:
    """A hash of all columns; those with maps, which can't be hashed, by way of JSON."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in df.schema.fields], F.lit(seed))


def _joined_small(rows: DataFrame, side: DataFrame, on: list[str], count: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(side) if count <= _SMALL else side, on, how)


def with_copies(rows: DataFrame, together: int = 1 << 16) -> DataFrame:
    """``rows`` (durable, with ``k`` and a unique ``u``) and ``copy``: a number from 0 among rows of equal ``k``.

    Only rows whose ``k`` is repeated are shuffled, about ``together`` of one k to a task.
    """
    repeated = durable(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    some = repeated.count()
    if not some:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    marked = _joined_small(rows, repeated, ["k"], some, "left").select(*rows.columns, "n")
    again = marked.where("n is not null").withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / together)))
    parts = again.groupBy("k", "part").agg(F.count("*").alias("c"))
    before = F.expr("coalesce(sum(c) over (partition by k order by part rows between unbounded preceding and 1 preceding), 0)")
    parts = durable(parts.select("k", "part", before.alias("before")))
    place = F.expr("row_number() over (partition by k, part order by u) - 1")
    again = _joined_small(again.withColumn("place", place), parts, ["k", "part"], parts.count())
    again = again.withColumn("copy", F.col("before") + F.col("place")).select(*rows.columns, "copy")
    return marked.where("n is null").select(*rows.columns, F.lit(0).cast("long").alias("copy")).unionByName(again)


def scattered(
    df: DataFrame, id_col: str, text_col: str, shards: int, seed: int, bucket_bytes: int, bucket_rows: int, payload: bool
) -> tuple[DataFrame, int]:
    """Pass 1: ``id, size, crc, shard, grown, h, bucket`` (and ``_row`` if asked for), written once; buckets are numbered through all shards."""
    text = whole(text_col)
    more = {"id": F.col(id_col), "size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text.cast("binary")), "k": _hashed(df, seed)}
    rows = packed(df, **more).select(*(["_row"] if payload else []), *more)
    rows = rows.withColumn("shard", shard_of(F.col("id"), shards)).withColumn("grown", shard_of(F.col("id"), shards + 1))
    rows = with_copies(durable(rows.withColumn("u", F.monotonically_increasing_id())))
    sums = {r["shard"]: r for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    counts = [max(1, -(-sums[j].bytes // bucket_bytes), -(-sums[j].rows // bucket_rows)) if j in sums else 0 for j in range(shards)]
    of_shard = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    rows = rows.withColumn("h", F.xxhash64("k", "copy", F.lit(seed)))
    bucket = of_shard([sum(counts[:j]) for j in range(shards)]) + F.pmod(F.xxhash64("h", F.lit(seed + 1)), of_shard(counts))
    return rows.withColumn("bucket", bucket.cast("int")).drop("k", "u", "copy"), sum(counts)


def shuffled(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    bucket_rows: int = 1 << 16,
    payload: bool = False,
) -> DataFrame:
    """Every row with its shard and its slot there; with ``payload`` also the whole row as ``_row``."""
    rows, buckets = scattered(df, id_col, text_col, shards, seed, bucket_bytes, bucket_rows, payload)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)")
    starts = durable(sizes.select("shard", "bucket", before.alias("start")))
    record = F.struct("h", "id", "size", "crc", "grown", *(["_row"] if payload else []))
    by_hash = F.array_sort(F.collect_list(record), lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    held = rows.repartitionById(max(1, buckets), F.col("bucket")).groupBy("bucket").agg(by_hash.alias("records"))
    held = held.select("bucket", F.shuffle("records", seed).alias("records"))
    out = _joined_small(held, starts, ["bucket"], buckets).select("shard", "start", F.posexplode("records").alias("at", "r"))
    return out.select(
        F.col("r.id").alias(id_col),
        F.col("r.size").alias("size"),
        F.col("r.crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at")).alias("slot"),
        F.col("r.grown").alias("grown_shard"),
        *([F.col("r._row").alias("_row")] if payload else []),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the shuffled rows of ``df`` as Parquet, one folder a shard, each file in slot order with its ``_slot``."""
    rows = shuffled(df, payload=True, **options).select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "_row.*")
    rows.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
