"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 finds the hashes that may be repeated: the 64-bit hashes of all texts are
counted, combined in each task before the shuffle, so of a row no more than its
hash travels and a hot text is one row a task.  Hashes met twice fill a blocked
Bloom filter: each has four bits within one bitmap of 32,768 bits.  Pass 2 probes
the filter with one broadcast join.  A row with a clear bit is surely the only one
of its text and passes straight through; only the rest is shuffled, by SHA-256,
and grouped exactly.  False positives cost a shuffle of the row, never a wrong
result.

Only repeated hashes are in the filter, so its size follows their number and not
that of the rows: 16 bits each (0.24 % false positives), in at most ``max_bits``
(256 MB) and a sixteenth of an executor's or the driver's heap.  256 MB hold 134
million repeated texts at that rate, and a billion at 51 %.  (Bitmaps of what each
task has seen, merged by a shuffle, would move a whole filter for every task; the
hashes are less as soon as there are more than a few tasks.)

Defined cases: a null text counts as empty, so null and empty texts are equal.
The row with the largest id stays; null ids are smaller than any id, and where
all ids of a group are null they all count as the one that stays.  Rows that
repeat both id and text are one document: ``kept`` is the same on each of them,
and ``survivors`` returns one.  Ids of any orderable type; other columns may have
any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.bloom import MAX_BITS, filter_of, probed
from chronoloom.llm.common import durable, packed, whole

def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_filter(texts: DataFrame, bits_per_hash: int, max_bits: int) -> tuple[DataFrame, int]:
    """The filter of the hashes that two or more rows of ``texts.t`` share, and its number of buckets."""
    again = texts.select(_hash(F.col("t")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return filter_of(durable(again), bits_per_hash, max_bits)


def _probed(rows: DataFrame, bitmaps: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (with ``t``) and ``maybe``: whether its text may occur again."""
    return probed(rows, _hash(F.col("t")), bitmaps, buckets)


def _groups(again: DataFrame) -> DataFrame:
    """Per text: the largest id and the number of rows; hot texts shrink before each shuffle.

    Kept durably, so that a join with it has its own exchange on both sides and
    adaptive execution can split a hot text.
    """
    by_id = again.groupBy("sha", "id").agg(F.count("*").alias("n"))
    return durable(by_id.groupBy("sha").agg(F.max("id").alias("keep"), F.sum("n").alias("n")))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("t"))
    rows = _probed(texts, *repeated_filter(texts, bits_per_hash, max_bits))
    digests = durable(rows.select("id", F.sha2("t", 256).alias("sha"), "maybe"))
    alone = digests.where(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"))
    again = digests.where("maybe").select("id", "sha")
    both = alone.unionByName(again.join(_groups(again), "sha").select("id", "sha", "keep", "n"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def survivors(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``df`` that stay, one of each text, with the columns of ``df``.

    Rows that pass the filter keep their place in the scan; of the others only
    the row with the largest id of each text is carried on.
    """
    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("t"))
    bitmaps, buckets = repeated_filter(texts, bits_per_hash, max_bits)
    bitmaps = durable(bitmaps)
    rows = _probed(packed(df, id=F.col(id_col), t=whole(text_col)), bitmaps, buckets)
    again = rows.where("maybe").withColumn("sha", F.sha2("t", 256))
    best = _groups(_probed(texts, bitmaps, buckets).where("maybe").select("id", F.sha2("t", 256).alias("sha")))
    best = best.select(F.col("sha").alias("best_sha"), "keep")
    on = (F.col("sha") == F.col("best_sha")) & F.col("id").eqNullSafe(F.col("keep"))
    chosen = again.join(best, on, "left_semi").groupBy("sha").agg(F.first("_row").alias("_row"))
    return rows.where(~F.col("maybe")).select("_row.*").unionByName(chosen.select("_row.*"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
