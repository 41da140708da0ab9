"""A training corpus from raw documents: rules, exact and near copies, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; all but the last return the columns of ``docs``.

Defined cases: a null or empty text fails the quality rules; of equal texts the
largest id stays, of near copies the smallest; rows with a null id pass the stage
of near copies; rows that repeat id and text are one document; columns of
``docs`` may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import exact_dedup, packing, pii, quality_rules, simhash
from chronoloom.llm.common import durable, noted, removed, spread, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.survivors(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.survivors(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents under pseudonyms; an ``n_chars`` column follows the new text.

    The key is the session's ``spark.chronoloom.pii.key``, which links the
    pseudonyms of several runs.  Without it the stage draws a key for itself alone.
    """
    key = spark.conf.get("spark.chronoloom.pii.key", None) or secrets.token_hex(32)
    out = pii.pseudonymised(docs, key, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document, with its token ids.

    Its workers serve the other stages as well and keep what they know of chunks, so
    they know fewer than the operator alone does; that changes no result.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=30_000).drop("ids_crc32")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: Near copies and the isolation forest can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``.

    What a stage has kept goes once the next one's input is kept, and all of it once
    the last has returned, which has read its input by then: packing cuts its
    lineage.  So the shared folder holds the result's own tables only.
    """
    docs, held = spread(table(spark, sf_dir, "documents")), []
    for k, (_, stage) in enumerate(STAGES):
        with noted() as made:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = durable(docs)
        removed(spark, held)
        if k < len(STAGES) - 1:
            removed(spark, made[:-1])
            held = made[-1:]
    return docs
