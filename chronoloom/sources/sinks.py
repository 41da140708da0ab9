"""Sinks that take a micro-batch once, however often it is brought.

A stream that fails between writing a batch and noting it brings the batch again,
with the same number.  Files go to a folder of that number, which a repetition
replaces.  A database gets the rows in a staging table first; one transaction then
puts them into the target, by key, and the number into a ledger, or does nothing
if the ledger has it.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Batch = Callable[[DataFrame, int], None]


def to_files(path: str, format: str = "parquet", max_rows: int = 5_000_000) -> Batch:
    """Writes batch n to ``path/batch=n``, in place of what an earlier try has left there."""

    def write(df: DataFrame, number: int) -> None:
        df.write.format(format).mode("overwrite").option("maxRecordsPerFile", max_rows).save(f"{path}/batch={number}")

    return write


def read_batches(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """The rows of all batches, with their ``batch``."""
    return spark.read.format(format).schema(f"{schema}, batch bigint").option("basePath", path).load(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def jdbc_save(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Writes ``df`` to a database table, a connection and a transaction a partition; a retried task may repeat its rows (see ``to_jdbc``)."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def _connection(spark: SparkSession, url: str, driver: str | None) -> JavaObject:
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    return jvm.java.sql.DriverManager.getConnection(url)


def _run(connection: JavaObject, *statements: str) -> None:
    statement = connection.createStatement()
    try:
        for sql in statements:
            statement.executeUpdate(sql)
    finally:
        statement.close()


def _exists(connection: JavaObject, sql: str) -> bool:
    statement = connection.createStatement()
    try:
        return statement.executeQuery(sql).next()
    finally:
        statement.close()


def to_jdbc(url: str, table: str, keys: list[str], order: list[str], stream: str, driver: str | None = None, **options) -> Batch:
    """Upserts batch n of ``stream`` into ``table`` by ``keys``; of a batch's rows of one key the last by ``order`` counts.

    The staging table ``<table>_stage_<stream>`` is written anew by each try.  The
    ledger ``<table>_batches`` (stream, batch) must exist, as must ``table``.  Keys
    are not null.  Only standard SQL is used, so any database with transactions does.
    """
    stage, ledger = f"{table}_stage_{stream}", f"{table}_batches"
    settings = {"driver": driver} if driver else {}

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = f"SELECT 1 FROM {ledger} WHERE stream = '{stream}' AND batch = {number}"
        connection = _connection(spark, url, driver)
        try:
            if _exists(connection, known):
                return
            # Spark quotes the names of the table that it makes, and plain SQL folds them: give them as they would be folded.
            names = connection.getMetaData()
            folded = str.upper if names.storesUpperCaseIdentifiers() else str.lower if names.storesLowerCaseIdentifiers() else str
            jdbc_save(latest(df, keys, order).toDF(*map(folded, df.columns)), url, stage, "overwrite", **settings, **options)
            connection.setAutoCommit(False)
            same = " AND ".join(f"s.{k} = {table}.{k}" for k in keys)
            columns = ", ".join(df.columns)
            try:
                # The ledger comes first: its key lets one of two tries pass.
                _run(
                    connection,
                    f"INSERT INTO {ledger} (stream, batch) VALUES ('{stream}', {number})",
                    f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})",
                    f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}",
                )
                connection.commit()
            except Exception:
                connection.rollback()
                raise
        finally:
            connection.close()

    return write


def create_ledger(spark: SparkSession, url: str, table: str, driver: str | None = None) -> None:
    """The ledger of ``table``, where there is none yet."""
    connection = _connection(spark, url, driver)
    try:
        there = connection.getMetaData().getTables(None, None, f"{table}_batches".upper(), None).next()
        if not there:
            _run(connection, f"CREATE TABLE {table}_batches (stream VARCHAR(100) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (stream, batch))")
    finally:
        connection.close()
