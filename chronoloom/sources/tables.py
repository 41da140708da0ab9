"""Reading and writing tables, by any file system or database that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``, by any file system that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(spark: SparkSession, path: str, format: str, schema: str, **options) -> DataFrame:
    """Files of csv, json, orc, parquet or text.

    The schema is given, so no job reads the files to infer one.  A row that does
    not fit it ends the job; ``mode="PERMISSIVE"`` makes its fields null.
    """
    return spark.read.format(format).schema(schema).options(**({"mode": "FAILFAST"} | options)).load(path)


def save(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists", max_rows: int = 5_000_000, **options) -> None:
    """Files of ``df``, in a folder for each value of ``by``; files are cut after ``max_rows`` rows, so a hot value gives many of bounded size."""
    df.write.format(format).mode(mode).options(maxRecordsPerFile=max_rows, **options).partitionBy(*by or []).save(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table, read as ``parts`` ranges of an integer or time ``column``; rows outside ``low`` to ``high`` are read too."""
    where = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**where, **options).load()
