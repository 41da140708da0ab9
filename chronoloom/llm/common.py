"""What several operators share: durable cuts of lineage, kept tables and row packing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors reach.

    Where it is unset, a session on one machine (tests) gets a temporary folder;
    on a cluster that is an error, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


#: Lists that learn of each folder made while they are open.
_notes: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``durable`` and ``kept_table`` make meanwhile, for ``removed`` once nothing reads them any more."""
    made: list[str] = []
    _notes.append(made)
    try:
        yield made
    finally:
        _notes[:] = [x for x in _notes if x is not made]


def removed(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders, by any file system that Spark reaches; those that are gone already are passed over."""
    sc = spark.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Of what is planned and run meanwhile the shuffle files go as soon as it has run; a second run would make them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _folder(out: DataFrame) -> str:
    """Where ``durable`` has kept ``out``."""
    return out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder; the shuffle files that it took go at once."""
    shared_folder(df.sparkSession)
    with run_once(df.sparkSession):
        out = df.select("*").checkpoint()  # planned anew, so that ``df`` itself keeps its files if it is run
    for made in _notes:
        made.append(_folder(out))
    return out


def released(*kept: DataFrame) -> None:
    """Deletes what ``durable`` has kept, once nothing reads it any more."""
    for df in kept:
        removed(df.sparkSession, [_folder(df)])


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder, so that later reads take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for made in _notes:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def executor_bytes(spark: SparkSession) -> int:
    """Heap of the smaller of driver and executor, by the session's settings (1 GB where they are unset)."""
    unit = {"": 1 << 20, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    conf = spark.sparkContext.getConf()
    sizes = []
    for name in ("spark.executor.memory", "spark.driver.memory"):
        number, mark = re.fullmatch(r"(\d+)([bkmgt]?)b?", conf.get(name, "1g").strip().lower()).groups()
        sizes.append(int(number) * unit[mark])
    return min(sizes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it comes in fewer parts than there are cores: a small file, or one of a single row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def whole(text: str | Column) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``_row`` beside ``more``.

    Names of an operator can then never clash with names of its input;
    ``select("_row.*")`` gives the columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in more.items()])


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5
