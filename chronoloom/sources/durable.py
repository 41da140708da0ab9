"""Cuts of lineage that outlive an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) gets a temporary folder;
    on a cluster that is an error, since each executor would write to its own disk.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
