"""User-defined forms, for what built-in functions cannot say: scalar, grouped, cogrouped and table functions.

Grouped forms see a series of means per calendar unit, so the unit bounds what a
task holds, whatever the number of rows.  A grouped aggregate over raw rows would
hold a whole group and is left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from chronoloom.operators import series


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """The text in Unicode's composed normal form; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _means(df: DataFrame, time: str, value: str, unit: str, by: list[str]) -> DataFrame:
    return series.calendar_bucket(df, time, unit, by, [F.avg(value).alias("mean")]).where("mean is not null and bucket_start is not null")


def smoothed(df: DataFrame, time: str, value: str, unit: str, by: list[str], alpha: float) -> DataFrame:
    """``by, bucket_start, smooth``: the exponential moving average of the means per calendar ``unit``.

    The first mean stands as it is; units without a mean are passed over.
    """

    def smooth(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket_start")
        out: list[float] = []
        for x in group["mean"].to_pylist():
            out.append(x if not out else (1 - alpha) * out[-1] + alpha * x)
        return group.drop_columns(["mean"]).append_column("smooth", pa.array(out, pa.float64()))

    means = _means(df, time, value, unit, by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in means.schema if f.name != "mean")
    return means.groupBy(*by).applyInArrow(smooth, f"{schema}, smooth double")


def banded_dtw(x: DataFrame, y: DataFrame, time: str, value: str, unit: str, by: list[str], band: int) -> DataFrame:
    """``by, distance``: time warping distance of the means per ``unit`` that pairs places no farther than ``band`` apart.

    Keys missing on one side, and pairs that no such path joins, are left out.
    """

    def distance(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.sort_by("bucket_start")["mean"].to_pylist() for t in (left, right))
        far = float("inf")
        row = [0.0] + [far] * len(b)
        for i, p in enumerate(a, 1):
            new = [far] * (len(b) + 1)
            for j in range(max(1, i - band), min(len(b), i + band) + 1):
                new[j] = abs(p - b[j - 1]) + min(row[j], new[j - 1], row[j - 1])
            row = new
        keep = bool(a and b) and row[-1] < far
        keys = left.select(by).slice(0, 1 if keep else 0)
        return keys.append_column("distance", pa.array([row[-1]] if keep else [], pa.float64()))

    sides = [_means(df, time, value, unit, by) for df in (x, y)]
    schema = ", ".join(f"`{c}` {sides[0].schema[c].dataType.simpleString()}" for c in by)
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(distance, f"{schema}, distance double")


@F.udtf(returnType=StructType().add("word", StringType()).add("at", IntegerType()))
class Words:
    """The blank-separated words of a text and where each begins, in characters from 0."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        at = 0
        for word in (text or "").split(" "):
            if word:
                yield word, at
            at += len(word) + 1


@F.arrow_udtf(returnType="id bigint, admitted boolean, skipped int")
class Spaced:
    """Of the rows (id, at, gap) of a partition in order, which are admitted: those at least ``gap`` microseconds after the last admitted one.

    Whether a row is admitted depends on what became of those before it, which no
    window can say.  ``skipped`` counts the rows passed over since the last
    admitted one.  Rows come in batches and only that state is carried.  A null
    time is never admitted.
    """

    def __init__(self) -> None:
        self._last: int | None = None
        self._skipped = 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        names = rows.schema.names
        ids, times, gaps = (rows.column(names.index(c)) for c in ("id", "at", "gap"))
        admitted, skipped = [], []
        for at, gap in zip(times.to_pylist(), gaps.to_pylist()):
            good = at is not None and (self._last is None or at - self._last >= gap)
            self._last, self._skipped = (at, 0) if good else (self._last, self._skipped + 1)
            admitted.append(good)
            skipped.append(self._skipped)
        yield pa.table({"id": ids.cast(pa.int64()), "admitted": pa.array(admitted, pa.bool_()), "skipped": pa.array(skipped, pa.int32())})


def spaced(df: DataFrame, id_col: str, time: str, gap: str, by: str) -> DataFrame:
    """``id, admitted, skipped`` of every row: rows of a key at least ``gap`` after the last admitted one are admitted."""
    rows = df.select(F.col(by).alias("key"), F.col(id_col).cast("bigint").alias("id"), series._since_epoch(F.col(time)).alias("at"), series._length(gap).alias("gap"))
    out = Spaced(rows.asTable().partitionBy("key").orderBy(F.col("at").asc_nulls_first(), "id"))
    return out.withColumnRenamed("id", id_col)
