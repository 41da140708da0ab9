"""Lag correlation at any resolution, by convolution of blocks.

Both series become means per bin of ``every``.  Bins are packed in blocks as long
as the largest lag; a block of x meets the three blocks of y that its lags reach,
so a bin of y goes to three blocks, whatever the number of lags.  Six convolutions
of a block (of values, squares and presence) give for all lags at once what the
correlation needs.  They are summed in each task, so a task passes on one row a lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import series

_SUMS = ("n", "a", "b", "aa", "bb", "ab")


def lag_correlation(x: DataFrame, y: DataFrame, time: str, value: str, every: str, max_lag: int, block: int | None = None) -> DataFrame:
    """``lag, corr, n``: correlation of the means per ``every`` of x with those of y ``lag`` bins later, and the bins that both have.

    Bins count from the epoch.  Lags without a common bin have no row; where one
    side does not vary ``corr`` is null.  Rows without a time or value are left out.
    A block holds ``block`` bins, ``max_lag`` (and a thousand) at least.
    """
    size = max(block or 0, max_lag, 1000)
    width = series._length(every)
    least = F.min("value")

    def binned(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
        return rows.groupBy(F.floor(series._since_epoch(F.col(time)) / width).alias("bin")).agg(F.avg(value).alias("value"))

    a, b = binned(x), binned(y)
    # Values about zero keep the sums of squares small; any number near the values will do.
    base = (a.agg(least.alias("m")).first()["m"] or 0.0, b.agg(least.alias("m")).first()["m"] or 0.0)
    own = F.floor(F.col("bin") / size)
    left = a.select(own.alias("block"), F.struct(F.lit(True).alias("is_x"), "bin", (F.col("value") - base[0]).alias("value")).alias("p"))
    right = b.select(F.explode(F.array(own - 1, own, own + 1)).alias("block"), F.struct(F.lit(False).alias("is_x"), "bin", (F.col("value") - base[1]).alias("value")).alias("p"))
    blocks = left.unionByName(right).groupBy("block").agg(F.collect_list("p").alias("points"))
    span, fft = 3 * size, 1 << (4 * size).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, 2 * max_lag + 1))
        for batch in batches:
            for number, points in zip(batch.column("block").to_pylist(), batch.column("points")):
                fields = points.values
                is_x = fields.field("is_x").to_numpy(zero_copy_only=False)
                at = fields.field("bin").to_numpy() - (number - 1) * size
                values = fields.field("value").to_numpy()
                here = np.zeros((3, span))
                there = np.zeros((3, span))
                for into, mine in ((here, is_x), (there, ~is_x)):
                    v = values[mine]
                    into[:, at[mine]] = np.ones(len(v)), v, v * v
                if not here[0].any() or not there[0].any():
                    continue
                p, q = np.conj(np.fft.rfft(here, fft)), np.fft.rfft(there, fft)
                for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))):
                    whole = np.fft.irfft(p[i] * q[j], fft)  # place l is lag l, negative ones from the end
                    sums[k] += np.concatenate([whole[fft - max_lag :], whole[: max_lag + 1]]) if max_lag else whole[:1]
        sums[0] = np.rint(sums[0])
        lag = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(lag - max_lag, pa.int64()), *[pa.array(s[lag]) for s in sums]], ["lag", *_SUMS])

    rows = blocks.mapInArrow(run, "lag bigint, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("lag").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    spread = lambda c: n * F.col(c * 2) - F.col(c) * F.col(c)
    # What is left of a constant side after rounding is no variation.
    varies = (spread("a") > 1e-9 * n * F.col("aa")) & (spread("b") > 1e-9 * n * F.col("bb"))
    corr = F.when(varies, (n * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(spread("a") * spread("b")))
    return rows.select("lag", corr.alias("corr"), n.cast("bigint").alias("n"))
