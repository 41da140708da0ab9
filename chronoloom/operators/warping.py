"""Warping paths, and the nearest series of each under banded time warping.

Series are the means per calendar unit of a key, so the unit bounds what a task
holds of one, whatever the number of rows.  A path is found by divide and conquer
over the middle row, in memory linear in the two lengths.  The search for nearest
series takes a stated set of queries, in blocks, against all series, and skips a
pair once an envelope bound shows that it can't be among the best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import series
from chronoloom.sources.durable import durable

_FAR = math.inf


def _means(df: DataFrame, time: str, value: str, unit: str, by: list[str]) -> DataFrame:
    return series.calendar_bucket(df, time, unit, by, [F.avg(value).alias("mean")]).where("mean is not null and bucket_start is not null")


def _row_costs(a: np.ndarray, b: np.ndarray, row: int) -> np.ndarray:
    """Least costs of warping a[:row + 1] with b[:j + 1], for each j; three diagonals are held."""
    n, m = row + 1, len(b)
    out = np.empty(m)
    before = last = np.full(n + 1, _FAR)  # position i + 1 holds row i; the first is the edge
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(low, high + 1)
        # Cells (i, d - i) follow (i - 1, d - i) and (i, d - i - 1) of the last diagonal, and (i - 1, d - i - 1) of the one before.
        best = np.minimum(np.minimum(last[low : high + 1], last[low + 1 : high + 2]), before[low : high + 1]) if d else np.zeros(1)
        now = np.full(n + 1, _FAR)
        now[low + 1 : high + 2] = best + np.abs(a[i] - b[d - i])
        if high == n - 1:
            out[d - n + 1] = now[n]
        before, last = last, now
    return out


def _small_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The path by the whole table of costs."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), _FAR)
    cost[0, 0] = 0
    for i in range(n):
        for j in range(m):
            cost[i + 1, j + 1] = abs(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    i, j, out = n, m, []
    while i:
        out.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda at: cost[at])
    return out[::-1]


def path(a: np.ndarray, b: np.ndarray, small: int = 1024) -> list[tuple[int, int]]:
    """Pairs of places of a cheapest warping, the cost being the absolute difference; of equally cheap ones, the same each time."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        i0, i1, j0, j1 = todo.pop()
        left, right = a[i0:i1], b[j0:j1]
        if len(left) <= 2 or len(left) * len(right) <= small:
            made = [(i0 + i, j0 + j) for i, j in _small_path(left, right)]
            out += made[1:] if out and out[-1] == made[0] else made
            continue
        mid = len(left) // 2
        there = _row_costs(left, right, mid)
        back = _row_costs(left[::-1], right[::-1], len(left) - 1 - mid)[::-1]
        j = int(np.argmin(there + back - np.abs(left[mid] - right)))
        todo += [(i0 + mid, i1, j0 + j, j1), (i0, i0 + mid + 1, j0, j0 + j + 1)]
    return out


def warping_path(x: DataFrame, y: DataFrame, time: str, value: str, unit: str, by: list[str]) -> DataFrame:
    """``by, place, x_time, y_time, cost``: the pairs of units that a cheapest warping of each key aligns, in order.

    The costs of a key sum to its ``dtw`` distance.  Keys missing on one side, and
    means that are null, are left out.
    """
    sides = [_means(df, time, value, unit, by) for df in (x, y)]
    fields = [sides[0].schema[c] for c in by]

    def align(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("bucket_start"), right.sort_by("bucket_start")
        a, b = left["mean"].to_numpy(), right["mean"].to_numpy()
        pairs = np.array(path(a, b) if len(a) and len(b) else [], np.int64).reshape(-1, 2)
        i, j = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
        columns = {c: left[c].take(i) for c in by}
        columns |= {"place": pa.array(np.arange(len(pairs), dtype=np.int32)), "x_time": left["bucket_start"].take(i), "y_time": right["bucket_start"].take(j)}
        return pa.table(columns | {"cost": pa.array(np.abs(a[pairs[:, 0]] - b[pairs[:, 1]]))})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(align, f"{kinds}place int, x_time timestamp_ntz, y_time timestamp_ntz, cost double")


def envelope(a: np.ndarray, n: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of ``a`` within ``band`` places of each of ``n`` places; (inf, -inf) where none is."""
    low, high = np.full(n, _FAR), np.full(n, -_FAR)
    for d in range(-band, band + 1):
        i = np.arange(max(0, -d), min(n, len(a) - d))
        if len(i):
            low[i], high[i] = np.minimum(low[i], a[i + d]), np.maximum(high[i], a[i + d])
    return low, high


def bound(b: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """No more than the banded distance: every place of ``b`` pairs with one inside its envelope."""
    return float(np.maximum(0, np.maximum(low - b, b - high)).sum())


def banded(a: np.ndarray, b: np.ndarray, band: int, most: float = _FAR) -> float:
    """Time warping distance by pairs of places no farther than ``band`` apart; infinite once it must be above ``most``."""
    first = [0.0] + [_FAR] * len(b)
    right = b.tolist()
    for i, p in enumerate(a.tolist(), 1):
        row = [_FAR] * (len(right) + 1)
        for j in range(max(1, i - band), min(len(right), i + band) + 1):
            row[j] = abs(p - right[j - 1]) + min(first[j], row[j - 1], first[j - 1])
        if min(row) > most:
            return _FAR
        first = row
    return first[-1]


def banded_all(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, band: int) -> np.ndarray:
    """``banded`` of ``a`` with each column of ``b``, whose series is as many of its first places as ``lengths`` has; all columns at once."""
    places, n = b.shape
    last, now = np.full((places + 1, n), _FAR), np.full((places + 1, n), _FAR)
    last[0] = 0.0
    for i, p in enumerate(a.tolist(), 1):
        low, high = max(1, i - band), min(places, i + band)
        # The two cells beside the band may be left over from the row before last.
        now[low - 1 : low] = now[high + 1 : high + 2] = _FAR
        costs = np.abs(p - b[low - 1 : high])
        for j in range(low, high + 1):
            np.minimum(last[j], last[j - 1], out=now[j])
            np.minimum(now[j], now[j - 1], out=now[j])
            now[j] += costs[j - low]
        last, now = now, last
    out = np.full(n, _FAR)
    near = np.flatnonzero((np.abs(lengths - len(a)) <= band) & (lengths <= places))
    out[near] = last[lengths[near], near]
    out[np.isnan(out)] = _FAR
    return out


def _columns(s: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Series as columns of one table, padded to the longest, and their lengths."""
    lengths = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(s), int(lengths.max(initial=0))))
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = s.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(rows.T), lengths


def nearest_of(asked: pa.Table, others: pa.Table, band: int, k: int, first: int = 64) -> list[tuple]:
    """``(key, near, distance)`` of the ``k`` series of ``others`` nearest to each one of ``asked``; both have ``key`` and ``s``.

    Series are taken by length, so that padding at most about doubles them.  The
    ``first`` by their bounds are measured; of the rest those whose bound allows it.
    """
    others = others.take(pc.sort_indices(pc.list_value_length(others["s"])))
    sizes = pc.list_value_length(others["s"]).to_numpy()
    asked = asked.take(pc.sort_indices(pc.list_value_length(asked["s"])))
    out, held = [], None
    for own, points in zip(asked["key"].to_pylist(), asked["s"]):
        a = points.values.to_numpy(zero_copy_only=False)
        if held != len(a):
            held = len(a)
            start, end = np.searchsorted(sizes, held - band), np.searchsorted(sizes, held + band, "right")
            alike = others.slice(start, end - start).combine_chunks()
            names = alike["key"].to_pylist()
            place = {name: n for n, name in enumerate(names)}
            b, lengths = _columns(alike["s"].combine_chunks()) if names else (None, None)
            filled = np.arange(len(b))[:, None] < lengths if names else None
        if not names:
            continue
        low, high = envelope(a, len(b), band)
        with np.errstate(invalid="ignore"):
            bounds = np.maximum(0, np.maximum(low[:, None] - b, b - high[:, None])).sum(axis=0, where=filled)
        if own in place:
            bounds[place[own]] = _FAR
        left = np.flatnonzero(bounds < _FAR)
        if len(left) > max(first, k):
            left = left[np.argpartition(bounds[left], max(first, k))]
        now, later = left[: max(first, k)], left[max(first, k) :]
        found = banded_all(a, b[:, now], lengths[now], band)
        if len(later):
            # Sums in another order may differ in their last bits; equal distances must not be passed over.
            later = later[~(bounds[later] > np.partition(found, k - 1)[k - 1] * (1 + 1e-9))]
            now, found = np.concatenate([now, later]), np.concatenate([found, banded_all(a, b[:, later], lengths[later], band)])
        if len(found) > k:
            most = found <= np.partition(found, k - 1)[k - 1]
            now, found = now[most], found[most]
        out += [(own, name, d) for d, name in sorted((d, names[n]) for d, n in zip(found.tolist(), now.tolist()) if d < _FAR)[:k]]
    return out


def nearest_series(df: DataFrame, queries: DataFrame, time: str, value: str, unit: str, key: str, band: int, k: int = 1, block: int = 256) -> DataFrame:
    """``key, near, distance, rank``: the ``k`` other series nearest to those of ``queries`` (rows like ``df``'s) under banded warping.

    Queries are dealt in blocks of about ``block`` series, all series in blocks of
    about a megabyte; a group is one block of each and passes on its best ``k`` of
    each query.  Series are made once.  Equal distances go by ascending key; series
    that no path within the band joins have no distance and are left out, as are a
    query's own key and null keys.
    """
    kind = df.schema[key].dataType.simpleString()

    def packed(rows: DataFrame) -> DataFrame:
        means = _means(rows.where(F.col(key).isNotNull()), time, value, unit, [key])
        ordered = F.array_sort(F.collect_list(F.struct("bucket_start", "mean")))
        return durable(means.groupBy(F.col(key).alias("key")).agg(F.transform(ordered, lambda p: p["mean"]).alias("s")))

    def blocks(series: DataFrame, most: int) -> int:
        """Blocks of about ``most`` series and no more than about 2**17 places."""
        n, places = series.agg(F.count("*"), F.sum(F.size("s"))).first()
        return max(1, math.ceil(n / most), math.ceil((places or 0) / 2**17))

    def search(asked: pa.Table, others: pa.Table) -> pa.Table:
        rows = nearest_of(asked, others, band, k) if len(asked) and len(others) else []
        name = asked.schema.field("key").type
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate({"key": name, "near": name, "distance": pa.float64()}.items())})

    asked, others = packed(queries), packed(df)
    across, down = blocks(asked, block), blocks(others, 2**17)
    number = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    asked = asked.withColumn("q", number(across)).withColumn("p", every(down))
    others = others.withColumn("q", every(across)).withColumn("p", number(down))
    asked, others = (x.repartition(min(across * down, 1000), "q", "p").groupBy("q", "p") for x in (asked, others))
    found = asked.cogroup(others).applyInArrow(search, f"key {kind}, near {kind}, distance double")
    top = F.row_number().over(Window.partitionBy("key").orderBy("distance", "near"))
    return found.withColumn("rank", top).where(f"rank <= {k}").select(F.col("key").alias(key), "near", "distance", "rank")
