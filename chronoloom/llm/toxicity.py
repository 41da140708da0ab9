"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, their stems (first four and first six letters),
bigrams and skip-grams over one or two words, hashed to 2**22 places, present or
not.  FTRL-proximal keeps a learning rate for every coordinate, and its L1 term
leaves weight only where the labels give reason, so the model is a short list of
(place, weight) that is broadcast for scoring.

Bounds: the learner is one sequential task and sees a seeded sample of at most
about ``max_labelled`` (12,000) labelled ids, in an order of their hashes and only
while their features number at most ``max_features`` (100 million, 400 MB) in all;
features are computed in parallel before.  The model has at most 2**22 weights
and in practice some thousands.  Every row is scored, on its whole text.

Defined cases: null and empty texts have the score of the base rate; a null id
counts as the text '' for the held-out rule; null labels are left out, of several
labels of one id the highest counts, of rows that repeat an id one is learned
from; without labels every score is 0.05 or less; repeated rows score alike; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import remainder

_WORD = re.compile(r"\w+")
_U = np.uint64
BITS = 22


class Hasher:
    """Feature places of texts; hashes of words met before come from a bounded cache."""

    def __init__(self, bits: int = BITS, cached: int = 300_000):
        self._shift, self._cached, self._known = _U(64 - bits), cached, {}

    def _hash(self, word: str) -> tuple[int, int, int]:
        if len(self._known) > self._cached:
            self._known.clear()
        h = lambda w, seed: xxhash.xxh64_intdigest(w, seed)
        found = self._known[word] = (h(word, 1), h(word[:4], 2), h(word[:6], 3))
        return found

    def places(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        known, new = self._known, self._hash
        h = np.array([known.get(w) or new(w) for w in words], _U)
        one = h[:, 0]
        parts = [h.ravel()]
        for gap in (1, 2, 3):
            parts.append(one[:-gap] * _U(0x9E3779B97F4A7C15) + one[gap:] * _U(2 * gap + 1))
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return np.unique(mixed >> self._shift).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], offset: float, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> dict[int, float]:
    """Weights other than zero after ``epochs`` passes over (places, label) in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(offset + w.sum(), -35, 35))) - label
            before = n[at]
            n[at] = after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
    at = np.nonzero(np.abs(z) > l1)[0]
    return dict(zip(at.tolist(), weights(at).tolist()))


@dataclass
class Model:
    offset: float
    places: np.ndarray
    weights: np.ndarray


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 12_000,
    max_features: int = 100_000_000,
    epochs: int = 3,
    alpha: float = 0.1,
    beta: float = 1.0,
    l1: float = 1.5,
    l2: float = 1.0,
    seed: int = 11,
) -> Model:
    """Learns from the labelled rows (doc_id, toxic) whose remainder is not 0."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    known = known.where(remainder(F.col("doc_id")) != 0)
    share = min(1.0, max_labelled / max(1, known.count()))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    picked = known.withColumn("turn", order).where(F.col("turn") < int(share * (1 << 30)))
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series([hasher.places(t).astype(np.int32) for t in texts.tolist()])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for at, y in zip(pdf["at"], pdf["y"].tolist()):
                held += len(at)
                if held <= max_features:
                    rows.append((np.asarray(at, np.int32), y))
        rate = (sum(y for _, y in rows) + 0.5) / (len(rows) + 10)
        offset = float(np.log(rate / (1 - rate)))
        w = ftrl(rows, offset, BITS, epochs, alpha, beta, l1, l2)
        yield pd.DataFrame({"at": [-1, *w], "w": [offset, *w.values()]})

    # One row an id, shrunk before the shuffle; then all of them in one task, in the order of their hashes.
    rows = seen.select("doc_id", "turn", "y", features("t").alias("at")).groupBy("doc_id").agg(F.min(F.struct("turn", "y", "at")).alias("r"))
    rows = rows.coalesce(1).select("doc_id", "r.*").sortWithinPartitions("turn", "doc_id").drop("doc_id")
    model = rows.mapInPandas(learn, "at int, w double").toPandas()
    offset = model.loc[model["at"] < 0, "w"]
    model = model[model["at"] >= 0]
    return Model(float(offset.iloc[0]) if len(offset) else float(np.log(0.05 / 0.95)), model["at"].to_numpy(np.int64), model["w"].to_numpy(float))


def score(text: Column, model: Model, shared) -> Column:
    """``shared``: a broadcast of ``model``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, hasher = shared.value, Hasher()
        dense = np.zeros(1 << BITS)
        dense[m.places] = m.weights
        for texts in batches:
            margin = np.array([dense[hasher.places(t)].sum() for t in texts.tolist()], float) + m.offset
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return run(text)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, ``held_out``, ``score`` and ``predicted`` for every row."""
    model = fit(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col), (remainder(F.col(id_col)) == 0).alias("held_out"), score(F.col(text_col), model, shared).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
