"""Quality rules: an isolation forest over rule statistics.

``rule_statistics`` counts, for every whole text, the words, symbols, repeated
lines and repeated five-word windows, and derives rates from them.  A forest of
``trees`` random trees, each grown on ``subsample`` rows, isolates anomalous
rows after few splits; the mean path length gives a score in (0, 1).  The
verdict's threshold is read from labelled rows that pass the base rules: the
score that parts bad from good best while at most ``max_false`` of the good ones
are rejected.

Bounds: the forest is fitted on a sample of about ``trees * subsample`` ids (12,800,
thinned by a hash of the id before anything leaves a task), which is what isolation
forests use at any size; the threshold on counts of 1,000 score bins of all
labelled rows.  The forest (under 1 MB) travels with the scoring function.
Statistics are computed once and kept.

Defined cases: a null or empty text has no words, so base_failed; a row with a
null id is scored like any other but used neither for the forest nor for the
threshold; of rows that repeat an id one is in the sample; any quality over 0 is
good, and of several labels of an id the lowest counts; without labelled rows of
both kinds nothing but the base rules rejects; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import kept_table, packed

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]+")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates that the forest splits on; sizes themselves say nothing of quality.
#: Measured on labelled rows, shares of upper case, digits and repeated lines and the word length only hid the bad rows among rare good ones.
RATES = ("symbols_per_word", "repeat_share", "mark_share")
_SCHEMA = ", ".join([f"{c} bigint" for c in _COUNTS] + [f"{c} double" for c in RATES])


def repeated_window_words(words: list[str], width: int = 5) -> int:
    """Words inside ``width``-word windows that occur twice or more, the first included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + len(windows)] |= again
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple:
    """The five counts and the rates of one text."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup = len(lines) - len(set(lines))
    again = repeated_window_words(words)
    rest = _LETTERS.sub("", "".join(words))
    marks = len(rest) - sum(map(str.isdigit, rest))
    rates = (symbols / max(1, n), again / max(1, n), marks / max(1, chars))
    return (n, chars, symbols, dup, again, *rates)


def rule_statistics(text: Column) -> Column:
    """A struct of the counts and rates."""

    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts.tolist()], columns=[*_COUNTS, *RATES])

    return run(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass
class Forest:
    """Trees as arrays [trees, nodes]; a leaf has feature -1 and its path length as value."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: int
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left in zip(self.feature, self.value, self.left):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] >= value[node]
                node = np.where(f < 0, node, left[node] + right)
            total += value[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, trees: int = 200, subsample: int = 64, seed: int = 5) -> Forest:
    """An isolation forest of random splits over ``x`` [rows, features]."""
    rng = np.random.default_rng(seed)
    size = max(1, min(subsample, len(x)))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 * size + 1
    feature, value, left = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64)
    for t in range(trees):
        picked = x[rng.choice(len(x), size, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
        todo, free = [(0, picked, 0)], 1
        while todo:
            at, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            can = np.nonzero(high > low)[0]
            if level >= depth or len(part) < 2 or not len(can):
                value[t, at] = level + _mean_path(len(part))
                continue
            f = rng.choice(can)
            cut = rng.uniform(low[f], high[f])
            if cut <= low[f]:
                cut = high[f]
            feature[t, at], value[t, at], left[t, at] = f, cut, free
            todo += [(free, part[part[:, f] < cut], level + 1), (free + 1, part[part[:, f] >= cut], level + 1)]
            free += 2
    return Forest(feature, value, left, depth, max(_mean_path(size), 1.0))


@dataclass
class Rules:
    forest: Forest
    threshold: float


def best_threshold(good: dict[int, int], bad: dict[int, int], bins: int, max_false: float) -> float:
    """Lowest score to reject: most bad caught less good lost, at most ``max_false`` of the good; over 1 if none helps."""
    all_good, all_bad = sum(good.values()), sum(bad.values())
    best, gain, lost, caught = 2.0, 0.0, 0, 0
    if not all_good or not all_bad:
        return best
    for b in range(bins, -1, -1):
        lost, caught = lost + good.get(b, 0), caught + bad.get(b, 0)
        if lost > max_false * all_good:
            break
        if caught / all_bad - lost / all_good > gain:
            gain, best = caught / all_bad - lost / all_good, b / bins
    return best


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    @F.pandas_udf("double")
    def score(*rates: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([r.to_numpy(float) for r in rates])))

    return rows.withColumn("score", score(*[F.col(c) for c in RATES]))


def sampled(stats: DataFrame, size: int, seed: int) -> np.ndarray:
    """The rates of about ``size`` ids of ``stats``, chosen by a hash of the id."""
    share = min(1.0, size / max(1, stats.count()))
    turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))
    picked = stats.where(F.col("id").isNotNull() & turn).groupBy("id").agg(F.min(F.struct(*RATES)).alias("r")).select("r.*").toPandas()
    picked = picked.sort_values(list(RATES))  # the same forest, in whatever order the rows arrive
    return picked.to_numpy(float).reshape(-1, len(RATES))


def fitted(stats: DataFrame, labels: DataFrame, trees: int = 200, subsample: int = 64, max_false: float = 0.002, bins: int = 1000, seed: int = 5) -> Rules:
    """The rules for ``stats``: ``id`` and the statistics of each row."""
    forest = grow(sampled(stats, trees * subsample, seed), trees, subsample, seed)
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(known, stats["id"] == known["doc_id"])
    binned = _scored(seen.select("quality", *RATES), forest).select((F.col("quality") > 0).alias("good"), F.floor(F.col("score") * bins).alias("bin"))
    counts = binned.groupBy("good", "bin").count().collect()
    by = {q: {r["bin"]: r["count"] for r in counts if r["good"] == q} for q in (True, False)}
    return Rules(forest, best_threshold(by[True], by[False], bins, max_false))


def _verdict(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` (with the statistics) and ``base_failed``, ``score``, ``kept``."""
    rows = _scored(rows, rules.forest).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") < rules.threshold))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``score`` and ``kept``."""
    stats = kept_table(df.select(F.col(id_col).alias("id"), rule_statistics(F.col(text_col)).alias("s")).select("id", "s.*"))
    return _verdict(stats, fitted(stats, labels)).select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "score", "kept")


def survivors(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep.

    Rows are kept with their statistics in one pass over the texts; the fit then
    reads the statistics' columns alone, and the last pass filters, without a shuffle.
    """
    rows = kept_table(packed(df, id=F.col(id_col), s=rule_statistics(F.col(text_col))))
    rules = fitted(rows.select("id", "s.*"), labels)
    return _verdict(rows.select("_row", "s.*"), rules).where("kept").select("_row.*")
