"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic regression on a document's rule statistics gives its own evidence.
Hosts, and paths within hosts, gather evidence by grouped aggregation: a label
counts in full, a document without one counts ``soft`` of its own probability.
Rates are shrunk with Beta priors, paths towards their host and hosts towards
all.  A prior's strength is estimated from the spread of labelled rates between
groups (method of moments), so sparse sites move to the global rate and large
ones keep their own.  A document's posterior adds its own log likelihood ratio to
its path's log odds.

A document's own label says nothing of its own score against others of the same
text: its share is taken out of its path's and its host's sums.  The regression,
the global rate and the two strengths are the same for every document.  (Taking
one label out of the global rate too would only make scores run against labels.)
Labels of held-out ids (crc32 of the id as text, mod 5, is 0) are never used.

Bounds: the regression sees a seeded sample of about ``max_labelled`` labelled ids
at most (five numbers each); the driver otherwise gets two rows of sums.  Groups
shrink before each shuffle, so a hot host costs no more than another.

Defined cases: null hosts or paths are groups of their own; null and empty texts
have statistics of zero; labels without a document are left out, of several labels
of one id the lowest counts, rows with a null id count as unlabelled, rows that
repeat an id each count; without labels the global rate is one half and everything
is kept that scores 0.5; an empty table gives an empty result; other columns may
have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, kept_table, remainder
from chronoloom.llm.quality_rules import RATES, rule_statistics

_INPUTS = (*RATES, "log_words", "short")


def _inputs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_words", F.log1p("n_words")).withColumn("short", (F.col("n_words") < 10).cast("double"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept last) by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + l2 * w)
    return w


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(between: float, noise: float, spread: float, variance: float) -> float:
    """Prior strength of Beta rates by the method of moments.

    ``between`` is the weighted sum of squares of the groups' rates around their
    parents', ``noise`` what chance alone gives, ``spread`` the weight of the rates'
    own variance in it, ``variance`` that of one label.
    """
    own = (between - noise) / spread if spread > 0 else 0.0
    if spread <= 0 or variance <= 0:
        return 100.0
    return float(np.clip(variance / own - 1, 1.0, 1e4)) if own > 0 else 1e4


def _strength(groups: DataFrame, parent: list[str]) -> float:
    """Of labelled groups (``k1`` good of ``n1``) around the rates of their parents."""
    of = groups.where("n1 > 0").groupBy(*parent)
    of = of.agg(F.count("*").alias("g"), F.sum("n1").alias("n"), F.sum("k1").alias("k"), F.sum(F.col("n1") * F.col("n1")).alias("q"), F.sum(F.col("k1") * F.col("k1") / F.col("n1")).alias("s"))
    m, free = F.col("k") / F.col("n"), F.col("g") - 1
    variance = m * (1 - m)
    s = of.agg(
        F.sum(F.col("s") - F.col("n") * m * m).alias("between"), F.sum(free * variance).alias("noise"),
        F.sum(F.col("n") - F.col("q") / F.col("n") - free).alias("spread"), (F.sum(F.col("n") * variance) / F.sum("n")).alias("variance"),
    ).first()
    return strength(*[x or 0.0 for x in s])


def posteriors(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    soft: float = 0.1,
    max_labelled: int = 50_000,
    seed: int = 3,
) -> DataFrame:
    """id, ``held_out``, ``doc_probability``, ``host_rate``, ``path_rate``, ``score`` and ``kept`` for every row."""
    s = rule_statistics(F.col(text_col)).alias("s")
    rows = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), s).select("id", "host", "path", "s.n_words", *[f"s.{c}" for c in RATES])
    rows = _inputs(kept_table(rows))
    known = labels.where("quality is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 0)
    # Kept, so that the join has its own exchange on both sides and a hot id can be split.
    known = durable(known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("y")))
    rows = rows.join(known, rows["id"] == known["doc_id"], "left").drop("doc_id")
    turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, max_labelled / max(1, known.count())) * (1 << 40))
    seen = rows.where(F.col("y").isNotNull() & turn).groupBy("id").agg(F.min(F.struct("y", *_INPUTS)).alias("r")).select("r.*").toPandas()
    seen = seen.sort_values(["y", *_INPUTS])
    rate = (seen["y"].sum() + 0.5) / (len(seen) + 1)
    w = logistic(seen[list(_INPUTS)].to_numpy(float), seen["y"].to_numpy(float)) if 0 < seen["y"].sum() < len(seen) else np.zeros(len(_INPUTS) + 1)
    if not w.any():
        w[-1] = np.log(rate / (1 - rate))
    margin = sum((F.col(c) * float(v) for c, v in zip(_INPUTS, w)), F.lit(float(w[-1])))
    rows = rows.select("id", "host", "path", "y", (1 / (1 + F.exp(-margin))).alias("p"))
    rows = durable(rows.withColumn("weight", F.when(F.col("y").isNull(), soft).otherwise(1.0)).withColumn("good", F.coalesce("y", "p")))

    sums = {"k": F.col("weight") * F.col("good"), "n": F.col("weight"), "k1": F.coalesce("y", F.lit(0.0)), "n1": F.col("y").isNotNull().cast("double")}
    paths = durable(rows.groupBy("host", "path").agg(*[F.sum(c).alias(name) for name, c in sums.items()]))
    hosts = durable(paths.groupBy("host").agg(*[F.sum(name).alias(name) for name in sums]))
    top = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = float(top.k / top.n) if top.n else 0.5
    at_host, at_path = _strength(hosts, []), _strength(paths, ["host"])
    by_host = hosts.select(F.col("host").alias("h"), F.col("k").alias("host_k"), F.col("n").alias("host_n"))
    by_path = paths.join(by_host, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("q"), "host_k", "host_n", F.col("k").alias("path_k"), F.col("n").alias("path_n"))
    found = rows.join(by_path, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    rest = lambda total, own: F.greatest(F.col(total) - own, F.lit(0.0))
    own_k, own_n = F.col("weight") * F.col("good"), F.col("weight")
    found = found.withColumn("host_rate", (rest("host_k", own_k) + at_host * overall) / (rest("host_n", own_n) + at_host))
    found = found.withColumn("path_rate", (rest("path_k", own_k) + at_path * F.col("host_rate")) / (rest("path_n", own_n) + at_path))
    odds = _logit(F.col("p")) - float(np.log(rate / (1 - rate))) + _logit(F.col("path_rate"))
    out = found.select(F.col("id").alias(id_col), (remainder(F.col("id")) == 0).alias("held_out"), F.col("p").alias("doc_probability"), "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5)
