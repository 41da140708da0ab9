"""Ranked search against the definition, its order and its stop."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import lexical_search, registry

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(docs, items, k=20):
    """By definition, over (id, text) lists."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        asked, found = Counter(_terms(text)), []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out.update((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1))
    return out


WORDS = [f"w{i}" for i in range(60)] + ["É1", "日本", "x", "Yz"]


def _tables(spark, seed=1, n=400):
    rng = random.Random(seed)
    docs = [(rng.randrange(300), " ".join(rng.choice(WORDS[: 10 + i % 50]) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    docs += [(None, "w1 w2 É1"), (None, "w1 w2 É1"), (7, None), (8, ""), (9, "... !"), (10, "W1,w1;w1_日本"), (10, "W1,w1;w1_日本"), (11, " ".join(["w3"] * 30_000))]
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for i in range(30)]
    items += [(None, "w1 w1 É1"), (30, None), (31, "nowhere"), (5, "w2 W2 日本-x")]
    clash = {c: F.lit("z") for c in ("n", "leaf", "score", "rank", "shard", "id", "t")}
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


@pytest.mark.parametrize("options", [{}, {"shard_postings": 60, "depth": 3, "sample_docs": 100, "first_shards": 1}, {"k": 3, "block_terms": 40, "shard_postings": 200, "depth": 2}, {"depth": 0}], ids=str)
def test_search(spark, options):
    docs, items, d, q = _tables(spark)
    got = Counter(tuple(r) for r in lexical_search.search(d, q, **options).select("item_id", "rank", "doc_id", "score").collect())
    assert got == _ranked(docs, items, options.get("k", 20))


def test_search_of_nothing(spark):
    docs, items, d, q = _tables(spark, n=20)
    assert lexical_search.search(d.limit(0), q).collect() == [] and lexical_search.search(d, q.limit(0)).collect() == []
    assert lexical_search.search(d.where("text is null"), q).collect() == []


def test_ids_of_another_type(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "key string, body string")
    q = spark.createDataFrame([("q", "two one")], "name string, ask string")
    got = lexical_search.search(d, q, id_col="key", text_col="body", item_id="name", item_text="ask").collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_bisection_parts_topics():
    """Documents on four topics end in leaves of their own, and the order costs fewer bits than the given one."""
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 4, 400)
    docs = [np.unique(t * 25 + rng.integers(0, 25, 12)).astype(np.int32) for t in topic]
    weights = lexical_search.bisection(docs, 100, 2)
    owner = np.repeat(np.arange(400), [len(d) for d in docs])
    leaf = lexical_search.leaves(weights, owner, np.concatenate(docs), 400)
    for t in range(4):
        assert Counter(leaf[topic == t].tolist()).most_common(1)[0][1] > 0.9 * (topic == t).sum()


def test_visits_stop_early(spark):
    """Of all pairs of item and shard, most have a bound below the item's last rank."""
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    items = registry.table(spark, "/root/testdata/sf0.01", "benchmark")
    last = {r.item_id: r.score for r in lexical_search.search(docs, items).where("rank = 20").collect()}
    block = lexical_search._block(lexical_search._items(items, "item_id", "text").collect())
    share = spark.sparkContext.broadcast
    tree = lexical_search.bisection(lexical_search._sampled(docs, block.vocabulary, "doc_id", "text", 4096, 512), len(block.vocabulary), 6)
    posts = lexical_search._postings(docs, share((block.vocabulary, tree)), "doc_id", "text").cache()
    n, length = posts.where("n > 0").count(), posts.agg(F.sum("n")).first()[0]
    weights = np.array([lexical_search.weight(n, x) for x in lexical_search._frequencies(posts, len(block.vocabulary))])
    bounds = lexical_search._Bounds(block, weights)
    rows = lexical_search._shards(posts, n, length, 2048).select("terms", "maxima").collect()
    visited = np.mean([[b >= last[i] for b, i in zip(bounds.of(r.terms, r.maxima), block.ids)] for r in rows])
    print(len(rows), visited)
    assert visited < 0.5
