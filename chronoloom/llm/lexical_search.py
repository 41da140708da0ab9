"""Ranked lexical search on a clustered index whose documents recursive graph bisection has put in order.

1. **Order.**  Documents and terms form a graph.  A bounded sample of documents is
   halved again and again: pairs of documents change sides as long as that lowers
   the cost of the terms' log-gaps.  Each cut leaves a weight a term, by which every
   document of the table goes down the tree; its leaf is its place in the order.
   The sample decides how good the clusters are, never what is found.
2. **Shards.**  A leaf is cut into shards of about ``shard_postings`` postings, so
   none grows with the input.  A shard is one row: an inverted list a term, with
   the term's largest impact in it.
3. **Bounds.**  An item's bound for a shard is the sum of its weights times those
   impacts.  The two shards with the best bounds give each item a first threshold,
   its k-th score there.  Then every task visits its shards by falling bounds and
   leaves an item's visits off once the bound is below its threshold or below the
   k-th score found since.  A shard whose bound equals it is visited, as it may
   hold a smaller id; so the stop is exact.
4. **Ranks.**  Slots of a shard follow the id, so ties within it fall to the smaller
   one; the few candidates of all tasks are ranked by (score, id) in one window.

Terms are looked up by the items' own vocabulary, so the index holds no other
term.  Items go in blocks of about ``block_terms`` terms, which bounds what is
broadcast (vocabulary, tree, thresholds); documents are read once a block.

Defined cases: a null text has no term, nor has an empty one; an item without
terms, or whose terms no document has, has no rows; repeated rows of either table
are documents and items of their own, so a rank is given to each; null ids come
before others among ties; other columns may have any name; very long texts are
counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.llm.common import durable, kept_table

#: Bytes of terms (digits, letters and all of UTF-8 beyond ASCII) with A-Z lower-cased; all others become blanks.
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c > 127 else 32 for c in range(256))
SCALE = 1_000_000_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_TERM_BYTES).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# Recursive graph bisection.


def _log_gaps(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits for the gaps of a term's ``degree`` postings among ``size`` documents."""
    return degree * np.log2((size + 1) / (degree + 1))


def _halved(owner: np.ndarray, term: np.ndarray, left: np.ndarray, n_terms: int, rounds: int) -> np.ndarray:
    """``left`` (a side for each document) after swaps that lower the log-gap cost; ``owner, term`` are the postings."""
    sizes = int(left.sum()), int((~left).sum())
    for _ in range(rounds):
        degrees = [np.bincount(term[left[owner] == side], minlength=n_terms).astype(float) for side in (True, False)]
        gain = np.empty(len(left))
        for side, (mine, other), (n, m) in ((True, degrees, sizes), (False, degrees[::-1], sizes[::-1])):
            saved = _log_gaps(mine, n) + _log_gaps(other, m) - _log_gaps(np.maximum(mine - 1, 0), n) - _log_gaps(other + 1, m)
            own = left[owner] == side
            moved = np.bincount(owner[own], saved[term[own]], minlength=len(left))
            gain[left == side] = moved[left == side]
        a, b = (np.flatnonzero(left == side) for side in (True, False))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = gain[a[:n]] + gain[b[:n]] > 1e-9
        if not swap.any():
            break
        left[a[:n][swap]], left[b[:n][swap]] = False, True
    return left


def bisection(postings: list[np.ndarray], n_terms: int, depth: int, rounds: int = 20, least: int = 16) -> np.ndarray:
    """Weights [node, term] of a tree of cuts: a document of positive weight goes left.  Node k has the children 2k and 2k + 1; 1 is the root."""
    weights = np.zeros((1 << depth, n_terms), np.float32)
    rng = np.random.default_rng(0)
    todo = [(1, np.arange(len(postings)))]
    while todo:
        node, docs = todo.pop()
        if node >= 1 << depth or len(docs) < 2 * least:
            continue
        owner = np.repeat(np.arange(len(docs)), [len(postings[d]) for d in docs])
        term = np.concatenate([postings[d] for d in docs]) if len(owner) else np.empty(0, np.int64)
        left = np.zeros(len(docs), bool)
        left[rng.permutation(len(docs))[: len(docs) // 2]] = True
        left = _halved(owner, term, left, n_terms, rounds)
        bits = []
        for side in (True, False):
            degree, n = np.bincount(term[left[owner] == side], minlength=n_terms).astype(float), int((left == side).sum())
            bits.append(_log_gaps(degree + 1, n) - _log_gaps(degree, n))
        weights[node] = bits[1] - bits[0]
        todo += [(2 * node, docs[left]), (2 * node + 1, docs[~left])]
    return weights


def leaves(weights: np.ndarray, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """The leaf of each of ``n`` documents."""
    node = np.ones(n, np.int64)
    while len(weights) > 1 and n and node[0] < len(weights):
        node = 2 * node + (np.bincount(owner, weights[node[owner], term], minlength=n) < 0)
    return node - len(weights)


# One block of items.


@dataclass
class Block:
    """Items as postings over their own vocabulary: item k has ``term[start[k]:start[k + 1]]``, each ``times``."""

    ids: list
    vocabulary: dict[bytes, int]
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, terms, times`` of each item that has terms."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column("t").cast(pa.binary()).to_pylist()]
            columns = [batch.column("id"), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "terms", "times"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, terms array<binary>, times array<bigint>").where(F.size("terms") > 0)


def _block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    term = [vocabulary.setdefault(bytes(t), len(vocabulary)) for r in rows for t in r.terms]
    start = np.cumsum([0, *[len(r.terms) for r in rows]])
    return Block([r.id for r in rows], vocabulary, start, np.array(term, np.int64), np.array([x for r in rows for x in r.times], np.int64))


# Documents.


def _postings(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """``id, n, leaf, terms, tfs``: the number of terms, and the sorted terms (of the vocabulary) with their counts as 32-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column("t").cast(pa.binary()):
                words = terms(text.as_py())
                here, n = np.unique(np.array([k for k in map(known.get, words) if k is not None], np.int32), return_counts=True)
                sizes.append(len(words))
                found.append(here)
                counts.append(n.astype(np.int32))
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            leaf = leaves(weights, owner, np.concatenate([*found, np.empty(0, np.int32)]), len(found))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(leaf, pa.int32())]
            columns += [pa.array([x.tobytes() for x in many], pa.binary()) for many in (found, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "leaf", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, leaf int, terms binary, tfs binary")


def _sampled(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, rows: int, most_terms: int) -> list[np.ndarray]:
    """The terms of about ``rows`` documents, chosen by a hash of the id (2 * ``rows`` at most), up to ``most_terms`` of each."""
    spark, total = docs.sparkSession, docs.count()
    if not total:
        return []
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("order")), F.lit(total)) < rows)
    shared = spark.sparkContext.broadcast((vocabulary, np.zeros((1, len(vocabulary)), np.float32)))
    found = _postings(chosen, shared, id_col, text_col).select(F.expr(f"substring(terms, 1, {4 * most_terms})").alias("terms")).limit(2 * rows).collect()
    return [np.frombuffer(r.terms, np.int32) for r in found]


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: a count a task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in batch.column("terms"):
                sums[np.frombuffer(part.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _shards(postings: DataFrame, documents: int, length: int, shard_postings: int) -> DataFrame:
    """``shard, terms, maxima, starts, slots, impacts, ids``: inverted lists of each shard, as 32-bit integers.

    Impacts are at most 10**6, since 12 times a length of 75 or more is added to 1000 times the count.
    """
    rows = postings.where(F.length("terms") > 0)
    sizes = rows.groupBy("leaf").agg(F.sum(F.length("terms") / 4).alias("n")).collect()
    cuts = F.create_map(*[F.lit(x) for r in sizes for x in (r.leaf, max(1, math.ceil(r.n / shard_postings)))]) if sizes else F.lit(None).cast("map<int,int>")
    cut = F.pmod(F.xxhash64(F.monotonically_increasing_id()), cuts[F.col("leaf")])
    rows = rows.withColumn("shard", F.col("leaf").cast("bigint") * (1 << 40) + cut).drop("leaf")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "id")
    kind = postings.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            found, tfs = ([np.frombuffer(x.as_buffer(), np.int32) for x in table[c]] for c in ("terms", "tfs"))
            slot = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
            term, tf = np.concatenate(found), np.concatenate(tfs).astype(np.int64)
            m = 75 + (25 * table["n"].to_numpy() * documents) // length
            impact = (SCALE * tf) // (1000 * tf + 12 * m[slot])
            order = np.argsort(term, kind="stable")
            here, start = np.unique(term[order], return_index=True)
            impact = impact[order].astype(np.int32)
            parts = here, np.maximum.reduceat(impact, start), np.append(start, len(order)).astype(np.int32), slot[order], impact
            ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["id"].combine_chunks())
            columns = [pa.array([shard], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts], ids]
            return pa.RecordBatch.from_arrays(columns, ["shard", "terms", "maxima", "starts", "slots", "impacts", "ids"])

        shard, held = None, []
        for batch in batches:
            keys = batch.column("shard").to_numpy()
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)], edges[1:]):
                if a == b:
                    continue
                if keys[a] != shard:
                    if held:
                        yield built(shard, held)
                    shard, held = keys[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield built(shard, held)

    return rows.mapInArrow(run, f"shard bigint, terms binary, maxima binary, starts binary, slots binary, impacts binary, ids array<{kind}>")


class _Bounds:
    """Bounds of the items of a block for shards."""

    def __init__(self, block: Block, weights: np.ndarray):
        self._start, self._term = block.start, block.term
        self.factor = weights[block.term] * block.times
        self._room = np.zeros(len(block.vocabulary), np.int64)

    def of(self, terms: bytes, maxima: bytes) -> np.ndarray:
        at = np.frombuffer(terms, np.int32)
        self._room[at] = np.frombuffer(maxima, np.int32)
        sums = np.concatenate([[0], np.cumsum(self.factor * self._room[self._term])])
        self._room[at] = 0
        return sums[self._start[1:]] - sums[self._start[:-1]]


def _best_shards(index: DataFrame, shared, each: int) -> dict[int, list[int]]:
    """The ``each`` shards of the best bounds of each item, by item number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        bounds, n = _Bounds(block, weights), len(block.ids)
        best, where = np.zeros((n, each), np.int64), np.full((n, each), -1)
        rows = np.arange(n)
        for batch in batches:
            for shard, *head in zip(*(batch.column(c).to_pylist() for c in ("shard", "terms", "maxima"))):
                bound, least = bounds.of(*head), best.argmin(1)
                better = bound > best[rows, least]
                best[rows[better], least[better]], where[rows[better], least[better]] = bound[better], shard
        item, k = np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(where[item, k], pa.int64()), pa.array(best[item, k], pa.int64())], ["item", "shard", "bound"])

    found = index.select("shard", "terms", "maxima").mapInArrow(run, "item int, shard bigint, bound bigint")
    top = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("r", top).where(f"r <= {each}").collect():
        out.setdefault(r.item, []).append(r.shard)
    return out


def _visited(index: DataFrame, shared, k: int) -> DataFrame:
    """``item, id, score``: the best ``k`` of each item in each task's shards, as far as they can be among the best of all.

    ``shared`` holds the block, the weights, a threshold for each item, and
    optionally the shards that each item visits (else all).
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, thresholds, only = shared.value
        bounds, n = _Bounds(block, weights), len(block.ids)
        place = np.full(len(block.vocabulary), -1)
        best: list[list[tuple]] = [[] for _ in range(n)]
        least = np.maximum(thresholds, 1)
        wanted = None
        if only is not None:
            wanted = {}
            for item, shards in only.items():
                for s in shards:
                    wanted.setdefault(s, []).append(item)
        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("ids").type.value_type
            heads = [bounds.of(t.as_buffer(), m.as_buffer()) for t, m in zip(batch.column("terms"), batch.column("maxima"))]
            # Shards by falling bounds, each item on its own: the order within a batch is by the largest bound.
            for row in sorted(range(len(heads)), key=lambda r: -int(heads[r].max(initial=0))):
                shard = batch.column("shard")[row].as_py()
                items = range(n) if wanted is None else wanted.get(shard, ())
                items = [i for i in items if heads[row][i] >= least[i]]
                if not items:
                    continue
                here, starts, slots, impacts = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("terms", "starts", "slots", "impacts"))
                ids = batch.column("ids")[row].values
                place[here] = np.arange(len(here))
                for i in items:
                    score = np.zeros(len(ids), np.int64)
                    own = slice(block.start[i], block.start[i + 1])
                    at = place[block.term[own]]
                    for p, f in zip(at[at >= 0].tolist(), bounds.factor[own][at >= 0].tolist()):
                        part = slice(starts[p], starts[p + 1])
                        score[slots[part]] += f * impacts[part].astype(np.int64)
                    good = np.flatnonzero(score >= least[i])
                    if not len(good):
                        continue
                    good = good[np.argsort(-score[good], kind="stable")][:k]
                    names = ids.take(pa.array(good)).to_pylist()
                    best[i] += [(-int(s), x is not None, x) for s, x in zip(score[good], names)]
                    best[i] = sorted(best[i], key=lambda e: e if e[1] else e[:2])[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], -best[i][-1][0])
                place[here] = -1
        if ids_type is not None:
            rows = [(i, x, -s) for i, own in enumerate(best) for s, _, x in own]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), ids_type, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return index.mapInArrow(run, f"item int, id {kind}, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    depth: int = 6,
    sample_docs: int = 4096,
    sample_terms: int = 512,
    shard_postings: int = 1 << 16,
    first_shards: int = 2,
    block_terms: int = 1 << 16,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    queries = durable(_items(items, item_id, item_text))
    many = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(many / block_terms))
    kinds = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score bigint"
    out = spark.createDataFrame([], kinds)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == b).collect()
        if rows:
            out = out.unionByName(_ranked(docs, _block(rows), k, id_col, text_col, items.schema[item_id].dataType, depth, sample_docs, sample_terms, shard_postings, first_shards))
    return out.withColumnsRenamed({"item_id": item_id, "doc_id": id_col})


def _ranked(docs, block: Block, k: int, id_col: str, text_col: str, item_kind, depth: int, sample_docs: int, sample_terms: int, shard_postings: int, first_shards: int) -> DataFrame:
    spark, n_terms = docs.sparkSession, len(block.vocabulary)
    share = spark.sparkContext.broadcast
    sample = _sampled(docs, block.vocabulary, id_col, text_col, sample_docs, sample_terms)
    tree = bisection(sample, n_terms, depth)
    postings = kept_table(_postings(docs, share((block.vocabulary, tree)), id_col, text_col))
    documents, length = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(documents, df) for df in _frequencies(postings, n_terms).tolist()], np.int64)
    index = kept_table(_shards(postings, documents, length, shard_postings))
    first = _best_shards(index, share((block, weights)), first_shards)
    thresholds = np.zeros(len(block.ids), np.int64)
    chosen = index.where(F.col("shard").isin(sorted({s for own in first.values() for s in own})))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    for r in _visited(chosen, share((block, weights, thresholds.copy(), first)), k).withColumn("r", nth).where(f"r = {k}").collect():
        thresholds[r.item] = r.score
    found = _visited(index, share((block, weights, thresholds, None)), k).withColumn("rank", nth).where(f"rank <= {k}")
    names = spark.createDataFrame(list(enumerate(block.ids)), StructType().add("item", "integer").add("item_id", item_kind))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
lens AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lens),
tfs AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY 1, 2),
ws AS (SELECT t, floor(1000 * ln((2.0 * max(nn) + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM tfs, tot GROUP BY t),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN tfs USING (t) JOIN ws USING (t) JOIN lens USING (doc_id), tot GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
