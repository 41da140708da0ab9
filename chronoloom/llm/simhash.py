"""SimHash near-duplicates by bit-sliced comparison of blocks.

1. ``fingerprints``: each text's word shingles are hashed with XXH64 (seed 42)
   and vote on the bits of a fingerprint (64 bits, or more by remixing each hash);
   repeats vote each time, or once with ``distinct``.
2. Blocking keys.  For a small radius the 64 bits are cut into radius + 3 bands;
   two fingerprints within the radius agree on at least three whole bands, so
   one key for each choice of three bands finds every such pair (``band_keys``).
   For a wide radius, keys are bands of min-hashes over the same shingles.
3. The rows of a key form a block.  A block holds its bit planes
   vertically: word w of plane b has bit b of 64 fingerprints.  For one query
   fingerprint against a block, each plane XORed with the query's bit is added
   to carry-save counters, 64 distances in one operation; a row of the block is
   abandoned once all its distances exceed the radius.  A block over ``chunk``
   rows is dealt as chunks, each with the block's pivot; only rows that nothing
   joins to the pivot are compared with the other chunks (``linked``).  Each group
   returns a spanning forest of its links, not the pairs.
4. With an exact ``similarity`` the radius only names candidates: the rows that
   they join, component by component, are dealt with their shingle sets, and only
   pairs of that similarity are links (``exact_links``).  ``measure`` names it:
   ``cosine`` of the shingle sets, common shingles over the geometric mean of both
   sizes, which is the similarity that agreeing SimHash bits stand for; or
   ``jaccard``, common shingles over all of both, never above the cosine.
5. ``near_groups``: connected components over distinct fingerprints, or over
   distinct shingle sets where the similarity is exact.

Defined cases: null and empty texts (no word) have fingerprint zero, linked like
any other; fewer words than a shingle give one shingle of all words.  Equal
fingerprints are one node, whatever their ids.  ``component_id`` is the smallest
id that is not null (null if a group has none).  Repeated rows each get a row.
Ids of any type come back as they are; only the id and the text are read, so
other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.bloom import filter_of, probed
from chronoloom.llm.common import durable, noted, packed, released, removed
from chronoloom.llm.graph import components

_U = np.uint64


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; words are parted by ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), _U, n)


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (a bijective mix of 64 bits)."""
    x = h + _U((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _votes(h: np.ndarray) -> int:
    """64 bits; a bit is 1 if set in over half of ``h``."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def simhash(h: np.ndarray, bits: int) -> bytes:
    """Fingerprint of ``bits`` (a multiple of 64), big-endian; the first 64 bits use the hashes as they are."""
    return b"".join(_votes(h if k == 0 else remix(h, k)).to_bytes(8, "big") for k in range(bits // 64))


def band_keys(fp: bytes, radius: int) -> list[int]:
    """Keys of a 64-bit fingerprint; two within ``radius`` bits share at least one."""
    value, n = int.from_bytes(fp, "big"), radius + 3
    cuts = [round(64 * i / n) for i in range(n + 1)]
    bands = [(value >> a) & ((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for t, pick in enumerate(combinations(range(n), n - radius)):
        keys.append(xxhash.xxh64_intdigest(b"%d:" % t + b",".join(b"%d" % bands[i] for i in pick), 7))
    return keys


@cache
def _multipliers(n: int) -> np.ndarray:
    """``n`` odd numbers of 64 bits."""
    return remix(np.arange(n, dtype=_U), 1000) | _U(1)


def minhash_keys(h: np.ndarray, bands: int, rows: int) -> list[int]:
    """One key for each band of ``rows`` min-hashes over the shingles.

    The shingles are hashes already, so a further hash is one product: ``(h ^ h >> 32) * odd``.
    """
    mixed = h ^ (h >> _U(32))
    least = [int((mixed * m).min()) if len(h) else 0 for m in _multipliers(bands * rows)]
    return [xxhash.xxh64_intdigest(b"%d:%r" % (b, least[b * rows : (b + 1) * rows]), 7) for b in range(bands)]


def fingerprints(
    df: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, radius: int, bands: int = 0, rows: int = 0, distinct: bool = False, named: bool = False
) -> DataFrame:
    """``id, fp, keys`` per row.  With ``bands``, keys are min-hash bands, else those of ``band_keys``.

    With ``distinct``, a shingle votes once however often it is repeated.  With
    ``named`` (and ``distinct``), ``set_name`` follows the bits of ``fp``.
    """

    @F.pandas_udf("fp binary, keys array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        fps, keys = [], []
        for text in texts:
            h = shingle_hashes(text, shingle)
            h = np.unique(h) if distinct else h
            fp = simhash(h, bits)
            found = minhash_keys(h, bands, rows) if bands else band_keys(fp, radius)
            fps.append(fp + set_name(h) if named else fp)
            keys.append(np.array(found, _U).view(np.int64))
        return pd.DataFrame({"fp": fps, "keys": keys})

    return df.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("p")).select("id", "p.fp", "p.keys")


def set_name(h: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles, given sorted and without repeats."""
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``name, hashes``: the distinct shingles of each different set among the texts of column ``t``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(text, shingle)) for text in pdf["t"]]
            yield pd.DataFrame({"name": [set_name(h) for h in sets], "hashes": [h.astype("<u8").tobytes() for h in sets]})

    return texts.mapInPandas(run, "name binary, hashes binary").dropDuplicates(["name"])


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes [bits, words] of fingerprints [lanes, bytes]; lanes are a multiple of 64."""
    columns = np.unpackbits(fps, axis=1).T
    return np.packbits(np.ascontiguousarray(columns), axis=1, bitorder="little").view("<u8")


def _greater(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, held as bits across ``counter``, is over ``radius``."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ~_U(0))
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            more |= same & counter[i]
            same &= ~counter[i]
    return more


def within(planes: np.ndarray, flips: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (query, word of the planes) with a lane within ``radius``: their positions and lane masks.

    ``flips`` [bits, queries] has all ones where a query's bit is set.  Counters
    are carry-save: counter i holds bit i of 64 distances, and a carry out of the
    last one saturates.  Every 16 planes the cells with all lanes beyond the
    radius are abandoned.
    """
    live = np.arange(len(query))
    counter = [np.zeros(len(query), _U) for _ in range((radius + 1).bit_length())]
    beyond = np.zeros(len(query), _U)
    for b in range(len(planes)):
        carry = planes[b][word] ^ flips[b][query]
        for i, c in enumerate(counter):
            counter[i], carry = c ^ carry, c & carry
        beyond |= carry
        if b % 16 == 15:
            stay = (beyond | _greater(counter, radius)) != ~_U(0)
            if not stay.all():
                live, query, word, beyond = live[stay], query[stay], word[stay], beyond[stay]
                counter = [c[stay] for c in counter]
                if not len(live):
                    break
    return live, ~(beyond | _greater(counter, radius))


def block_links(blocks: list[np.ndarray], radius: int, cells: int = 1 << 15, splits: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(block, i, j): a spanning forest of each block's rows that lie within ``radius`` bits.

    With a split over 0, a block's rows before it are compared with those from it
    on, and neither part within itself.  All blocks are compared together; each
    begins at a word of its own.
    """
    sizes = np.array([len(x) for x in blocks])
    splits = np.zeros(len(blocks), np.int64) if splits is None else np.array(splits)
    words = -(-sizes // 64)
    first = np.concatenate([[0], np.cumsum(words)])
    lanes = np.zeros((first[-1] * 64, blocks[0].shape[1]), np.uint8)
    for at, x in zip((first * 64).tolist(), blocks):
        lanes[at : at + len(x)] = x
    planes = _planes(lanes)
    owner = np.repeat(np.arange(len(blocks)), sizes)
    row = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lane = first[owner] * 64 + row
    flips = np.where(np.unpackbits(lanes[lane], axis=1).T.astype(bool), ~_U(0), _U(0))
    parent = list(range(len(lanes)))
    group = np.arange(len(lanes))  # each lane's root after the last step

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    cut = splits[owner]
    start = np.where(cut > 0, first[owner] + cut // 64, lane // 64)  # later words only: each pair is met once
    spans = np.where((cut > 0) & (row >= cut), 0, first[owner + 1] - start)
    other_from = first[owner] * 64 + cut
    upto = np.cumsum(spans)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + cells, "right")))
        query = np.repeat(np.arange(at, to), spans[at:to])
        word = np.arange(len(query)) - np.repeat(upto[at:to] - spans[at:to] - (upto[at - 1] if at else 0), spans[at:to]) + start[query]
        live, masks = within(planes, flips, query, word, radius)
        query, word = query[live], word[live]
        hits, bit = np.nonzero(np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        other, mine = word[hits] * 64 + bit, lane[query[hits]]
        real = (other > mine) & (other >= other_from[query[hits]]) & (other < (first[owner] * 64 + sizes[owner])[query[hits]])
        real &= group[mine] != group[other]
        before = len(found)
        for x, y, k in zip(mine[real].tolist(), other[real].tolist(), owner[query[hits][real]].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((k, x - 64 * int(first[k]), y - 64 * int(first[k])))
        if len(found) > before:
            group = np.array([root(x) for x in range(len(parent))])
        at = to
    return found


def _forest(rows: Iterator[tuple], find, bits: int = 1 << 22) -> Iterator[tuple[tuple, list[tuple], list[tuple[int, int]]]]:
    """For each run of rows (key, flag, node, data) of equal key: the key, its rows and the links among them.

    ``find`` gets several runs at once, about ``bits`` of data (counted in whole
    words of 64 rows, as fingerprints are laid out), each with the number of its
    flagged rows.
    """
    run: list[tuple] = []
    runs: list[list[tuple]] = []
    held = 0

    def found() -> Iterator[tuple[tuple, list[tuple], list[tuple[int, int]]]]:
        links: list[list[tuple[int, int]]] = [[] for _ in runs]
        for k, i, j in find([[r[3] for r in x] for x in runs], [sum(r[1] for r in x) for x in runs]) if runs else []:
            links[k].append((i, j))
        for x, pairs in zip(runs, links):
            yield x[0][0], x, pairs

    for row in rows:
        if run and run[0][0] != row[0]:
            if len(run) > 1:
                runs.append(run)
                held += -(-len(run) // 64) * 64 * 8 * len(run[0][3])
            run = []
            if held >= bits:
                yield from found()
                runs, held = [], 0
        run.append(row)
    if len(run) > 1:
        runs.append(run)
    yield from found()


def _frames(rows: Iterator[tuple], columns: list[str], together: int = 5000) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of that many."""
    while part := list(islice(rows, together)):
        yield pd.DataFrame(part, columns=columns, dtype=object)


def _apart(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The rows of ``n`` that ``pairs`` do not join to the first."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [i for i in range(n) if root(i)]


def linked(blocks: DataFrame, chunk: int, find) -> DataFrame:
    """``u, v``: spanning forests of the links within blocks; ``blocks`` (kept) are ``key, n, node, data``, n being the key's rows.

    A block of up to ``chunk`` rows is compared at once.  Of a larger one, each
    chunk is compared within, together with the block's pivot (its smallest node):
    rows joined to the pivot are joined to each other.  Only the rest, rows not
    joined to it, is then compared with all chunks.  So no link is lost between
    rows that nothing else joins, no task holds more than two chunks, and a hot
    group whose rows mostly resemble its pivot costs in proportion to its size.
    ``find(blocks, flagged)`` gives links (block, i, j); with flagged rows, which
    come first, only links between these and others are wanted.
    """
    kind = blocks.schema["node"].dataType.simpleString()
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pivots = blocks.where(chunks > 1).groupBy("key", "n").agg(F.min(F.struct("node", "data")).alias("p"))
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("j"), F.lit(1).alias("pivot"), "p.node", "p.data")
    dealt = blocks.select("key", own.alias("j"), F.lit(0).alias("pivot"), "node", "data").unionByName(pivots)
    dealt = dealt.repartition("key", "j").sortWithinPartitions("key", "j", F.desc("pivot"), "node")

    def within_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (((k, j), p, node, data) for pdf in batches for k, j, p, node, data in zip(*[pdf[c].tolist() for c in ("key", "j", "pivot", "node", "data")]))

        def out() -> Iterator[tuple]:
            for (key, _), x, pairs in _forest(rows, lambda datas, flagged: find(datas, [0] * len(datas))):
                yield from ((key, x[i][2], x[j][2], None) for i, j in pairs)
                if x[0][1]:
                    yield from ((key, x[i][2], None, x[i][3]) for i in _apart(len(x), pairs))

        yield from _frames(out(), ["key", "u", "v", "data"])

    first = durable(dealt.mapInPandas(within_chunks, f"key bigint, u {kind}, v {kind}, data binary"))
    found = first.where("v is not null").select("u", "v")
    rest = first.where("v is null")
    sizes = durable(rest.groupBy("key").agg(F.count("*").alias("r")))
    if sizes.isEmpty():
        return found
    parts = F.ceil(F.col("r") / chunk).cast("int")
    large = blocks.where(chunks > 1)  # only these have a pivot; the others are not shuffled again
    ns = large.join(sizes, "key").select("key", "n", "r", "node", "data")
    all_rows = ns.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), own.alias("j"), F.lit(0).alias("rest"), "node", "data")
    of_key = large.select("key", "n").distinct().join(sizes, "key")
    apart = rest.select("key", F.col("u").alias("node"), "data").join(of_key.repartition(F.xxhash64("key")), "key")
    apart = apart.select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("j"), F.lit(1).alias("rest"), "node", "data")
    dealt = all_rows.unionByName(apart).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("rest"), "node")

    def across_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (((k, i, j), r, node, data) for pdf in batches for k, i, j, r, node, data in zip(*[pdf[c].tolist() for c in ("key", "i", "j", "rest", "node", "data")]))
        yield from _frames(((x[a][2], x[b][2]) for _, x, pairs in _forest(rows, find) for a, b in pairs), ["u", "v"])

    return found.unionByName(dealt.mapInPandas(across_chunks, f"u {kind}, v {kind}"))


def near_bits(radius: int, width: int | None = None):
    """Links by fingerprints, of which ``width`` bytes count, within ``radius`` bits."""

    def find(blocks: list[list[bytes]], flagged: list[int]) -> list[tuple[int, int, int]]:
        return block_links([np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)[:, :width] for x in blocks], radius, splits=flagged)

    return find


#: Whether ``both`` common members make sets of ``size`` and ``sizes`` as similar as ``least``.
MEASURES = {
    "cosine": lambda both, size, sizes, least: both.astype(float) ** 2 >= least**2 * size * sizes * (1 - 1e-12),
    "jaccard": lambda both, size, sizes, least: both >= least * (size + sizes - both) * (1 - 1e-12),
}


def _similar(sets: list[np.ndarray], similarity: float, measure: str = "cosine") -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are similar enough; a set has no repeats and one member at least."""
    similar_enough = MEASURES[measure]
    sizes = np.array([len(x) for x in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(len(words), np.int64)
    found = []
    left = np.arange(len(sets))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        near = left[similar_enough(np.minimum(sizes[left], sizes[i]), sizes[i], sizes[left], similarity)]
        if not len(near):
            continue
        mine = flat[starts[i] : starts[i] + sizes[i]]
        held[mine] = 1
        if 4 * len(near) > len(sets):
            both = np.add.reduceat(held[flat], starts)[near]
        else:
            both = np.array([held[flat[starts[j] : starts[j] + sizes[j]]].sum() for j in near.tolist()])
        held[mine] = 0
        near = near[similar_enough(both, sizes[i], sizes[near], similarity)]
        found += [(i, j) for j in near.tolist()]
        queue += near.tolist()
        left = left[~np.isin(left, near)]
    return found


def similar_sets(similarity: float, measure: str):
    """Links by shingle sets."""
    if measure not in MEASURES:
        raise ValueError(f"measure {measure!r} is none of {', '.join(MEASURES)}")

    def find(blocks: list[list[bytes]], flagged: list[int]) -> list[tuple[int, int, int]]:
        return [(k, i, j) for k, x in enumerate(blocks) for i, j in _similar([np.frombuffer(h, "<u8") for h in x], similarity, measure)]

    return find


def unique_prints(prints: DataFrame) -> DataFrame:
    """``fp, keys, least`` for each different fingerprint: its keys, and the smallest of its ids."""
    found = prints.groupBy("fp").agg(F.first("keys").alias("keys"), F.min("id").alias("least"))
    return durable(found.withColumn("keys", F.array_distinct("keys")))


def candidate_blocks(unique: DataFrame, node: Column) -> DataFrame:
    """``key, n, node, data`` of the fingerprints that share a key, kept.

    Keys are counted on a hash of the fingerprint.  A Bloom filter of the shared
    keys keeps the others from being shuffled again, and only where a key is shared
    does the fingerprint itself travel.  Equal hashes would only add rows to compare.
    """
    f = F.xxhash64("fp").alias("f")
    keyed = unique.select(f, F.explode("keys").alias("key"))
    sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = probed(keyed, F.col("key"), *filter_of(sizes.select(F.col("key").alias("h")))).where("maybe").drop("maybe")
    blocks = shared.join(sizes, "key").join(unique.select(f, "fp"), "f")
    return durable(blocks.select("key", "n", node.alias("node"), F.col("fp").alias("data")))


def exact_links(df: DataFrame, unique: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, bits: int, chunk: int, find) -> DataFrame:
    """``u, v``: links that ``find`` sees between shingle sets, as spanning forests over fingerprints; ids of ``df`` are not null.

    A forest of candidates could leave a similar pair joined only by way of pairs
    that are not, so all rows of a component of candidates are compared.  Shingle
    sets are made again from the texts, of such rows only, by a Bloom filter of
    their ids: no text is shuffled, and a set that is there by a false positive
    finds no member of its name.
    """
    # Components over hashes: equal ones of different fingerprints could only make a component larger.
    f = F.xxhash64("fp")
    with noted() as made:
        candidates = durable(linked(candidate_blocks(unique, f), chunk, near_bits(radius, bits // 8)))
    removed(df.sparkSession, made[:-1])
    roots = components(candidates)
    released(candidates)
    name = F.substring("fp", bits // 8 + 1, 16).alias("name")
    members = durable(unique.select("fp", "least", name, f.alias("u")).join(roots, "u").select("fp", "least", "name", F.col("root").alias("key")))
    sizes = durable(members.groupBy("key").agg(F.count("*").alias("n")))
    ids = durable(members.select(F.xxhash64("least").alias("h")).distinct())
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    texts = probed(texts, F.xxhash64("id"), *filter_of(ids)).where("maybe")
    blocks = members.join(sizes, "key").join(shingle_sets(texts.select("t"), shingle), "name").where(F.length("hashes") > 0)
    blocks = durable(blocks.select("key", "n", F.col("fp").alias("node"), F.col("hashes").alias("data")))
    released(members, sizes, ids)
    return linked(blocks, chunk, find)


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    bits: int = 64,
    bands: int = 0,
    rows: int = 0,
    chunk: int = 4096,
    distinct: bool = False,
    similarity: float | None = None,
    measure: str = "cosine",
) -> DataFrame:
    """``id, fp, component`` for every row of ``df``.

    With ``similarity`` (for ``distinct`` shingles and ids that are not null) that
    exact similarity by ``measure`` decides, and ``fp`` ends with the name of the set.
    """
    exact = similarity is not None
    find = similar_sets(similarity, measure) if exact else near_bits(radius)
    keyed = durable(fingerprints(df, id_col, text_col, shingle, bits, radius, bands, rows, distinct, exact))
    unique = unique_prints(keyed)
    prints = durable(keyed.select("id", "fp"))
    released(keyed)
    found = exact_links(df, unique, id_col, text_col, shingle, radius, bits, chunk, find) if exact else linked(candidate_blocks(unique, F.col("fp")), chunk, find)
    roots = components(found).select(F.col("u").alias("fp"), "root")
    # Kept, so that the join has its own exchange on both sides and a hot root can be split.
    owner = durable(unique.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = durable(owner.groupBy("root").agg(F.min("least").alias("component")))
    by_print = owner.join(smallest, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def fingerprint_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fingerprint`` (64 bits over 3-word shingles, hex) and ``component_id`` (radius 2)."""
    found = near_groups(df, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def survivors(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    bits: int = 512,
    radius: int = 176,
    bands: int = 28,
    rows: int = 3,
    chunk: int = 512,
    similarity: float = 0.8,
    measure: str = "cosine",
) -> DataFrame:
    """The rows of ``df`` that stay: of each near-duplicate group the one with the smallest id.

    The exact similarity of the distinct five-word shingle sets decides: 0.8 or more
    by ``measure`` is a link.  The cosine joins more than ``jaccard``: at equal sizes
    its 0.8 is a Jaccard similarity of 0.67.  Candidates are within 176 of 512 bits: at a cosine of 0.8 the expected
    distance is 105, at most 128 for the shortest texts (two shingles against the
    same two and one more; deviation 10), so nearly five deviations are left at any
    length.  28 bands of 3 min-hashes put such a pair, whose Jaccard similarity is
    0.64 at least, in one block with a chance of 0.9998; pairs of Jaccard similarity
    0.8 have a cosine of at least as much, so they are among these.
    Rows with a null id have no identity to be compared by and stay.  Texts without
    a word are equal to each other.

    A Bloom filter of the ids that go lets the other rows keep their place in the
    scan; the rest is compared with these ids exactly.
    """
    found = near_groups(df.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, radius, bits, bands, rows, chunk, distinct=True, similarity=similarity, measure=measure)
    gone = durable(found.where("id <> component").select(F.col("id").alias("gone")).distinct())
    bitmaps, buckets = filter_of(gone.select(F.xxhash64("gone").alias("h")))
    rows = probed(packed(df, id=F.col(id_col)), F.xxhash64("id"), durable(bitmaps), buckets)
    doubtful = F.col("maybe") & F.col("id").isNotNull()
    checked = rows.where(doubtful).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return rows.where(~doubtful).select("_row.*").unionByName(checked.select("_row.*"))
