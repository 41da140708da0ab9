"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so everything the packer must know
is how many pieces have each length: a table of at most ``capacity`` rows, the
only thing that reaches the driver.  ``plan`` works on it in bulk:

* pieces over a third of the capacity are matched greedily, longest first, each
  with the longest other large piece that still fits, so at most two meet in a bin;
* smaller pieces, longest first, go where they leave the smallest gap (best fit);
  a bin that still has the smallest fitting gap takes the next one as well.

Bins alike in history form a class, so the plan has segments (a range of ranks of
one length goes to a range of bins), at most a few thousand whatever the input.
The pieces learn their rank among those of equal length from counts by (length,
bucket), and look their bin up in the broadcast segments.

Defined cases: a null or empty text is the single id 0; repeated rows are packed
each; ids of any type and null ids come back as they are; only the id and the
text are read, so other columns may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import durable

#: Beside the id, what is known of one piece; its token ids are little-endian unsigned integers, on the way of 16 bits where all ids of the vocabulary fit.
_PIECE = "piece int, start bigint, length bigint, ids binary"
_encoders: dict[tuple[str, int], "Encoder"] = {}


#: Letters that have one lower-case form of one code point, and no other spelling.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00ff]+")


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + n for n, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


def _merges_of_letters(tokenizer):
    """The tokenizer's merges alone, if they give words of letters the ids that its whole way gives; else None."""
    merges = tokenizer.model
    letters = [chr(c) for c in range(65, 256) if _LETTERS.fullmatch(chr(c))]
    probes = [*letters, "".join(letters), *(a + b for a in "aZ\u00e9\u00c0" for b in letters), "Tokenizers", "\u00c9t\u00e9s"]
    for p in probes:
        if [t.id for t in merges.tokenize(p.lower().encode().decode("latin-1").translate(_BYTE_SIGNS))] != tokenizer.encode(p, add_special_tokens=False).ids:
            return None
    return merges


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no token spans it, so a text's ids are
    those of its blank-separated chunks.  Points and commas that end a chunk after
    a letter are tokens of their own.  Chunks met lately come from a bounded cache
    of two generations.  A chunk of Latin letters is one word to the vocabulary's
    normaliser and splitter, so it goes to the merges at once; all others take the
    tokenizer's whole way.
    """

    def __init__(self, path: str, cached: int = 120_000, longest: int = 64):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer, self._cached, self._longest = Tokenizer.from_file(path), cached, longest
        # Chunks can be encoded apart only where white space parts tokens and is dropped.
        together = self._tokenizer.encode(" a  b\n", add_special_tokens=False).ids
        apart = [i for x in "ab" for i in self._tokenizer.encode(x, add_special_tokens=False).ids]
        if together != apart or any(re.search(r"\s", token) for token in self._tokenizer.get_vocab()):
            raise ValueError(f"{path}: tokens of this vocabulary can hold white space")
        self._merges = _merges_of_letters(self._tokenizer)
        #: Bytes of an id on its way between tasks.
        self.width = 2 if max(self._tokenizer.get_vocab().values()) < 1 << 16 else 4
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        #: What ends chunks: at most four points and commas, so there are few.
        self._marks: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        if new := set(chunks).difference(self._known):
            if len(self._known) > self._cached:
                self._older, self._known = self._known, {"": b""}
                new = set(chunks).difference(self._known)
            self._learn(new)
        out = b"".join(map(self._known.__getitem__, chunks))
        for c in new:
            if len(c) > self._longest:
                del self._known[c]
        return out

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of chunks that are not in the newer cache."""
        known, older, letters, word, cut = self._known, self._older, _LETTERS.fullmatch, self._word, {}
        for c in new:
            if c in older:
                known[c] = older[c]
            elif self._merges and letters(c):
                known[c] = word(c)
            else:
                stem = c.rstrip(".,")
                if self._merges and letters(stem):
                    known[c] = (known[stem] if stem in known else word(stem)) + self._mark(c[len(stem) :])
                elif unicodedata.normalize("NFC", stem[-1:]).lower().isalpha() and "'" not in c:
                    cut[c] = (stem, c[len(stem) :])
                else:
                    cut[c] = (c, "")
        parts = list({stem for stem, _ in cut.values()}.difference(known))
        met = dict(zip(parts, (array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)))) if parts else {}
        for c, (stem, end) in cut.items():
            known[c] = (met[stem] if stem in met else known[stem]) + self._mark(end)

    def _word(self, letters: str) -> bytes:
        """The ids of a word of Latin letters."""
        word = letters.lower()
        return array("I", [t.id for t in self._merges.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()

    def _mark(self, end: str) -> bytes:
        """The ids of points and commas after a letter."""
        if end in self._marks:
            return self._marks[end]
        ids = array("I", self._tokenizer.encode(end, add_special_tokens=False).ids).tobytes()
        if len(end) <= 4:
            self._marks[end] = ids
        return ids


def encoder(path: str, cached: int = 120_000) -> Encoder:
    """This process's encoder for the vocabulary file, with up to ``cached`` chunks a generation."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = Encoder(path, cached)
    return _encoders[path, cached]


def pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, batch_bytes: int = 1 << 25, cached: int = 120_000) -> DataFrame:
    """``id, piece, start, length, ids``: texts cut after every ``capacity`` ids, the end id 0 included.

    Pieces leave in batches of about ``batch_bytes`` of ids, however many a batch of texts gives.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer, cached).encode, encoder(tokenizer, cached).width

        def cut(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            owner, piece, start, length, ids = zip(*rows) if rows else [()] * 5
            columns = [keys.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])

        for batch in batches:
            keys, rows, held = batch.column("id"), [], 0
            for k, text in enumerate(batch.column("t")):
                ids = np.frombuffer(encode(text.as_py() or "") + b"\0\0\0\0", "<u4").astype(f"<u{width}").tobytes()
                for p, at in enumerate(range(0, len(ids), width * capacity)):
                    part = ids[at : at + width * capacity]
                    rows.append((k, p, at // width, len(part) // width, part))
                held += len(ids)
                if held >= batch_bytes:
                    yield cut(keys, rows)
                    rows, held = [], 0
            yield cut(keys, rows)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, {_PIECE}")


def _wide(ids: bytes, length: int) -> bytes:
    """The ids as 32-bit integers."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, first bin, pieces a bin, place in the bin), by length and rank.

    Rank r of a length, within its segment, goes to bin ``first bin + (r - first
    rank) // pieces`` at ``place + (r - first rank) % pieces * length``.
    """
    left = defaultdict(int, {k: n for k, n in histogram.items() if n})
    used: dict[int, int] = defaultdict(int)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps = 0
    bins = 0

    def put(length: int, count: int, first_bin: int, each: int, place: int) -> None:
        segments.append((length, used[length], first_bin, each, place))
        used[length] += count
        left[length] -= count

    def gap(size: int, first_bin: int, count: int) -> None:
        nonlocal open_gaps
        if size and count:
            gaps[size].append((first_bin, count))
            open_gaps |= 1 << size

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        for other in (k for k in large if k <= min(length, capacity - length)):
            count = min(left[length], left[other]) if other != length else left[length] // 2
            if not count:
                continue
            if other == length:
                put(length, 2 * count, bins, 2, 0)
            else:
                put(length, count, bins, 1, 0)
                put(other, count, bins, 1, length)
            gap(capacity - length - other, bins, count)
            bins += count
        if count := left[length]:
            put(length, count, bins, 1, 0)
            gap(capacity - length, bins, count)
            bins += count

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            fitting = open_gaps >> length
            if fitting:
                size = length + (fitting & -fitting).bit_length() - 1
                first_bin, count = gaps[size].pop()
                if not gaps[size]:
                    open_gaps &= ~(1 << size)
            else:
                size, first_bin, count = capacity, bins, -(-left[length] // (capacity // length))
                bins += count
            each, place = size // length, capacity - size
            full = min(count, left[length] // each)
            if full:
                put(length, full * each, first_bin, each, place)
                gap(size - each * length, first_bin, full)
            if full < count and left[length] and left[length] < each:
                some = left[length]
                put(length, some, first_bin + full, some, place)
                gap(size - some * length, first_bin + full, 1)
                full += 1
            gap(size, first_bin + full, count - full)
    return sorted(segments)


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1 << 16, most_starts: int = 2_000_000, cached: int = 120_000
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32 (of these), sequence_id, offset.

    A piece's rank among those of its length is the number of them in the parts of
    the checkpoint before its own, and before it in its part, which the task that
    reads the part counts; so no ids are shuffled or sorted.  The counts by part and
    length are broadcast if there are no more than ``most_starts``; beyond that the
    pieces are dealt by (length, bucket) and numbered there.  ``cached`` chunks are
    known to each worker, and as many of the generation before: about 0.3 MB a
    thousand; it changes no result.
    """
    spark = df.sparkSession
    cut = durable(pieces(df, tokenizer, capacity, id_col, text_col, cached=cached).withColumns({"part": F.spark_partition_id(), "uid": F.monotonically_increasing_id()}))
    counts = durable(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    if counts.count() <= most_starts:
        return _placed_by_part(cut, counts, segments, id_col)
    shared = spark.sparkContext.broadcast(segments)
    buckets = max(64, cut.count() // bucket_rows)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by length order by bucket rows between unbounded preceding and 1 preceding), 0)")
    starts = counts.select("length", "bucket", before.alias("before"))
    place = F.expr("row_number() over (partition by length, bucket order by uid) - 1")
    ranked = cut.withColumn("place", place).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))

    @F.pandas_udf(_PLACED)
    def assign(size: pd.Series, rank: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return _put(shared.value, size.to_numpy(), rank.to_numpy(), ids)

    return _named(ranked.withColumn("put", assign("length", "rank", "ids")), id_col)


_PLACED = "sequence_id bigint, offset bigint, ids binary"


def _put(segments: np.ndarray, size: np.ndarray, rank: np.ndarray, ids: pd.Series) -> pd.DataFrame:
    """Sequence, offset and wide ids of pieces, by the segment that holds their rank."""
    length, first, first_bin, each, place = segments.T
    at = np.searchsorted((length << 44) + first, (size << 44) + rank, "right") - 1
    nth = rank - first[at]
    wide = [_wide(x, n) for x, n in zip(ids.tolist(), size.tolist())]
    return pd.DataFrame({"sequence_id": first_bin[at] + nth // each[at], "offset": place[at] + nth % each[at] * length[at], "ids": wide})


def _named(placed: DataFrame, id_col: str) -> DataFrame:
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "put.ids", F.crc32("put.ids").alias("ids_crc32"), "put.sequence_id", "put.offset")


def _placed_by_part(cut: DataFrame, counts: DataFrame, segments: np.ndarray, id_col: str) -> DataFrame:
    """The pieces with their places, numbered by the tasks that read the checkpoint's parts."""
    before = F.expr("coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0)")
    starts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts.select("part", "length", before.alias("before")).collect():
        starts[r["part"]][r["length"]] = r["before"]
    shared = cut.sparkSession.sparkContext.broadcast((segments, dict(starts)))

    @F.pandas_udf(_PLACED)
    def assign(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        segments, starts = shared.value
        following: dict[int, dict[int, int]] = {}
        for part, size, ids in batches:
            ranks = np.empty(len(size), np.int64)
            for k, (p, n) in enumerate(zip(part.tolist(), size.tolist())):
                if p not in following:
                    following[p] = dict(starts[p])
                ranks[k] = following[p][n]
                following[p][n] += 1
            yield _put(segments, size.to_numpy(), ranks, ids)

    return _named(cut.withColumn("put", assign("part", "length", "ids")), id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, ids, parts``: the token ids of each sequence of ``pack``, and which piece begins where in it."""
    part = F.struct("offset", F.col(id_col).alias("id"), "piece", "start", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda all, x: F.concat(all, x["ids"]))
    parts = F.transform("p", lambda x: x.dropFields("ids"))
    return held.select("sequence_id", ids.alias("ids"), parts.alias("parts"))


def write_sequences(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", **options) -> None:
    """Writes the packed sequences of ``df`` as Parquet, one row each."""
    sequences(pack(df, tokenizer, id_col=id_col, **options), id_col).write.parquet(path)
