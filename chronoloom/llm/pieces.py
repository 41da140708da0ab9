"""SentencePiece segmentation: the n best by backward A* under forward Viterbi scores.

Pieces and their scores come from a SentencePiece model file.  A text is cut
where no piece can cross (before spaces and around line ends), so its lattice
falls into small independent units.  In a unit, a forward Viterbi pass gives
every position the best score from the start, and what the second best path
loses; units not met before go through it together, as arrays by length.  The
forward score is the exact rest cost of a path built from the end, so A* goes
backwards and completes the n best paths in order.  Ties go to the path nearer
its start.  A text's n best are merged from its units' lists: only the n - 1
units with the least second loss can differ from their best, and A* runs on these.

Characters without a piece become their UTF-8 byte pieces, at a score ten below
the lowest.  Decoding joins the pieces and turns byte pieces back to text, so a
round trip gives the text itself, but for the character that the pieces use for
a blank (U+2581): it comes back as a blank, as the vocabulary's own rule has it.

Defined cases: a null text counts as empty, with no ids, score 0 and one
segmentation; rows are independent, so repeated rows are treated like any; ids of
any type and null ids come back as they are; only the id and the text are read,
so other columns may have any name; no limit is set on a text's or unit's length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
_models: dict[str, "Pieces"] = {}


class Pieces:
    def __init__(self, path: str, cached: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.names = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        #: ASCII byte pieces stand for their character at once; the others wait for their whole sequence.
        self.byte_of = {i: b for b, i in self.bytes.items() if b > 127}
        for b in range(128):
            if b in self.bytes:
                self.names[self.bytes[b]] = chr(b)
        self._normal, self._unknown = normal, min(s for _, s in normal.values() if s > -1e8) - 10
        self._longest = max(map(len, normal))
        self._prefix = bool(model.normalizer_spec.add_dummy_prefix)
        if any(_SPACE in p.lstrip(_SPACE) for p in normal):
            raise ValueError(f"{path}: pieces with a blank after another character can cross the cuts before blanks")
        self._breaks = "\n" if not any("\n" in p for p in normal) else ""
        self._cached = cached
        #: Pieces by their characters: node = (score or None, nodes by the next character).
        self._trie: dict[str, tuple] = {}
        for p, (_, score) in sorted(normal.items(), key=lambda x: len(x[0])):
            at = self._trie
            for c in p[:-1]:
                at = at.setdefault(c, (None, {}))[1]
            at[p[-1]] = (score, at[p[-1]][1] if p[-1] in at else {})
        self._flatten()
        self._chunks: dict[str, tuple[float, bytes, float]] = {}
        self._older: dict[str, tuple[float, bytes, float]] = {}
        self._lists: dict[tuple[str, int], list] = {}

    def _flatten(self) -> None:
        """The trie as arrays: node numbers by (node, character), score and id by node."""
        self._letter = np.zeros(0x110000, np.int64)
        keys, nodes, scores, ids = [], [], [0.0], [-1]
        todo = [(0, self._trie, "")]
        while todo:
            node, at, prefix = todo.pop()
            for c, (score, below) in at.items():
                if not self._letter[ord(c)]:
                    self._letter[ord(c)] = self._letter.max() + 1 if keys else 1
                keys.append(node << 20 | int(self._letter[ord(c)]))
                nodes.append(len(scores))
                todo.append((len(scores), below, prefix + c))
                scores.append(-np.inf if score is None else score)
                ids.append(-1 if score is None else self._normal[prefix + c][0])
        order = np.argsort(keys)
        self._keys, self._nodes = np.array(keys)[order], np.array(nodes)[order]
        self._scores, self._piece = np.array(scores), np.array(ids, np.int64)
        self._scores[0] = -np.inf

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node << 20 | letter
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._nodes[at], 0)

    def chunks(self, text: str) -> list[str]:
        """The escaped text, cut before every run of spaces and around line ends."""
        escaped = text.replace(" ", _SPACE)
        b = self._breaks
        return re.findall(f"{_SPACE}+[^{_SPACE}{b}]*|[^{_SPACE}{b}]+|{b or _SPACE}", (_SPACE if self._prefix else "") + escaped) if text else []

    def _keep(self, chunk: str, found: tuple[float, bytes, float]) -> None:
        if len(chunk) <= 64:
            self._chunks[chunk] = found

    def learn(self, chunks: set[str]) -> dict[str, tuple[float, bytes, float]]:
        """(best score, best ids, loss of the second best) of the chunks; those met lately come from the cache."""
        if len(self._chunks) > self._cached:
            self._older, self._chunks = self._chunks, {}
        out: dict[str, tuple[float, bytes, float]] = {}
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            if found := self._chunks.get(c):
                out[c] = found
            elif found := self._older.get(c):
                out[c] = self._chunks[c] = found
            elif len(c) > 64:
                out[c] = self._one(c)
            else:
                by_length.setdefault(len(c), []).append(c)
        for length, new in by_length.items():
            for at in range(0, len(new), 8192):
                part = new[at : at + 8192]
                for c, found in zip(part, self._many(part, length)):
                    out[c] = found
                    self._keep(c, found)
        return out

    def _one(self, chunk: str) -> tuple[float, bytes, float]:
        score, loss, ids = self._two_best(chunk)
        return score, array("I", ids).tobytes(), loss

    def _many(self, chunks: list[str], n: int) -> list[tuple[float, bytes, float]]:
        """``_one`` for chunks of length n, as arrays [chunks, position]."""
        m = len(chunks)
        letters = self._letter[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n)]
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back = np.zeros((n + 1, m), np.int64)
        first[0] = 0.0
        longest = min(n, self._longest)
        nodes = np.zeros((longest + 1, n, m), np.int64)
        lone = np.zeros(m, bool)
        for t in range(n):
            node, live = np.zeros(m, np.int64), np.arange(m)
            for k in range(1, min(longest, n - t) + 1):
                node = self._next(node, letters[live, t + k - 1])
                alive = node > 0
                node, live = node[alive], live[alive]
                nodes[k, t, live] = node
                if not len(live):
                    break
        lone = (self._piece[nodes[1]] < 0).any(0)  # some character has no piece of its own
        for t in range(n):
            one, two = first[t], second[t]
            for k in range(1, min(longest, n - t) + 1):
                score = self._scores[nodes[k, t]]
                value, e = one + score, t + k
                better = value > first[e]
                second[e] = np.where(better, np.maximum(first[e], two + score), np.maximum(second[e], value))
                back[e] = np.where(better, t, back[e])
                first[e] = np.where(better, value, first[e])
        rows, e, steps = np.arange(m), np.where(lone, 0, n), []
        while e.any():
            s = back[e, rows]
            on = e > 0
            steps.append(np.where(on, self._piece[nodes[np.where(on, e - s, 1), np.where(on, s, 0), rows]], -1))
            e = np.where(on, s, 0)
        ids = np.array(steps[::-1], np.int64).reshape(len(steps), m).T
        skip = (ids < 0).sum(1).tolist()
        ids = ids.astype("<u4")
        score, loss = first[n].tolist(), (first[n] - second[n]).tolist() if n > 1 else [float("inf")] * m
        return [self._one(c) if alone else (score[i], ids[i, skip[i] :].tobytes(), loss[i]) for i, (c, alone) in enumerate(zip(chunks, lone.tolist()))]

    def _two_best(self, unit: str) -> tuple[float, float, list[int]]:
        """Best score, what the second best loses against it, and the best ids; ties go to the earlier start."""
        n, trie, none = len(unit), self._trie, float("-inf")
        first, second, back = [none] * (n + 1), [none] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for s in range(n):
            one, two, at, e = first[s], second[s], trie, s
            if unit[s] not in at or at[unit[s]][0] is None:
                value = one + self._unknown
                if value > first[s + 1]:
                    first[s + 1], second[s + 1], back[s + 1] = value, max(first[s + 1], two + self._unknown), s
                elif value > second[s + 1]:
                    second[s + 1] = value
            for c in unit[s : s + self._longest]:
                found = at.get(c)
                if found is None:
                    break
                score, at = found
                e += 1
                if score is not None:
                    value = one + score
                    old = first[e]
                    if value > old:
                        value2 = two + score
                        second[e] = old if old > value2 else value2
                        first[e], back[e] = value, s
                    elif value > second[e]:
                        second[e] = value
        ids, e, normal = [], n, self._normal
        while e:
            s = back[e]
            piece = unit[s:e]
            if piece in normal:
                ids.append(normal[piece][0])
            else:
                ids += reversed(self._ids(piece))
            e = s
        ids.reverse()
        return first[n], first[n] - second[n], ids

    def _ids(self, piece: str) -> tuple[int, ...]:
        found = self._normal.get(piece)
        return (found[0],) if found else tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))

    def _edges(self, unit: str) -> list[list[tuple[int, float]]]:
        """For every end: (start, score)."""
        ends: list[list] = [[] for _ in range(len(unit) + 1)]
        get = self._normal.get
        for s in range(len(unit)):
            for e in range(s + 1, min(len(unit), s + self._longest) + 1):
                if found := get(unit[s:e]):
                    ends[e].append((s, found[1]))
            if unit[s] not in self._normal:
                ends[s + 1].append((s, self._unknown))
        return ends

    def unit_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """Up to ``n`` best (score, ids) of a unit, best first."""
        found = self._lists.get((unit, n))
        if found is None:
            if len(self._lists) > self._cached:
                self._lists.clear()
            found = self._search(unit, n)
            if len(unit) <= 64:
                self._lists[unit, n] = found
        return found

    def _search(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        ends = self._edges(unit)
        best = [0.0] * len(ends)
        for e in range(1, len(ends)):
            best[e] = max(best[s] + score for s, score in ends[e])
        last = len(unit)
        agenda = [(-best[last], last, 0, 0.0, None)]
        floor = [best[last]]  # the best distinct paths met so far, at most n; a min-heap
        out, turn = [], 0
        while agenda and len(out) < n:
            total, at, _, after, tail = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                start = 0
                while tail:
                    ids += self._ids(unit[start : tail[0]])
                    start, tail = tail
                out.append((-total, ids))
                continue
            goes_on = False
            for s, score in ends[at]:
                value = best[s] + score + after
                if not goes_on and value == -total:
                    goes_on = True  # the same path, one piece further back
                elif len(floor) < n:
                    heapq.heappush(floor, value)
                elif value < floor[0]:
                    continue
                else:
                    heapq.heapreplace(floor, value)
                turn += 1
                heapq.heappush(agenda, (-value, s, turn, score + after, (at, tail)))
        return out

    def best(self, text: str | None, n: int) -> list[tuple[float, bytes]]:
        """Up to ``n`` best (score, ids as little-endian unsigned 32-bit bytes) of a text, best first."""
        return next(self.best_of([text], n))

    def best_of(self, texts: list[str | None], n: int, together: int = 1 << 21) -> Iterator[list[tuple[float, bytes]]]:
        """``best`` of each text; new chunks of some ``together`` characters are learned at once."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.chunks(text or ""))
            size += len(text or "")
            if size >= together:
                yield from self._merged(held, n)
                held, size = [], 0
        yield from self._merged(held, n)

    def _merged(self, held: list[list[str]], n: int) -> Iterator[list[tuple[float, bytes]]]:
        known = self.learn(set().union(*held))
        for chunks in held:
            yield self._merge(chunks, [known[c] for c in chunks], n)

    def _merge(self, chunks: list[str], found: list[tuple[float, bytes, float]], n: int) -> list[tuple[float, bytes]]:
        losses = np.fromiter((c[2] for c in found), float, len(found))
        near = np.argpartition(losses, n - 2)[: n - 1] if 1 < n <= len(found) else np.arange(len(found))[: n - 1]
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for c in np.sort(near[losses[near] < np.inf]).tolist():
            options = self.unit_best(chunks[c], n)
            more = [(lost + options[0][0] - score, (*picks, (c, k))) for lost, picks in choices for k, (score, _) in enumerate(options)]
            choices = sorted(more, key=lambda x: x[0])[:n]
        top, parts = sum(c[0] for c in found), [c[1] for c in found]
        out = []
        for lost, picks in choices:
            changed = parts.copy() if any(k for _, k in picks) else parts
            for c, k in picks:
                if k:
                    changed[c] = array("I", self.unit_best(chunks[c], n)[k][1]).tobytes()
            out.append((top - lost, b"".join(changed)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the blank that encoding puts first."""
        names, byte_of = self.names, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([names[i] for i in ids])
        else:
            parts = []
            for high, run in groupby(ids, byte_of.__contains__):
                parts.append(bytes(byte_of[i] for i in run).decode("utf-8", "replace") if high else "".join([names[i] for i in run]))
            text = "".join(parts)
        text = text.replace(_SPACE, " ")
        return text[1:] if self._prefix else text


def pieces(path: str) -> Pieces:
    """This process's model of the file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _by_row(df: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, str, pa.DataType]], rows_of) -> DataFrame:
    """``id_col`` untouched beside ``fields`` (name, SQL type, Arrow type); ``rows_of`` gives a tuple for each of a batch's texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*rows_of(batch.column("t").to_pylist()))) or [()] * len(fields)
            made = [pa.array(values, arrow) for values, (_, _, arrow) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", *[name for name, _, _ in fields]])

    schema = ", ".join([f"id {kind}", *[f"{name} {sql}" for name, sql, _ in fields]])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def segmented(df: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``nbest``: up to n structs (score, ids), best first, and ``decoded``, the best one's text."""

    def rows_of(texts: list[str | None]) -> Iterator[tuple]:
        m = pieces(model)
        for found in m.best_of(texts, n):
            found = [(s, np.frombuffer(ids, "<u4").tolist()) for s, ids in found]
            yield [{"score": s, "ids": ids} for s, ids in found], m.decode(found[0][1])

    nbest = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
    return _by_row(df, id_col, text_col, [("nbest", "array<struct<score:double,ids:array<int>>>", nbest), ("decoded", "string", pa.string())], rows_of)


def segmentation_digests(df: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_ids`` and ``ids_crc32`` of the best, all scores and CRCs, and whether decoding gives the text back."""

    def rows_of(texts: list[str | None]) -> Iterator[tuple]:
        m = pieces(model)
        for text, found in zip(texts, m.best_of(texts, n)):
            crcs = [zlib.crc32(ids) for _, ids in found]
            again = m.decode(np.frombuffer(found[0][1], "<u4").tolist())
            yield len(found[0][1]) // 4, crcs[0], [s for s, _ in found], crcs, again == (text or "")

    fields = [
        ("n_ids", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64()), ("scores", "array<double>", pa.list_(pa.float64())),
        ("nbest_crc32", "array<bigint>", pa.list_(pa.int64())), ("round_trip", "boolean", pa.bool_()),
    ]
    return _by_row(df, id_col, text_col, fields, rows_of)
