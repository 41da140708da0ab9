"""Conversation structure repair by error-correcting Earley parsing over a weighted role grammar.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.
``GRAMMAR`` says so with left-recursive productions; beside scanning a row as it
is (K), the chart may give it another role (R), leave it out (D) or assume a row
that isn't there (I), each at its weight.  An item keeps its least (cost, audit),
the audit being the letters of its edits in order; a column is closed best first,
so an item is final when it is taken up.  The least completed item is the repair.

Two facts bound what is held.  Every production but those of the first column
begins with what has been parsed so far, so the chart is its first column and its
latest.  And whatever an item can still do, any other can do at ``slack`` more at
most: items dearer than the cheapest by more than that are dropped, which loses
nothing, and the rest soon agree on how they began.  Rows on which all agree are
put out at once, so a conversation of any length passes through in its order, and
no task holds one.

Order: by turn, null turns first; rows of one turn by role, then text.  Spark
sorts and finds repeated rows (both spill); one shuffle by conversation.

Defined cases: a null role or text counts as one space; a null id is a
conversation of its own; repeated rows are duplicates and are deleted; a text
without a visible character must be deleted; other columns may have any name;
an empty table gives an empty result; a conversation whose rows are all absent
has a summary only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What isn't a key is the initial of a role.
GRAMMAR = {
    "conversation": ((), ("closed",)),
    "closed": (("open", "a"),),
    "open": (("u",), ("system", "u"), ("closed", "u")),
    "system": (("s",),),
}
#: Roles that an edit may give.
GIVEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_BLANKS = " \t\n\v\f\r"
_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Chart:
    """The latest column of an error-correcting Earley parse.

    An item is (symbol, production, dot); its value (cost, audit, terms), where
    ``terms`` names the initial that each edit stands for ("-" for a deletion).
    """

    def __init__(self, grammar: dict = GRAMMAR, start: str = "conversation"):
        self._grammar, self._start = grammar, start
        self._slack = max(DELETE + INSERT, 2 * INSERT)
        #: Items of the first column by the symbol that they wait for.
        self._waiting: dict[str, list[tuple[str, int, int]]] = {}
        seen = {start}
        agenda = [start]
        while agenda:  # predict
            symbol = agenda.pop()
            for k, body in enumerate(grammar[symbol]):
                if body and body[0] in grammar:
                    self._waiting.setdefault(body[0], []).append((symbol, k, 0))
                    if body[0] not in seen:
                        seen.add(body[0])
                        agenda.append(body[0])
                if any(x in grammar for x in body[1:]):
                    raise ValueError(f"{symbol}: only the first symbol of a production may have productions")
        self.column = self._closed([(0, "", "", (symbol, k, 0)) for symbol in seen for k in range(len(grammar[symbol]))])

    def _next(self, item: tuple[str, int, int]) -> str | None:
        body = self._grammar[item[0]][item[1]]
        return body[item[2]] if item[2] < len(body) else None

    def _closed(self, agenda: list[tuple]) -> dict:
        """Completes items and inserts rows, cheapest first."""
        heapify(agenda)
        column: dict[tuple, tuple[int, str, str]] = {}
        most = agenda[0][0] + self._slack if agenda else 0
        while agenda:
            cost, audit, terms, item = heappop(agenda)
            if cost > most:
                break
            if item in column:
                continue
            column[item] = cost, audit, terms
            symbol = self._next(item)
            if symbol is None:
                for owner, k, dot in self._waiting.get(item[0], ()):
                    heappush(agenda, (cost, audit, terms, (owner, k, dot + 1)))
            elif symbol in GIVEN:
                heappush(agenda, (cost + INSERT, audit + "I", terms + symbol, (*item[:2], item[2] + 1)))
        return column

    def row(self, initial: str, doomed: bool, truncated: bool) -> None:
        """Takes up one row; ``doomed`` ones can only be deleted."""
        agenda, more = [], TRUNCATED if truncated else 0
        for item, (cost, audit, terms) in self.column.items():
            symbol = self._next(item)
            if symbol in self._grammar:
                continue
            agenda.append((cost + DELETE, audit + "D", terms + "-", item))
            if symbol is not None and not doomed:
                after = (*item[:2], item[2] + 1)
                if symbol == initial:
                    agenda.append((cost + more, audit + "K", terms + symbol, after))
                elif symbol in GIVEN:
                    agenda.append((cost + more + REROLE, audit + "R", terms + symbol, after))
        self.column = self._closed(agenda)

    def settled(self) -> tuple[str, str]:
        """The edits (and terms) with which all items begin; the chart forgets them."""
        audits = [v[1] for v in self.column.values()]
        low, high = min(audits), max(audits)
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        terms = next(iter(self.column.values()))[2][:n]
        self.column = {item: (c, a[n:], t[n:]) for item, (c, a, t) in self.column.items()}
        return low[:n], terms

    def best(self) -> tuple[int, str, str]:
        """The least value of a complete parse."""
        return min(v for item, v in self.column.items() if item[0] == self._start and self._next(item) is None)


class Repair:
    """One conversation on its way: its chart, the rows that are not settled yet, and its counts."""

    def __init__(self, every: int = 64):
        self._chart, self._pending, self._every, self._limit, self._place = Chart(), [], every, every, 0
        self._audit: list[str] = []
        self._blank = self._duplicate = self._truncated = self._illegal = self._turns = 0
        self._first = self._last = self._before = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> list[tuple]:
        visible = text.strip(_BLANKS)
        cut = bool(visible) and not seen and visible[-1] not in ".!?"
        self._blank += not visible
        self._duplicate += bool(visible) and seen
        self._truncated += cut
        if self._before is not None:
            self._illegal += self._before + role[:1] not in ("su", "ua", "au")
        self._before = role[:1]
        if turn is not None and turn != self._last:
            self._first, self._last, self._turns = turn if self._first is None else self._first, turn, self._turns + 1
        self._chart.row(role[:1], seen or not visible, cut)
        self._pending.append((turn, role, text))
        if len(self._pending) < self._limit:
            return []
        out = self._put(*self._chart.settled())
        self._limit = max(self._every, 2 * len(self._pending))
        return out

    def _put(self, audit: str, terms: str) -> list[tuple]:
        """Rows (place, edit, turn, role, text) of these edits, which the oldest pending rows undergo."""
        out, at = [], 0
        for edit, term in zip(audit, terms):
            turn, role, text = (None, None, "") if edit == "I" else self._pending[at]
            at += edit != "I"
            place = None if edit == "D" else self._place
            self._place += edit != "D"
            out.append((place, edit, turn, GIVEN[term] if edit in "RI" else role, text))
        del self._pending[:at]
        self._audit.append(audit)
        return out

    def end(self) -> tuple[list[tuple], tuple]:
        """The last rows, and the summary."""
        cost, audit, terms = self._chart.best()
        out = self._put(audit, terms)
        gaps = 0 if self._first is None else self._last - self._first + 1 - self._turns
        return out, (gaps, self._blank, self._duplicate, self._truncated, self._illegal, cost, "".join(self._audit))


def _same(a, b) -> bool:
    return a == b or a != a and b != b  # NaN ids are one, as in Spark


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of about that size from (row, its bytes)."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The edited rows of each conversation in order, then a summary row.

    ``id, place, edit, turn, role, text``: place counts the rows that stay and is
    null for deleted ones.  The summary row has a null edit and the only values of
    gaps, blank, duplicate, truncated, illegal, cost and audit.  Rows that are not
    ``present`` only make their conversation known.
    """
    kind = df.schema[id_col].dataType.simpleString()
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), there.alias("there"))
    rows = rows.repartition("id")
    # The dealing by id serves this window too.
    nth = F.row_number().over(Window.partitionBy("id", "there", "role", "text").orderBy("turn"))
    rows = rows.withColumn("seen", nth > 1).sortWithinPartitions("id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def edits() -> Iterator[tuple[tuple, int]]:
            current, now = None, None

            def ended() -> Iterator[tuple[tuple, int]]:
                out, summary = now.end()
                yield from (((current, *r, *[None] * 7), len(r[4])) for r in out)
                yield (current, *[None] * 5, *summary), len(summary[6])

            for batch in batches:
                kinds[:] = [batch.schema.field("id").type]
                for key, turn, role, words, there, seen in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or not _same(key, current):
                        if now is not None:
                            yield from ended()
                        current, now = key, Repair()
                    if there:
                        yield from (((current, *r, *[None] * 7), len(r[4])) for r in now.add(turn, role, words, seen))
            if now is not None:
                yield from ended()

        made = edits()
        first = next(made, None)
        if first is None:
            return
        whole = pa.int64()
        names = [("place", whole), ("edit", pa.string()), ("turn", whole), ("role", pa.string()), ("text", pa.string())]
        names += [(c.split()[0], pa.string() if c.endswith("string") else whole) for c in _SUMMARY.split(", ")]

        def again() -> Iterator[tuple[tuple, int]]:
            yield first
            yield from made

        yield from _batches(again(), pa.schema([("id", kinds[0]), *names]))

    out = rows.mapInArrow(run, f"id {kind}, place bigint, edit string, turn bigint, role string, text string, {_SUMMARY}")
    return out.withColumnRenamed("id", id_col)


def damaged(df: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text, there`` with the faults that the registered query plants, by crc32 of "conv_id:turn"."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(what == 4, "user").otherwise(shown("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(what == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (what != 0).alias("there"), copies.alias("_copy")).drop("_copy")


def summaries(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation of ``repaired``: its summary and ``repaired_sha256`` of "role:text", joined by newlines.

    Reads the rows in the order in which ``repaired`` puts them out.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            ends, hashes = [], []
            columns = [batch.column(c).to_pylist() for c in ("place", "edit", "role", "text")]
            for k, (place, edit, role, text) in enumerate(zip(*columns)):
                if edit is None:
                    ends.append(k)
                    hashes.append(digest.hexdigest())
                    digest, begun = hashlib.sha256(), False
                elif place is not None:
                    digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
            held = batch.take(pa.array(ends, pa.int64()))
            names = [n.split()[0] for n in _SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([held.column(0), *[held.column(n) for n in names], pa.array(hashes, pa.string())], ["id", *names, "repaired_sha256"])

    return rows.withColumnRenamed(id_col, "id").mapInArrow(run, f"id {kind}, {_SUMMARY}, repaired_sha256 string").withColumnRenamed("id", id_col)
