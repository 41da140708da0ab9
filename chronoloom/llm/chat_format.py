"""Chat formatting of records of any layout, chosen by a fingerprint of their schema.

1. **Fingerprint.**  The paths of a JSON record, such as ``messages[].role``, are
   sorted, joined by newlines and hashed; names and nesting count, values and
   their order do not.
2. **Mapping.**  A table of declarative layouts says for each fingerprint where the
   turns are: in a list (with the paths of role and text in its elements), or in
   fields of given roles (joined by an empty line where several make one turn).
   Optional paths give a layout several fingerprints.  Records that no layout fits
   end the job with their paths, or come back by ``unmapped``; none is dropped.
3. **Template.**  ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.  In
   texts and roles every ``<``, any backslashes, ``|`` gets one backslash more, so
   no control string can occur in them and taking one away restores them.  A line
   feed of a role, which would end it, is written as ``<n|``; a role's own ``<n|``
   gets a backslash in the same way.
4. **Parts.**  Turns stream in their order through Spark's sort; what is put out are
   parts of a conversation, cut between turns after ``part_chars``, each with the
   spans (code points, end exclusive) of its loss mask: the texts of assistant
   turns.  So no task holds a conversation, however long.

Order: by the record's order (nulls first), ties by the record's text, then by
place in the record.

Defined cases: a null text or role counts as empty; a null record is one without
paths and has no turns, as has an empty list; repeated records are turns each;
a null id is a conversation of its own; other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LINE, _ESCAPED_LINE = re.compile(r"<(\\*)n\|"), re.compile(r"<\\(\\*)n\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Where a record has its turns.

    Either ``turns`` is the path of a list whose elements have ``role`` and
    ``text``, or ``fields`` are (role, paths) in the order of the turns.  ``renamed``
    gives roles their canonical names, ``optional`` are paths that may be absent
    and ``ignored`` ones that must be there but carry no turn.
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    def path_sets(self) -> Iterator[frozenset[str]]:
        """The sets of paths that this layout describes."""
        own = {f"{self.turns}[].{p}" for p in (self.role, self.text)} if self.turns else {p for _, paths in self.fields for p in paths}
        always = (own | set(self.ignored)) - set(self.optional)
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield frozenset(always | set(some))


_SHARED = (("human", "user"), ("gpt", "assistant"))
LAYOUTS = (
    Layout("messages", "messages", "role", "content", optional=("messages[].name",)),
    Layout("conversations", "conversations", "from", "value", renamed=_SHARED),
    Layout("authors", "mapping", "author.role", "content.parts[]"),
    Layout("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_completion", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Layout("prompt", fields=(("user", ("prompt",)),)),
    Layout("completion", fields=(("assistant", ("completion",)),)),
    Layout("system", fields=(("system", ("system",)),)),
)


def paths_of(record) -> set[str]:
    """The paths of all values of a parsed record that are no objects or lists; an empty one is a path of its own."""
    found: set[str] = set()
    todo = [("", record)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(f"{at}[]", v) for v in value]
        elif value is not None or at:
            found.add(at + {dict: "{}", list: "[]"}.get(type(value), ""))
    return found


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry_of(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """Layouts by fingerprint; a list without elements has the path of the list alone."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        sets = [*layout.path_sets(), *([frozenset({f"{layout.turns}[]"})] if layout.turns else [])]
        for paths in sets:
            if out.setdefault(fingerprint(paths), layout) is not layout:
                raise ValueError(f"{layout.name} and {out[fingerprint(paths)].name} describe the same paths")
    return out


def _at(value, path: str) -> str:
    """The text at a path; a list's elements are joined by newlines."""
    for name in path.split("."):
        many = name.endswith("[]")
        value = (value or {}).get(name.removesuffix("[]"))
        if many:
            value = "\n".join("" if v is None else str(v) for v in value or [])
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """Canonical (role, text) turns."""
    if layout.turns:
        names = dict(layout.renamed)
        found = [(_at(x, layout.role), _at(x, layout.text)) for x in record[layout.turns]]
        return [(names.get(role, role), text) for role, text in found]
    out = []
    for role, paths in layout.fields:
        parts = [_at(record, p) for p in paths]
        out.append((role, "\n\n".join([parts[0], *[p for p in parts[1:] if p]])))
    return out


def turns(df: DataFrame, id_col: str, order_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = True) -> DataFrame:
    """``id, order, record_key, place, layout, fingerprint, role, text``: the canonical turns of JSON records.

    Without ``strict``, a record that no layout fits has one row with a null layout and the record as its text.
    """
    known = registry_of(layouts)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, order_col)]
    names = ["id", "order", "record_key", "place", "layout", "fingerprint", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for k, text in enumerate(batch.column("record").to_pylist()):
                record = None if text is None else json.loads(text)
                paths = paths_of(record)
                mark, key = fingerprint(paths), hashlib.sha256((text or "").encode()).hexdigest()
                layout = known.get(mark)
                if layout is None and paths and strict:
                    raise ValueError(f"no layout for the paths {sorted(paths)} ({mark})")
                found = turns_of(record, layout) if layout else [(None, text)] if paths else []
                owner += [k] * len(found)
                rows += [(key, p, layout and layout.name, mark, *t) for p, t in enumerate(found)]
            at = pa.array(owner, pa.int64())
            kinds_out = (pa.string(), pa.int32(), *[pa.string()] * 4)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds_out)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("order").take(at), *columns], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(order_col).alias("order"), F.col(record_col).alias("record"))
    return rows.mapInArrow(run, f"id {kinds[0]}, `order` {kinds[1]}, record_key string, place int, layout string, fingerprint string, role string, text string")


def unmapped(df: DataFrame, id_col: str, order_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``fingerprint, records, example``: what no layout fits, with the smallest record of each kind."""
    rows = turns(df, id_col, order_col, record_col, layouts, strict=False).where("layout IS NULL")
    return rows.groupBy("fingerprint").agg(F.count("*").alias("records"), F.min("text").alias("example"))


def escaped(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(_LINE.sub(r"<\\\1n|", role).replace("\n", "<n|"))


def unescaped_role(role: str) -> str:
    return _ESCAPED_LINE.sub(r"<\1n|", unescaped(role).replace("<n|", "\n"))


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _same(a, b) -> bool:
    return a == b or a != a and b != b  # NaN ids are one, as in Spark


def formatted(rows: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """``id, part, formatted, loss`` of ``turns``: a conversation's parts in order; ``loss`` are the spans under the mask."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "part", "formatted", "loss"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows = rows.where("layout IS NOT NULL").select("id", "order", "record_key", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "order", "record_key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of_id = None
        done, chars = [], 0
        current, part, pieces, size, loss = None, -1, [], 0, []

        def cut() -> None:
            done.append((current, part, "".join(pieces), [{"start": a, "end": b} for a, b in loss]))

        for batch in batches:
            kind_of_id = batch.schema.field("id").type
            for key, role, text in _rows([batch], ("id", "role", "text")):
                if part < 0 or not _same(key, current):
                    if part >= 0:
                        cut()
                    current, part, pieces, size, loss = key, 0, [], 0, []
                elif size >= part_chars:
                    cut()
                    part, pieces, size, loss = part + 1, [], 0, []
                head, body = f"{OPEN}{escaped_role(role)}\n", escaped(text)
                if role == "assistant":
                    loss.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, CLOSE]
                size += len(head) + len(body) + len(CLOSE)
                chars += len(body)
                if chars >= 1 << 24 and done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind_of_id, pa.int64(), pa.string(), span))], names)
                    done, chars = [], 0
        if part >= 0:
            cut()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind_of_id, pa.int64(), pa.string(), span))], names)

    return rows.mapInArrow(run, f"id {kind}, part bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted part; one that isn't made by the template is an error."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"not a formatted conversation at character {at}")
        out.append((unescaped_role(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def read_back(parts: DataFrame) -> DataFrame:
    """``id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read from the formatted text and its mask.

    Reads the parts in the order in which ``formatted`` puts them out.
    """
    kind = parts.schema["id"].dataType.simpleString()
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    whole = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of_id, done, state, current = None, [], None, None

        def end() -> None:
            n, all_turns, chars, under, size = state
            done.append((current, n, all_turns.hexdigest(), chars, under.hexdigest(), size))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind_of_id, whole, pa.string(), whole, pa.string(), whole))], names)

        for batch in batches:
            kind_of_id = batch.schema.field("id").type
            for key, part, text, loss in _rows([batch], ("id", "part", "formatted", "loss")):
                if part == 0:
                    if state is not None:
                        end()
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, words in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{words}\n".encode())
                for x in loss:
                    words = unescaped(text[x["start"] : x["end"]])
                    state[2] += len(words)
                    state[3].update(words.encode())
                state[4] += len(text)
            if len(done) >= 4096:
                yield out()
                done = []
        if state is not None:
            end()
            yield out()

    return parts.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def mixed_records(df: DataFrame) -> DataFrame:
    """``conv_id, turn, record``: the rows of ``conversations`` as JSON records of several layouts.

    A user row and the assistant row after it make one record of two turns, other
    rows one of their own; crc32 of "conv_id:turn" picks the layout among those
    that can say the roles.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(w), "next": F.lead(F.struct("role", "text")).over(w), "before": F.lag("role").over(w)})
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    paired = asks & (F.col("next.role") == "assistant")
    rows = rows.where(~(answers & (F.coalesce("before", F.lit("")) == "user")))
    pick = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary"))
    again = F.coalesce("next.text", F.lit(""))
    named = lambda c: F.when(c == "user", "human").when(c == "assistant", "gpt").otherwise(c)
    # A role that is itself named human or gpt would be renamed by that layout.
    shared = ~F.col("role").isin("human", "gpt")

    def listed(make) -> Column:
        return F.when(paired, F.array(make(F.col("role"), F.col("text")), make(F.lit("assistant"), again))).otherwise(F.array(make(F.col("role"), F.col("text"))))

    messages = F.to_json(F.struct(listed(lambda r, t: F.struct(r.alias("role"), t.alias("content"))).alias("messages")))
    conversations = F.to_json(F.struct(listed(lambda r, t: F.struct(named(r).alias("from"), t.alias("value"))).alias("conversations")))
    nested = F.to_json(F.struct(listed(lambda r, t: F.struct(F.struct(r.alias("role")).alias("author"), F.struct(F.array(t).alias("parts")).alias("content"))).alias("mapping")))
    pair = F.to_json(F.struct(F.col("text").alias("prompt"), again.alias("completion")))
    task = F.to_json(F.struct(F.col("text").alias("instruction"), F.lit("").alias("input"), again.alias("output")))
    single = F.when(asks, F.to_json(F.struct(F.col("text").alias("prompt")))).when(answers, F.to_json(F.struct(F.col("text").alias("completion"))))
    single = single.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("system")))).otherwise(messages)
    record = F.when(pick % 5 == 0, messages).when((pick % 5 == 1) & shared, conversations).when(pick % 5 == 2, nested)
    record = record.when(paired & (pick % 5 == 3), pair).when(paired, task).otherwise(single)
    return rows.select("conv_id", F.col("at").cast("long").alias("at"), record.alias("record"))
