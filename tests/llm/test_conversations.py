"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import conversation_repair, registry

BLANK = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    """The planted faults, by definition."""
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    return out


def _best(rows):
    """(cost, audit, repaired turns) by a search over every sequence of edits; rows are (initial, role, text, doomed, truncated)."""
    # States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @cache
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def then(cost, letter, turn, after):
            if after is not None:
                c, audit, turns = after
                found.append((cost + c, letter + audit, turn + turns))

        for to, new in steps[state].items():
            if to in names and inserted < 3:
                then(3, "I", ((names[to], ""),), rest(i, new, inserted + 1))
        if i < len(rows):
            initial, role, text, doomed, truncated = rows[i]
            then(4, "D", (), rest(i + 1, state, 0))
            for to, new in {} if doomed else steps[state].items():
                if to == initial:
                    then(3 * truncated, "K", ((role, text),), rest(i + 1, new, 0))
                if to in names:
                    then(3 + 3 * truncated, "R", ((names[to], text),), rest(i + 1, new, 0))
        return min(found, default=None)

    return rest(0, 0, 0)


def _want(rows):
    """The query's columns for the rows of one conversation as they are after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, judged, counts = set(), [], Counter()
    for _, _, role, text in rows:
        visible = text.strip(BLANK)
        blank, double = not visible, bool(visible) and (role, text) in seen
        cut = bool(visible) and not double and visible[-1] not in ".!?"
        seen.add((role, text))
        counts.update(blank=blank, duplicate=double, truncated=cut)
        judged.append((role[:1], role, text, blank or double, cut))
    turns = {r[1] for r in rows} - {None}
    cost, audit, kept = _best(tuple(judged))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    text = "\n".join(f"{role}:{words}" for role, words in kept)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _random(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", " \t\n", "", None, "a. b", "é日本!", "Fine.  \n", f"t{rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None, 3, turn * 5 - 7]), role, text))
    return [*rows, (None, 0, "user", "Hi."), (None, None, None, None)]


def test_repair_is_the_cheapest(spark):
    rows = _random(250, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("x"), "there": F.lit(1), "edit": F.lit(2)})
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.summaries(conversation_repair.repaired(conversation_repair.damaged(df), present=F.col("there"))).collect()}
    after = {}
    for r in _damaged(rows):
        after.setdefault(r[0], []).append(r)
    assert got == {conv: _want(after.get(conv, [])) for conv in {r[0] for r in rows}}


def test_repair_on_a_whole_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    after = {r[0]: [] for r in rows}
    for r in _damaged(rows):
        after[r[0]].append(r)
    got = registry.queries()["op11_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {conv: _want(own) for conv, own in after.items()}


def test_repaired_turns_are_well_formed(spark):
    df = spark.createDataFrame(_random(60, 8), SCHEMA)
    rows = conversation_repair.repaired(df).where("place is not null").collect()
    for conv in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))


def test_a_long_conversation_is_put_out_as_it_goes(spark):
    """Rows are settled long before the end, and the chart stays small."""
    rng = random.Random(3)
    now, most, out = conversation_repair.Repair(), 0, []
    for turn in range(20_000):
        out += now.add(turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", ""]), False)
        most = max(most, len(now._pending), *(len(v[1]) for v in now._chart.column.values()))
    rest, summary = now.end()
    assert most < 400 and len(rest) < 400
    assert len(summary[6]) == len(out) + len(rest) and Counter(summary[6])["I"] + 20_000 == len(summary[6])


def test_repair_of_nothing(spark):
    empty = conversation_repair.repaired(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and conversation_repair.summaries(empty).collect() == []


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_come_back(spark, kind):
    ids = ["a", "b", None] if kind == "string" else [1.5, float("nan"), None]
    df = spark.createDataFrame([(i, t, "user", "Hi.") for i in ids for t in (0, 1)], f"conv_id {kind}, turn long, role string, text string")
    got = conversation_repair.summaries(conversation_repair.repaired(df)).collect()
    assert sorted(str(r.conv_id) for r in got) == sorted(str(i) for i in ids) and {r.audit for r in got} == {"KDI"}
