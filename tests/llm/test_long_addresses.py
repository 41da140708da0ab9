"""Long addresses in a JVM of their own, whose stack no earlier test has warmed up."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest

from chronoloom.llm import pii

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import json, sys, time
from pyspark.sql import SparkSession
from chronoloom.llm import pii
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
shapes = {"labels": lambda n: "x@a" + ".a" * n, "domain": lambda n: "x@" + "b" * n + ".c", "local": lambda n: "y" * n + "@b.c", "no end": lambda n: "z" * n + "@", "many": lambda n: "q@r.s " * (n // 6)}
out = []
for n in map(int, sys.argv[1:]):
    for name, make in shapes.items():
        began = time.time()
        row = pii.pseudonymised(spark.createDataFrame([(1, f"to {make(n)}!")], "doc_id long, text string"), "k").first()
        out.append([name, n, time.time() - began, row.n_email, row.text])
print("ROWS" + json.dumps(out))
"""


def _moved(s, i, other, sign):
    other = hashlib.sha256(other.encode()).hexdigest() if len(other) > 512 else other
    digest = "".join(hashlib.sha256(f"k|email|{i}|{n}|{other}".encode()).hexdigest() for n in range((len(s) + 31) // 32))
    return "".join(chr((ord(c) - 97 + sign * int(digest[2 * k : 2 * k + 2], 16)) % 26 + 97) if c.isalpha() else c for k, c in enumerate(s))


def _restored(x):
    head, dot, tail = x.rpartition(".")
    left, right = head[: len(head) // 2], head[len(head) // 2 :]
    for i in reversed(range(pii.ROUNDS)):
        left, right = (_moved(left, i, right, -1), right) if i % 2 == 0 else (left, _moved(right, i, left, -1))
    return left + right + dot + tail


@pytest.fixture(scope="module")
def rows():
    run = subprocess.run([sys.executable, "-c", RUN, "1", "100", "2000", "100000"], cwd=ROOT, capture_output=True, text=True, timeout=400)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
    return json.loads(run.stdout.split("ROWS")[1])


def test_long_addresses_come_back(rows):
    was = {"labels": lambda n: "x@a" + ".a" * n, "domain": lambda n: "x@" + "b" * n + ".c", "local": lambda n: "y" * n + "@b.c"}
    for name, n, _, found, text in rows:
        if name in was:
            assert found == 1 and _restored(text[3:-1]) == was[name](n) != text[3:-1], (name, n)
        elif name == "no end":
            assert found == 0 and text == f"to {'z' * n}@!"
        else:
            assert found == n // 6 and len(set(text[3:-1].split())) <= 1


def test_time_follows_the_length(rows):
    took = {(name, n): s for name, n, s, _, _ in rows}
    for name in {name for name, _ in took}:
        assert took[name, 100_000] < took[name, 2000] + 8, (name, took)
