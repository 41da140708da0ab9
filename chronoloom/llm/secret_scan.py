"""Secret scans: fixed patterns, and the token efficiency of opaque strings.

A byte-pair vocabulary learned on ordinary text spells words in few tokens and
random strings in many.  Candidates are runs of at least 16 letters, digits and
``+/_-`` that hold a letter; those with fewer than ``max_ratio`` characters a
token are reported as kind ``opaque``, whether or not they hold digits.  Known
digests (hexadecimal of the usual lengths), UUIDs and plain numbers are left out
first, as are spans inside one that a pattern found.

Defined cases: a null text counts as empty; rows are independent, so repeated
rows are treated like any; ids of any type and null ids come back as they are;
only the id and the text are read, so other columns may have any name.  Time
grows with a text's length, whatever the number of its finds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}
_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of the rank file, kept per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known_name(run: str) -> bool:
    """Whether the run is a digest, an identifier or a number rather than a secret."""
    bare = run.rstrip("=")
    if not re.search(r"[A-Za-z]", bare):
        return True
    return bool(re.fullmatch(r"[0-9a-fA-F]+", bare) and len(bare) in _DIGESTS or _UUID.fullmatch(bare))


def spans_of(text: str | None, count_tokens, max_ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    opaque, at, reach = [], 0, 0
    for m in _RUN.finditer(text):
        while at < len(found) and found[at][0] <= m.start():
            reach = max(reach, found[at][2])
            at += 1
        if m.end() > reach and not known_name(m[0]) and len(m[0]) < max_ratio * count_tokens(m[0]):
            opaque.append((m.start(), 3, m.end()))
    return sorted(found + opaque)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2
) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_opaque, base_sha256, spans for every row."""
    counts = "n_assign bigint, n_access bigint, n_hex bigint, n_opaque bigint"

    @F.pandas_udf(f"{counts}, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        encode = encoding(vocabulary, pattern).encode_ordinary
        rows = []
        for text in texts.tolist():
            spans = spans_of(text, lambda s: len(encode(s)), max_ratio)
            kinds = [k for _, k, _ in spans]
            base = joined([s for s in spans if s[1] < 3])
            rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_opaque", "base_sha256", "spans"])

    return df.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("found")).select(F.col("id").alias(id_col), "found.*")
