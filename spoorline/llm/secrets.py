"""Operator 9: secret scans by sliding-window Shannon entropy.

Fixed patterns find assignments, access keys and hexadecimal digests. Beyond these, candidate strings (runs of key
characters) are read with a window of fixed length per character class; counts are moved one character at a time and the
entropy follows from a running sum of c*log2(c). A candidate with a window above its class's threshold is a span of kind
``entropy``, unless an allow-list pattern explains it, a fixed pattern has found all of it, or it is what an assignment assigns.
A candidate of which fixed patterns have found only a piece is a span besides that piece.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; null doc_ids are carried; an empty
table gives an empty table. Very long texts take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
# re.ASCII keeps letters of other alphabets that fold to ASCII ones from matching. Possessive repeats give the same matches
# in linear time: what follows them cannot begin with a character of theirs.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
#: Class: pattern of the whole candidate, window, bits a character that a window must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 20, 3.0),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+\Z"), 20, 3.8),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 24, 4.0),
)
#: A word of a name: of one case, capitalised, or several in a row, each begun by a capital.
_NAME = r"(?:[A-Z]?[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)+|[0-9]{1,4})"
#: Digits alone, such words, also joined by marks, and UUIDs are not secrets. Letters in mixed case are no word.
ALLOWED = (
    re.compile(r"[0-9_=-]+\Z"),
    re.compile(rf"{_NAME}(?:[/_=+-]+{_NAME})*[/_=+-]*\Z"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),
)


def window_entropy(s: str, width: int) -> float:
    """The greatest Shannon entropy, in bits a character, of a window of ``width`` characters (of all of s, if shorter)."""
    width = min(width, len(s))
    if not width:
        return 0.0
    term = [0.0, 0.0] + [c * math.log2(c) for c in range(2, width + 1)]
    count: dict[str, int] = {}
    total, least = 0.0, math.inf
    for i, c in enumerate(s):
        n = count.get(c, 0)
        total += term[n + 1] - term[n] if n < width else 0.0
        count[c] = n + 1
        if i >= width:
            out = s[i - width]
            n = count[out]
            total += term[n - 1] - term[min(n, width)]
            count[out] = n - 1
        if i >= width - 1:
            least = min(least, total)
    return math.log2(width) - least / width


def is_secret(s: str) -> bool:
    if any(p.match(s) for p in ALLOWED):
        return False
    for _, pattern, width, bits in CLASSES:
        if pattern.match(s):
            return window_entropy(s, width) >= bits
    return False


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all spans, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    # Spans of one kind are in order and apart, so that of each kind the last that starts early enough decides.
    starts, ends = ([[s[of] for s in found if s[1] == k] for k in range(3)] for of in (0, 2))
    more = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        assigned = bisect_left(starts[0], b)
        known = assigned and ends[0][assigned - 1] > a
        for k in (1, 2):
            i = bisect_right(starts[k], a)
            known = known or (i and ends[k][i - 1] >= b)
        if not known and is_secret(m[0]):
            more.append((a, 3, b))
    return sorted(found + more)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans for every document."""

    def rows(batches):
        for batch in batches:
            out = [scan(x or "") for x in batch["text"].to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in out], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(said([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in out]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(sha, pa.string()), pa.array(map(said, out), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
