"""Operator 13: document fingerprints by winnowing.

Every run of GRAM code points gets a rolling hash (differences of prefix sums, so one pass whatever the length). Of each WINDOW
consecutive hashes the least is kept, the rightmost of equal ones, with its position. A text of n code points keeps about
2n / (WINDOW + 1) of them. The guarantee: two texts that share GRAM + WINDOW - 1 code points in a row (87) share a whole window of
hashes and keep the same one of them; runs shorter than GRAM never match. Likeness is the share of kept hashes that two
fingerprints have in common, of all that either has.

The query holds each document against the next one in descending order of doc_id and against itself with its last third
replaced by the next one's beginning. Documents are dealt to ranges of the order, one range a partition, and sorted there. Ranges begin
at rows of a sample whose keys are taken by their hashes (some PER_RANGE a range, the only thing that reaches the driver); the
first row of each range goes to the range before it as well, so that every document finds its successor in its own
partition: texts are shuffled once and there is no window over the whole table.

Defined results: null text is empty; a text shorter than GRAM is one run; the empty text has an empty fingerprint, which is
wholly like another empty one and wholly unlike all others; null doc_ids come last; rows of one doc_id are ordered by their texts'
hashes, then by their texts; equal rows follow each other; a single document is its own successor; very long texts are read whole, as one array; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, prefix_hashes, range_hashes, shuffle_partitions, whole_text

GRAM, WINDOW = 24, 64
#: Sampled keys for each range: ranges then differ by a quarter or so in rows.
PER_RANGE = 16
#: Characters of finished rows that are handed on at once.
CHUNK = 1 << 22
_LAST = (1 << 63) - 1


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of a text and their positions, in order of position."""
    symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(gram, n)
    at = np.arange(n - gram + 1)
    h = mix(range_hashes(prefix_hashes(symbols), at, at + gram))
    window = min(window, len(h))
    # Least of 2**k in a row from the least of 2**(k-1), the right one of equals.
    best, size = at, 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] <= h[a], b, a)

    while 2 * size <= window:
        best = lesser(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = lesser(best[: len(h) - window + 1], best[window - size :])
    keep = best[np.append(True, best[1:] != best[:-1])]
    return h[keep], keep


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def said(hashes: np.ndarray, positions: np.ndarray) -> str:
    return ",".join(f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True))


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as many of the first characters of another, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions for every document, where it is: nothing is shuffled."""

    def rows(batches):
        for batch in batches:
            found = [winnow(x, gram, window) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(rows, "doc_id long, hashes array<long>, positions array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of the order: nulls last, then doc_id descending (as its complement), then the text's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(_LAST)).alias("a"), F.xxhash64("text").alias("tie"))


def _ranges(keyed: DataFrame, parts: int) -> tuple[tuple | None, list[tuple]]:
    """The first key of all, and the keys at which further ranges begin."""
    key = F.struct("n", "a", "tie").alias("key")
    keys = keyed.select(key)
    whole = keys.agg(F.min("key").alias("k"), F.count("*").alias("rows")).first()
    if whole.k is None:
        return None, []
    first = tuple(whole.k)
    # One key in so many, by hash: about PER_RANGE * parts of them, however many rows there are and however often a key is repeated.
    every = max(1, whole.rows // (PER_RANGE * parts))
    sample = sorted({tuple(r.key) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().collect()} - {first})
    step = max(1, -(-len(sample) // parts))
    return first, sample[step - 1 :: step][: parts - 1]


def with_successors(docs: DataFrame, use, schema: str) -> DataFrame:
    """Rows of use(pairs) for every partition, where pairs gives doc_id, text and the successor's text of each of its documents."""
    keyed = _keyed(docs)
    parts = shuffle_partitions(docs.sparkSession)
    first, starts = _ranges(keyed, parts)
    begins = np.array([a for _, a, _ in starts], dtype=np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(n: pa.Array, a: pa.Array, tie: pa.Array) -> pa.Array:
        """Twice the number of a row's range; one more, too, for the range before when the row begins one."""
        a_ = a.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(begins, a_, "left"), np.searchsorted(begins, a_, "right")
        out = (2 * high)[:, None].tolist()
        for i in np.flatnonzero((low < high) | (a_ == (first[1] if first else 0))).tolist():
            key = (n[i].as_py(), a[i].as_py(), tie[i].as_py())
            of = bisect_right(starts, key)
            out[i] = [2 * of]
            if of and bisect_left(starts, key) < of:
                out[i].append(2 * (of - 1) + 1)
            if key == first:
                out[i].append(2 * len(starts) + 1)
        return pa.array(out, pa.list_(pa.int32()))

    dealt = keyed.withColumn("place", F.explode(places("n", "a", "tie"))).withColumn("part", F.shiftright("place", 1)).withColumn("guest", F.col("place").bitwiseAND(1))
    dealt = dealt.repartitionById(len(starts) + 1, "part").sortWithinPartitions("part", "guest", "n", "a", "tie", "text").select("doc_id", "text", "guest", "part")

    def rows(batches):
        def pairs():
            held = None  # the document whose successor comes next
            for batch in batches:
                for doc_id, text, guest in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist(), strict=True):
                    if held is not None:
                        yield *held, text
                    held = None if guest else (doc_id, text)

        yield from use(pairs())

    return dealt.mapInArrow(rows, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def use(pairs):
        done, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        text_of, mine = None, None  # the last successor is the next document
        for doc_id, text, after in pairs:
            own = mine if text_of is text else winnow(text)
            other = winnow(edited(text, after))
            text_of, mine = after, winnow(after)
            sets = [set(f[0].tolist()) for f in (own, other, mine)]
            sha = hashlib.sha256(edited(text, after).encode()).hexdigest()
            done.append((doc_id, len(text), sha, said(*own), said(*other), likeness(sets[0], sets[1]), likeness(sets[0], sets[2])))
            size += len(done[-1][3]) + len(done[-1][4]) + 200
            if size > CHUNK:
                yield batch()
                done, size = [], 0
        if done:
            yield batch()

    return with_successors(docs, use, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
