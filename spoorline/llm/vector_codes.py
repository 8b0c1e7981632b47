"""Operator 12: vectors compressed to codes of eight small codebooks, with Orchard's search for the nearest entry.

Components become integers, floor(4096 * x), and every vector is cut into PARTS equal consecutive parts with a codebook of
ENTRIES entries each. Training alternates assignment and componentwise floored means for ROUNDS rounds; all arithmetic is on
integers, so the result depends neither on the order of rows nor on how they are dealt.

The nearest entry is found by Orchard's search: for every entry a list of the others sorted by their distance from it is kept.
Starting from some entry, its list is read; an entry that is nearer to the vector is jumped to and its own list is read from the
start; entries once seen are marked and not measured again; the search ends when the list's next entry is farther from the
current one than twice the current distance, since by the triangle inequality no entry from there on can be nearer. It is exact, ties
included: an entry as near as the current one lies within that bound, and the lower index wins.

A round reads the vectors where they are (nothing but sums is shuffled): every task sends at most PARTS * ENTRIES entries'
sums. Codebooks hold 16 integers for each component of a vector, whatever the number of vectors; only they reach the driver.
Errors by label are summed up before the shuffle and joined back over SPREAD keys a label, so that one label with a third of all
rows does not meet in one task.

Defined results: vectors that are null, or hold nulls or numbers that are not finite, are dropped; so are vectors of another
length than that of the least vec_id's vector, which must be a multiple of PARTS (ValueError); components must lie within
2**13 of 0 (ValueError), which keeps squares in 64 bits; null vec_ids come last in the order, equal ones are ordered by their
vectors, and repeated rows count each; with fewer than ENTRIES vectors the codebooks are as short; null labels are one
label; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Keys over which the rows of one label are dealt when its sum is joined back.
SPREAD = 32
LIMIT = 1 << 13
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every entry's other entries, nearest first, and the squared distances between all entries."""
    d = ((book[:, None] - book[None]) ** 2).sum(2)
    lists = [[j for j in np.argsort(d[i], kind="stable").tolist() if j != i] for i in range(len(book))]
    return np.array(lists, dtype=np.int64).reshape(len(book), len(book) - 1), d


def orchard(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of x (the lower index of equals) and its squared distance; all rows walk at once."""
    lists, apart = neighbours(book)
    now = np.zeros(len(x), dtype=np.int64)
    best = ((x - book[0]) ** 2).sum(1)
    seen = np.ones(len(x), dtype=np.int64)  # a bit for each entry
    at = np.zeros(len(x), dtype=np.int64)
    active = np.arange(len(x))
    while len(active):
        active = active[at[active] < lists.shape[1]]
        entry = lists[now[active], at[active]]
        within = apart[now[active], entry] <= 4 * best[active]
        active, entry = active[within], entry[within]
        at[active] += 1
        new = (seen[active] >> entry) & 1 == 0
        rows, entry = active[new], entry[new]
        seen[rows] |= 1 << entry
        d = ((x[rows] - book[entry]) ** 2).sum(1)
        nearer = (d < best[rows]) | ((d == best[rows]) & (entry < now[rows]))
        rows, entry = rows[nearer], entry[nearer]
        now[rows], best[rows], at[rows] = entry, d[nearer], 0
    return now, best


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers from an Arrow column of lists of ``width`` finite numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), PARTS, width // PARTS)
    if (np.abs(values) > LIMIT).any():
        raise ValueError(f"a component lies beyond {LIMIT}")
    return np.floor(SCALE * values).astype(np.int64)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and label of the rows that are kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label"))
    return v.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def first_books(kept: DataFrame) -> list[np.ndarray]:
    """Codebooks of the first vectors by vec_id, one a part; empty for an empty table."""
    first = [r.embedding for r in kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()]
    if not first:
        return []
    width = len(first[0])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    start = kept.where(F.size("embedding") == width).select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    whole = _integers(pa.array([r.embedding for r in start], pa.list_(pa.float64())), width)
    return [np.ascontiguousarray(whole[:, p]) for p in range(PARTS)]


def trained(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after ROUNDS rounds."""
    width = sum(b.shape[1] for b in books)

    def sums(batches):
        """slot (part * ENTRIES + entry), position (-1: count) and sum over a task's vectors."""
        total = np.zeros((PARTS * ENTRIES, width // PARTS + 1), dtype=np.int64)
        for batch in batches:
            x = _integers(batch["embedding"], width)
            for p, book in enumerate(books):
                code, _ = orchard(x[:, p], book)
                order = np.argsort(code, kind="stable")
                has, begin, count = np.unique(code[order], return_index=True, return_counts=True)
                if len(has):
                    total[p * ENTRIES + has, 0] += count
                    total[p * ENTRIES + has, 1:] += np.add.reduceat(x[order, p], begin, axis=0)
        slot, position = (a.ravel() for a in np.indices(total.shape))
        used = np.repeat(total[:, 0] > 0, total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(slot[used].astype(np.int32)), pa.array((position[used] - 1).astype(np.int32)), pa.array(total.ravel()[used])], names=["slot", "position", "s"])

    rows = kept.where(F.size("embedding") == width).select("embedding")
    for _ in range(ROUNDS):
        # At most PARTS * ENTRIES * (width / PARTS + 1) rows, whatever the number of vectors.
        found = rows.mapInArrow(sums, "slot int, position int, s long").groupBy("slot", "position").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        count = {r.slot: int(r.s) for r in found if r.position < 0}
        new = [b.copy() for b in books]
        for r in found:
            if r.position >= 0:
                new[r.slot // ENTRIES][r.slot % ENTRIES, r.position] = int(r.s) // count[r.slot]
        books = new
    return books


def encoded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error for every vector of the codebooks' width."""
    width = sum(b.shape[1] for b in books)

    def rows(batches):
        for batch in batches:
            x = _integers(batch["embedding"], width)
            text = np.full((len(x), 2 * PARTS), _HEX[0], dtype=np.uint8)
            error = np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(books):
                code, d = orchard(x[:, p], book)
                text[:, 2 * p + 1] = _HEX[code]
                error += d
            code = pa.Array.from_buffers(pa.binary(2 * PARTS), len(x), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept.where(F.size("embedding") == width).mapInArrow(rows, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every vector that is kept."""
    kept = whole_vectors(vectors)
    books = first_books(kept)
    if not books:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(kept, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    codes = checkpoint(encoded(kept, books)).withColumn("deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int"))
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("deal") == F.col("dealt"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
