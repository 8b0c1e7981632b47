"""Operator 4: remove byte strings that occur earlier, by a hash-compared suffix sort.

Within a shard (see repeats), the suffixes at window starts are merge-sorted. Two suffixes are compared by the length of
their common extension, which binary search finds with prefix polynomial hashes: log2(100) probes a comparison. The merge
passes run over all groups at once. Neighbours in order that agree over the whole window are verified byte by byte.

Defined results: null text counts as empty; matches never cross documents; null doc_ids come after all others; rows that
are equal in doc_id and text are one document, and each gets its result; rows of one doc_id with unlike texts are ordered
by a hash; texts shorter than the window stay; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import prefix_hashes, range_hashes
from .repeats import Unit, merged, remove_repeats

WINDOW = 100
UNIT = Unit(window=WINDOW, gram=32, words=False)


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols, at most ``most``, in which the suffixes at a and b agree (by hash)."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
    for _ in range(int(most).bit_length()):
        mid = (low + high + 1) >> 1
        same = range_hashes(prefix, a, a + mid) == range_hashes(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(raw: np.ndarray, at: np.ndarray, group: np.ndarray, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Merge-sort the suffixes at ``at`` inside each group (rows of a group stand together).

    Returns the order, and for each place whether its window equals the one before it in its group.
    """
    n = len(at)
    prefix = prefix_hashes(raw.astype(np.uint64) + np.uint64(1))
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(begins, n))
    start, stop = np.repeat(begins, size), np.repeat(begins + size, size)
    order, width = np.arange(n), 1
    widest = int(size.max(initial=0))
    while width < widest:
        place = np.flatnonzero(stop - start > width)
        run = (place - start[place]) // width
        other = start[place] + (run ^ 1) * width
        limit = np.minimum(other + width, stop[place])
        has = other < stop[place]
        place, run, other, limit = place[has], run[has], other[has], limit[has]
        me, low, high, left = at[order[place]], other.copy(), limit.copy(), run % 2 == 0
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            theirs, mine = at[order[mid]], me[todo]
            same = common_extension(prefix, mine, theirs, most)
            end = same >= most
            safe = np.where(end, 0, same)
            before = np.where(end, ~left[todo], raw[theirs + safe] < raw[mine + safe])  # equal ones of the left run come first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        to = start[place] + (run & ~1) * width + (place - start[place]) % width + (low - other)
        moved = order.copy()
        moved[to] = order[place]
        order, width = moved, width * 2
    same = np.zeros(n, dtype=bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = at[order[near]], at[order[near - 1]]
    near = near[range_hashes(prefix, a, a + most) == range_hashes(prefix, b, b + most)]
    for part in np.array_split(near, len(near) // 20_000 + 1):
        rows = at[order[part]][:, None] + np.arange(most), at[order[part - 1]][:, None] + np.arange(most)
        same[part] = (raw[rows[0]] == raw[rows[1]]).all(axis=1)
    return order, same


def find(stretches: list[bytes], lead: np.ndarray, n: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window whether an equal one comes earlier; windows can be equal where key and distance to the anchor are."""
    raw = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    base = np.cumsum([0, *map(len, stretches)])[:-1]
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    by = np.lexsort((lead[which] - j, key[which]))
    k, off = key[which][by], (lead[which] - j)[by]
    group = np.cumsum(np.append(0, (k[1:] != k[:-1]) | (off[1:] != off[:-1])))
    count = np.bincount(group)
    by, group = by[count[group] > 1], group[count[group] > 1]
    out = np.zeros(len(which), dtype=bool)
    if len(by):
        rank, same = suffix_order(raw, (base[which] + j)[by], group)
        when = (order[which] + j)[by][rank]
        kind = np.cumsum(~same) - 1
        first = np.minimum.reduceat(when, np.flatnonzero(~same))
        out[by[rank]] = when > first[kind]
    return out


def finish(text: bytes | None, runs) -> tuple:
    text = text or b""
    gone = merged(runs, len(text), WINDOW)
    kept, last = [], 0
    for a, b in gone:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    return len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    return remove_repeats(docs, UNIT, find, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def finish_text(text: bytes | None, runs) -> tuple:
    if text is None:
        return (None,)
    out, last = [], 0
    for a, b in merged(runs, len(text), WINDOW):
        out.append(text[last:a])
        last = b
    return (b"".join([*out, text[last:]]).decode("utf-8", "replace"),)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and what is left of its text; a character that a removed byte string cuts is replaced by U+FFFD."""
    return remove_repeats(docs, UNIT, find, finish_text, "doc_id long, text string")
