"""Operator 5: remove windows of words that occur earlier, with an FM-index per shard.

Within a shard (see repeats), the stretches of words are one text with separators. Its Burrows-Wheeler transform is kept in
a wavelet tree of packed bits with sampled counts. The documents' stretches are streamed past it: backward search from
every end of a window, all ends at once, narrows an interval of the suffix array word by word, and stops where it holds one
suffix only. Ends whose matching statistic reaches the window's length report an interval; equal windows share it, and all
but the first window in it are repeats.

Defined results: null text has no words; windows never cross documents; null doc_ids come after all others; rows that are
equal in doc_id and text are one document, and each gets its result; rows of one doc_id with unlike texts are ordered by a
hash; texts of fewer words than a window stay; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Unit, merged, remove_repeats

WINDOW = 20
UNIT = Unit(window=WINDOW, gram=6, words=True)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text must end in a symbol that is unique and least."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while int(rank[order[-1]]) < n - 1:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[1:] = np.cumsum(pair[order][1:] != pair[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit; bits are packed and counts sampled every 64."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        now = symbols.astype(np.int64)
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            one = (now >> bit) & 1
            packed = np.packbits(one.astype(np.uint8), bitorder="little")
            words = np.zeros(len(now) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            zeros = len(now) - int(one.sum())
            self.levels.append((bit, words, counts, zeros))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before places low and high, counted from the symbol's first place in sorted order."""
        start = np.zeros(len(symbol), dtype=np.int64)
        for bit, words, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b, c = (counts[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))) for i in (low, high, start))
            low, high, start = (np.where(one, zeros + r, i - r) for i, r in ((low, a), (high, b), (start, c)))
        return low - start, high - start


class FMIndex:
    def __init__(self, text: np.ndarray, separators: int):
        """text: values below ``separators`` are separators, all distinct; the last is 0."""
        self.order = suffix_array(text)
        plain = np.maximum(text - separators + 1, 0)
        self.before = np.bincount(plain, minlength=int(plain.max()) + 2).cumsum() - np.bincount(plain, minlength=int(plain.max()) + 2)
        self.tree = WaveletTree(plain[self.order - 1], int(plain.max()))
        self.plain = plain

    def backward(self, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Search the ``length`` words before each end; intervals that hold more than one suffix, else empty ones."""
        low, high = np.zeros(len(end), dtype=np.int64), np.full(len(end), len(self.plain), dtype=np.int64)
        live = np.arange(len(end))
        for step in range(1, length + 1):
            c = self.plain[end[live] - step]
            a, b = self.tree.narrow(c, low[live], high[live])
            low[live], high[live] = self.before[c] + a, self.before[c] + b
            live = live[high[live] - low[live] > 1]
        out = np.zeros(len(end), dtype=bool)
        out[live] = True
        return np.where(out, low, -1), np.where(out, high, -1)


def find(stretches: list[bytes], lead: np.ndarray, n: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window whether an equal one comes earlier."""
    split = [s.split(b" ") for s in stretches]
    size = np.array([len(x) for x in split], dtype=np.int64)
    ids: dict[bytes, int] = {}
    m = len(split)
    text = np.zeros(int(size.sum()) + m, dtype=np.int64)
    word = np.fromiter((ids.setdefault(w, len(ids)) for x in split for w in x), dtype=np.int64, count=int(size.sum()))
    base = np.cumsum(size + 1) - (size + 1)
    text[np.arange(len(word)) + np.repeat(np.arange(m), size)] = word + m
    text[base + size] = np.arange(m)[::-1]
    index = FMIndex(text, m)
    which = np.repeat(np.arange(m), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    low, _ = index.backward(base[which] + j + WINDOW, WINDOW)
    when = order[which] + j
    out = np.zeros(len(which), dtype=bool)
    hit = np.flatnonzero(low >= 0)
    if len(hit):
        by = hit[np.argsort(low[hit], kind="stable")]
        new = np.append(True, low[by][1:] != low[by][:-1])
        first = np.minimum.reduceat(when[by], np.flatnonzero(new))
        out[by] = when[by] > first[np.cumsum(new) - 1]
    return out


def kept_words(text: bytes | None, runs) -> tuple[int, int, list[bytes]]:
    words = (text or b"").split()
    kept, last = [], 0
    gone = merged(runs, len(words), WINDOW)
    for a, b in gone:
        kept += words[last:a]
        last = b
    return len(words), sum(b - a for a, b in gone), kept + words[last:]


def finish(text: bytes | None, runs) -> tuple:
    n, removed, kept = kept_words(text, runs)
    return n, removed, hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document."""
    return remove_repeats(docs, UNIT, find, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the words that are left, joined by one space."""
    return remove_repeats(docs, UNIT, find, lambda text, runs: (None if text is None else b" ".join(kept_words(text, runs)[2]).decode(),), "doc_id long, text string")
