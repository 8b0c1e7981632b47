"""What operators 4 and 5 share: which windows of a corpus also start earlier.

A window is ``window`` consecutive symbols (bytes or words) of one document. Each window is owned by one anchor: the
``gram`` symbols in it whose hash is least, leftmost first. Equal windows have equal anchors at equal places, so

1. whole texts that repeat are set aside by digest (their first row stays);
2. documents are dealt into blocks by a hash of the row, and every block says which anchors it has and how often; anchors
   that occur once in the corpus cannot own a repeated window. A very common anchor is one row a block;
3. each block cuts out, for every repeated anchor, the stretch of text whose windows it owns; stretches equal within the
   block are one. Windows of very common anchors travel alone, keyed by their own content, so that no key gathers
   unlike windows of many documents;
4. shards of stretches find equal windows exactly (a suffix sort or an FM-index, given by the operator), and all but
   the first of each class are repeats;
5. the blocks apply the runs to their texts.

Texts are shuffled once; steps 2, 3 and 5 read the same exchange. Hashes only route: equality is that of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, flat, mix, prefix_hashes, range_hashes, word_bounds, word_hashes

#: Bytes of text a block and a shard are meant to hold, and symbols that are hashed at once (one document at least).
BLOCK_BYTES, CHUNK = 3 << 20, 1 << 20
#: Anchors that occur more often are very common.
HOT = 3000
STRETCH = "shard long, kind int, key long, lead long, doc_id long, row_key long, block long, start long, n long, stretch binary"
LAST = np.iinfo(np.int64).max
#: (stretches, lead, n, key, order of each stretch's first window) -> boolean per window, true where an earlier one is equal
Finder = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Unit:
    window: int
    gram: int
    words: bool

    def symbols(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols as 64-bit numbers, each row's first symbol, and start and end of each symbol in bytes."""
        if self.words:
            start, end, first = word_bounds(raw, at)
            return word_hashes(raw, start, end), first, start, end
        return mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), at, np.arange(len(raw)), np.arange(1, len(raw) + 1)


def anchors(unit: Unit, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor that owns windows: its key, its place, and the first and last start of its windows."""
    n, w = len(sym), unit.window - unit.gram + 1
    length = np.diff(first)
    fits = length >= unit.window
    if not fits.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    prefix = prefix_hashes(sym)
    i = np.arange(n - unit.gram + 1)
    g = mix(range_hashes(prefix, i, i + unit.gram))
    low = np.uint64((1 << 30) - 1)
    least, have = (g & ~low) | i.astype(np.uint64), 1
    while have * 2 <= w:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < w:
        least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, first[:-1][fits], 1)
    np.add.at(edge, (first[1:] - unit.window + 1)[fits], -1)
    s = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    p = (least[s] & low).astype(np.int64)
    new = np.ones(len(s), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return g[p[at]].view(np.int64), p[at], s[at], s[np.append(at[1:], len(s)) - 1]


def _chunks(table: pa.Table) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """doc_ids (null: LAST), row keys, bytes and bounds of a block's rows in order, some 1 MB at a time; rows repeated in full come once."""
    ids = [LAST if x is None else x for x in table["doc_id"].to_pylist()]
    keys = table["row_key"].to_pylist()
    order = sorted({(d, k): i for i, (d, k) in enumerate(zip(ids, keys, strict=True))}.items())
    sizes = pc.binary_length(table["text"]).fill_null(0).to_pylist()
    part, size = [], 0
    for _, i in order:
        part.append(i)
        size += sizes[i]
        if size >= CHUNK:
            yield _taken(table, part, ids, keys)
            part, size = [], 0
    if part:
        yield _taken(table, part, ids, keys)


def _taken(table: pa.Table, part: list[int], ids: list[int], keys: list[int]):
    return [ids[i] for i in part], [keys[i] for i in part], *flat(table["text"].take(pa.array(part, pa.int64())))


def _without_copies(table: pa.Table, copies: list[int]) -> pa.Table:
    return table.filter(pc.invert(pc.is_in(table["row_key"], pa.array(copies, pa.int64())))) if copies else table


def _say_anchors(unit: Unit, block: pa.Table, copies: pa.Table) -> pa.Table:
    found = []
    for _, _, raw, at in _chunks(_without_copies(block, copies["value"].to_pylist())):
        sym, first, _, _ = unit.symbols(raw, at)
        found.append(anchors(unit, sym, first)[0])
    key, n = np.unique(np.concatenate([*found, np.zeros(0, dtype=np.int64)]), return_counts=True)
    number = block["block"][0].as_py() if block.num_rows else 0
    return pa.table({"key": key, "block": np.full(len(key), number, dtype=np.int64), "n": n.astype(np.int64)})


def _cut(unit: Unit, shards: int, block: pa.Table, notes: pa.Table) -> pa.Table:
    kind, value = (notes[c].to_numpy() for c in ("kind", "value"))
    wanted, hot = np.sort(value[kind > 0]), set(value[kind == 2].tolist())
    out: dict[str, list] = {c.split()[0]: [] for c in STRETCH.split(", ")}
    seen: set = set()

    def put(key: int, lead: int, doc: int, row: int, start: int, n: int, stretch: bytes) -> None:
        what = (key, lead, n, stretch)
        again = what in seen
        seen.add(what)
        # What repeats within its block only passes through, so the block deals it, not a key that others share.
        for c, x in zip(out, ((number if again else key) % shards, int(again), key, lead, doc, row, number, start, n, None if again else stretch), strict=True):
            out[c].append(x)

    number = block["block"][0].as_py() if block.num_rows else 0
    for ids, rows, raw, at in _chunks(_without_copies(block, value[kind == 0].tolist())) if len(wanted) else ():
        sym, first, begin, end = unit.symbols(raw, at)
        key, place, lo, hi = anchors(unit, sym, first)
        where = np.searchsorted(wanted, key).clip(max=len(wanted) - 1)
        take = np.flatnonzero(wanted[where] == key)
        doc = np.searchsorted(first, lo[take], side="right") - 1
        whole = raw.tobytes()
        for k, p, a, b, d in zip(key[take].tolist(), place[take].tolist(), lo[take].tolist(), hi[take].tolist(), doc.tolist(), strict=True):
            base = int(first[d])
            for x, y in ((s, s) for s in range(a, b + 1)) if k in hot else ((a, b),):
                text = whole[begin[x] : end[y + unit.window - 1]]
                if unit.words:
                    text = b" ".join(text.split())
                # A window that travels alone is keyed by its own content.
                put(hash_of(text) if k in hot else k, p - x, ids[d], rows[d], x - base, y - x + 1, text)
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.binary()), strict=True)], names=list(out))


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


RUNS = "block long, row_key long, start long, stop long"


def _match(unit: Unit, finder: Finder, rows: pa.Table) -> pa.Table:
    """One shard: runs of repeated windows. Rows of kind 1 repeat a stretch of their own block and pass through."""
    kind, key, lead, doc, row, block, start, n = (rows[c].to_numpy() for c in ("kind", "key", "lead", "doc_id", "row_key", "block", "start", "n"))
    runs = [(block[kind == 1], row[kind == 1], start[kind == 1], (start + n)[kind == 1])]
    order = np.lexsort((start, row, doc))
    order = order[kind[order] == 0]
    text = rows["stretch"].to_pylist()
    first: dict = {}
    again = np.array([i for i in order.tolist() if first.setdefault((key[i], lead[i], n[i], text[i]), i) != i], dtype=np.int64)
    runs.append((block[again], row[again], start[again], (start + n)[again]))
    mine = np.array(list(first.values()), dtype=np.int64)
    if len(mine):
        _, back, count = np.unique(key[mine], return_inverse=True, return_counts=True)
        mine = mine[count[back] > 1]
    if len(mine):
        owner = np.zeros(len(mine), dtype=np.int64)
        owner[1:] = np.cumsum((doc[mine][1:] != doc[mine][:-1]) | (row[mine][1:] != row[mine][:-1]))  # mine is in order
        repeated = finder([text[i] for i in mine], lead[mine], n[mine], key[mine], (owner << 32) | start[mine])
        which = np.repeat(np.arange(len(mine)), n[mine])
        at = np.arange(len(which)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine]) + start[mine][which]
        hit = np.flatnonzero(repeated)
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit][1:] != which[hit][:-1])
            a = hit[new]
            b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            runs.append((block[mine][which[a]], row[mine][which[a]], at[a], at[b] + 1))
    b, r, s, e = (np.concatenate(x) for x in zip(*runs, strict=True))
    return pa.table({"block": b, "row_key": r, "start": s, "stop": e + unit.window - 1})


def _apply(unit: Unit, finish, names: list[str], block: pa.Table, notes: pa.Table) -> pa.Table:
    """finish(raw, at, removed mask over symbols or None, first, begin, end, row) -> the columns of one document."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(*(notes[c].to_pylist() for c in ("row_key", "start", "stop")), strict=True):
        runs.setdefault(r, []).append((a, b))
    out = []
    for doc, row, text in zip(block["doc_id"].to_pylist(), block["row_key"].to_pylist(), block["text"].to_pylist(), strict=True):
        out.append((doc, *finish(text, runs.get(row, ()))))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
    types = {"doc_id": pa.int64(), "text": pa.string()}
    return pa.table([pa.array(c, pa.string() if k.endswith("sha256") else types.get(k, pa.int64())) for k, c in zip(names, columns, strict=True)], names=names)


def merged(runs, size: int, window: int) -> list[tuple[int, int]]:
    """Disjoint runs in order; a run from -1 covers all of a text that has a window."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if a < 0 and size < window:
            continue
        a, b = (0, size) if a < 0 else (a, min(b, size))
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, unit: Unit, finder: Finder, finish, schema: str) -> DataFrame:
    """docs (doc_id, text) with what ``finish`` makes of each text and its runs of repeated symbols."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    heads = checkpoint(rows.select("doc_id", "row_key", F.sha2("text", 256).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")))
    total = heads.agg(F.sum("size")).first()[0] or 0
    blocks = max(8, -(-total // BLOCK_BYTES))
    block = F.pmod("row_key", F.lit(blocks)).alias("block")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    once = heads.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    # Rows that repeat an earlier row's whole text: all their windows are repeats.
    copies = heads.join(once, "digest").where((place != F.col("first")) & (F.col("size") >= unit.window)).select(block, "row_key").distinct()
    copies = checkpoint(copies)
    notes = copies.select("block", F.lit(0).alias("kind"), F.col("row_key").alias("value"))

    texts = rows.select(block, "doc_id", "row_key", "text")
    grouped = lambda: texts.groupBy("block")  # noqa: E731  the same exchange each time
    say = lambda left, right: _say_anchors(unit, left, right)
    said = grouped().cogroup(notes.groupBy("block")).applyInArrow(say, "key long, block long, n long")
    many = said.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1")
    found = many.select("block", F.when(F.col("total") > HOT, 2).otherwise(1).alias("kind"), F.col("key").alias("value"))
    cut = grouped().cogroup(notes.unionByName(found).groupBy("block")).applyInArrow(lambda left, right: _cut(unit, blocks, left, right), STRETCH)
    runs = cut.groupBy("shard").applyInArrow(lambda t: _match(unit, finder, t), RUNS)
    runs = runs.unionByName(copies.select("block", "row_key", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop")))
    names = [x.split()[0] for x in schema.split(", ")]
    return grouped().cogroup(runs.groupBy("block")).applyInArrow(lambda left, right: _apply(unit, finish, names, left, right), schema)
