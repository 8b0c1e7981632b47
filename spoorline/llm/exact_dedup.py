"""Operator 1: exact dedup against a minimal perfect hash over historical digests.

The digests of documents seen before are dealt into shards by their first bytes. Each shard gets a minimal perfect hash:
level after level, digests that fall alone on a cell claim it, the rest move on, and the rank of a cell is the slot. Slots
hold the whole 32-byte digest and the locator of the winner (length, doc_id). A new batch is first grouped by digest, so
that a digest with very many copies is one row; each group looks its slot up, and a byte comparison tells repeats from
digests never seen, which form groups of their own.

Defined results: null text counts as empty; equal texts are equal after deleting white space; the longest original text
stays, then the smallest doc_id, null doc_ids last; repeated rows count in group_size and share keep_id; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, mix, whole_text

#: Digests a shard is meant to hold; with slots of 56 bytes, a shard takes a few MB.
SHARD_DIGESTS = 50_000
CELLS_PER_KEY = 1.5


def digest_of() -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and length in code points."""
    return docs.select("doc_id", digest_of().alias("digest"), F.char_length(whole_text()).cast("long").alias("length"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner's length and doc_id, and how many rows have it. Summed up before the shuffle."""
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies")).select(F.col("digest").alias("digest"), (-F.col("best.l")).alias("length"), F.col("best.i").alias("winner"), "copies")


def shard_of(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).alias("shard")


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct digests; digests not among them get -1 or some slot, so slots must be compared."""

    def __init__(self, keys: np.ndarray):
        """keys: n rows of 32 bytes."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(keys)), 0
        self.slot = np.full(len(keys), -1, dtype=np.int64)
        while len(left):
            size = max(1, int(len(left) * CELLS_PER_KEY))
            cell = self._cell(keys[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            hit = alone[cell]
            self.slot[left[hit]] = rank[cell[hit]]
            base, left = base + int(alone.sum()), left[~hit]

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        parts = np.ascontiguousarray(keys).view(np.uint64).reshape(len(keys), 4)
        with np.errstate(over="ignore"):
            h = mix(parts[:, 1] + np.uint64(level + 1) * mix(parts[:, 2] | np.uint64(1)))
        return (h % np.uint64(size)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            cell = self._cell(keys[left], level, size)
            hit = alone[cell]
            out[left[hit]], left = rank[cell[hit]], left[~hit]
        return out


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint8).reshape(len(column), 32)


def _merge(history: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """One shard: build the slots of its historical digests, look the batch's groups up, return all winners."""
    if not len(history):  # an absent side comes without columns
        history = batch.iloc[:0]
    elif not len(batch):
        batch = history.iloc[:0]
    old = _bytes(history["digest"])
    mphf = MinimalPerfectHash(old)
    place = np.empty(len(old), dtype=np.int64)
    place[mphf.slot] = np.arange(len(old))
    slots = old[place]  # slot -> digest
    history = history.iloc[place].reset_index(drop=True)
    new = _bytes(batch["digest"])
    slot = mphf.look_up(new)
    member = slot >= 0
    member[member] = (slots[slot[member]] == new[member]).all(axis=1)
    rest = batch[~member]
    found = batch[member].set_axis(slot[member])
    length, winner = history["length"].to_numpy(dtype=np.int64, copy=True), history["winner"].astype("Int64")
    theirs, ids = found["length"], found["winner"].astype("Int64")
    mine = winner.reindex(found.index)
    better = (theirs.to_numpy() > length[found.index]) | ((theirs.to_numpy() == length[found.index]) & ((ids < mine) | (mine.isna() & ids.notna())).fillna(False).to_numpy(dtype=bool))
    out = history.assign(winner=winner)
    out.loc[found.index[better], "winner"] = ids[better]
    out.loc[found.index[better], "length"] = theirs[better]
    out.loc[found.index, "copies"] += found["copies"]
    return pd.concat([out, rest.assign(winner=rest["winner"].astype("Int64"))]).rename(columns={"length": "best"})[["digest", "best", "winner", "copies"]]


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs and of history.

    history: rows taken in before (same columns). Without it, the lower half of the range of doc_ids counts as taken in
    before, so that one table alone also goes through the index; the result is the same for every split.
    """
    rows = digests(docs).withColumn("old", F.lit(False))
    if history is not None:
        rows = rows.unionByName(digests(history).withColumn("old", F.lit(True)))
    rows = checkpoint(rows)  # 60 bytes a document: the texts are read and hashed once
    if history is None:
        lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        rows = rows.withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False)))
    else:
        n = rows.count()
    shards = max(1, -(-n // SHARD_DIGESTS))
    index, batch = (winners(rows.where(F.col("old") == was)).withColumn("shard", shard_of(shards)) for was in (True, False))
    best = index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(_merge, "digest binary, best long, winner long, copies long")
    out = rows.join(best, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("length") == F.col("best"))
    return out.select("doc_id", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "length")


def exact_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated in full, one stays."""
    digest, doc, length, nth = fresh(docs, "digest", "doc", "length", "nth")
    stay = exact_dedup(docs).where("kept").select(F.unhex("text_sha256").alias(digest), F.col("doc_id").alias(doc), F.col("length").alias(length)).distinct()
    rows = docs.withColumns({digest: digest_of(), doc: F.col("doc_id"), length: F.char_length(whole_text()).cast("long")})
    # Null doc_ids are alike; ties between rows of one doc_id and length go to the least text.
    same = (F.col(f"r.{digest}") == F.col(f"s.{digest}")) & F.col(f"r.{doc}").eqNullSafe(F.col(f"s.{doc}")) & (F.col(f"r.{length}") == F.col(f"s.{length}"))
    rows = rows.alias("r").join(stay.alias("s"), same, "left_semi")
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(digest).orderBy(F.xxhash64("text")))).where(F.col(nth) == 1).drop(digest, doc, length, nth)
