"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of spark.checkpoint.dir; a folder of our own only on one machine, where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spoorline-"))
    return df.checkpoint()


#: Rows of a few numbers each that one task reads.
ROWS_A_TASK = 100_000


def compact(df: DataFrame) -> DataFrame:
    """df, computed once like checkpoint(), then read by as many tasks as its rows need: small tables do not shuffle from many near-empty tasks. For rows of a few numbers."""
    kept = checkpoint(df)
    return kept.coalesce(max(8, -(-kept.count() // ROWS_A_TASK)))


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = 100_000) -> DataFrame:
    """Join; the right side is broadcast only when a count shows at most ``limit`` rows, else Spark shuffles both."""
    return left.join(F.broadcast(right) if right.limit(limit + 1).count() <= limit else right, on, how)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on all others (a multiply-shift mixer)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n, kept between calls of one worker."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.full(size, pow(BASE, -1, 1 << 64) if inverse else BASE, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[inverse] = np.multiply.accumulate(out)
    return have[:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[j] - s[i] = sum of symbols[t] * BASE**t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * powers(len(symbols)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbol ranges that depend on their content only."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow binary column end to end, and each row's start (one more entry for the end)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in bytes, and each row's first word (one more entry for the end)."""
    inside = ~_IS_SPACE[raw]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


#: Places of a word that have random numbers of their own; places beyond are mixed with how often they were gone round.
_PLACES = 64
_table: list[np.ndarray] = []


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: a sum of random numbers, one for each byte at each place."""
    if not _table:
        _table.append(np.random.default_rng(61).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64))
    begun = np.zeros(len(raw), dtype=np.int64)
    begun[start] = start
    place = np.arange(len(raw)) - np.maximum.accumulate(begun)
    value = _table[0][(place & (_PLACES - 1)) << 8 | raw]
    with np.errstate(over="ignore"):
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(mix(value[far] + (place[far] // _PLACES).astype(np.uint64) * np.uint64(BASE)))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        return mix(total[end] - total[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that df has already."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
