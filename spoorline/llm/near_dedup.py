"""Operator 7: near-duplicate documents by b-bit MinHash.

Each document's set of shingles gives 128 minima. A few of them make a band key, and documents that share a key are candidates.
The threshold decides how many: the most with which one pair in 20,000 at most shares none at the threshold itself. That is
21 bands of six at 0.85 (one pair in 20,800) and 25 of five at 0.8 (one in 22,000). Of every minimum the two lowest bits are kept, packed
into four numbers; the share of equal ones, corrected for chance agreement, estimates a pair's similarity by counting bits.
Pairs within four standard errors of the threshold, at that threshold, or above are confirmed on the full sets of words.

Documents with equal sets are one class, so copies cost nothing. Every class is first held against one other alone; links
join into components. In buckets that then still have several, classes are held against the bucket's least and greatest,
and against the one with most such buckets, and at last candidates that are still in different components against each
other. What a set has in common with all other components together bounds what it can have with one of them, exactly, and
classes and pairs that cannot reach the threshold drop out before full sets are read. For pairs there is a second exact bound: each set
sets the parity of ODD bits by its shingles, and two sets differ in as many shingles at least as in bits. No pair that could change a
component goes untested. A large group of near copies is not paired out; nor is one of loose copies, alike but below the threshold,
unless they differ in so many shingles (several thousand) that their bits run full.

Texts are shuffled once, to set those apart that share a bucket with others; all later steps read that smaller table. To be
confirmed, each text goes to one block, and to each block that has others to be held against it; pairs move as pairs of
names. Classes are named by 128-bit digests of their sets, rows told apart by doc_id and a 64-bit hash of the text together. What is summed up per bucket is
joined back to its members, small rows without texts; those of one bucket meet in one task.

Defined results: texts without words (null, empty) have no shingles, are linked with nothing and stay; a text of one or
two words has one shingle; components are named by their smallest doc_id, null doc_ids last; repeated rows are equal sets;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, compact, flat, fresh, mix, prefix_hashes, range_hashes, word_bounds, word_hashes
from .graph import components

MINIMA, BITS, SEED = 128, 2, 7
#: Most pairs at the threshold that may share no band.
MISSED = 1 / 20_000
#: Chance that two unlike minima agree in their low bits.
CHANCE = 1 / (1 << BITS)
#: Standard errors of the estimate at the threshold that a candidate may lie below it.
ERRORS = 4
#: Bytes of text that are worked on at once; their words, shingles and minima take some 40 times that.
CHUNK = 1 << 18
#: Bits of a set whose parities are kept.
ODD = 1 << 12
#: Bytes of text in a block of classes that are held against others.
BLOCK_BYTES = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def band_rows(percent: int) -> int:
    """Minima in a band key: the most that miss no more than MISSED of the pairs at the threshold, one at least."""
    return next((r for r in range(MINIMA, 1, -1) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISSED), 1)


def margin(percent: int) -> float:
    """ERRORS standard errors of estimate() at the threshold, rounded up to hundredths."""
    agree = CHANCE + (1 - CHANCE) * percent / 100
    return math.ceil(100 * ERRORS * math.sqrt(agree * (1 - agree) / MINIMA) / (1 - CHANCE)) / 100


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and bounds of runs of rows with some CHUNK bytes, one row at least."""
    raw, at = flat(texts)
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, side="right")) - 1)
        yield a, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's shingles of ``size`` words, A-Z in lower case."""
    raw = _LOWER[raw]
    start, end, first = word_bounds(raw, at)
    prefix = prefix_hashes(word_hashes(raw, start, end))
    i = np.arange(max(0, len(start) - size + 1))
    all_of = mix(range_hashes(prefix, i, i + size))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_of[a : b - size + 1]))
        elif b > a:  # a short text is one shingle; its length keeps it apart
            out.append(mix(range_hashes(prefix, np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _factors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, MINIMA, dtype=np.uint32), r.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each set that is not empty, as rows."""
    flips, factors = _factors()
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), MINIMA), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(MINIMA):
            out[:, k] = np.minimum.reduceat((x ^ flips[k]) * factors[k], begins)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of each row's minima in MINIMA * BITS / 64 numbers."""
    low = (minima & ((1 << BITS) - 1)).astype(np.uint64)
    lanes = 64 // BITS
    shift = np.arange(lanes, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(low), -1, lanes) << shift, axis=2).view(np.int64)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    bands = MINIMA // rows
    out = np.zeros((len(minima), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + minima[:, j : bands * rows : rows].astype(np.uint64) + np.uint64(1))
        return mix(out + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _signed(size: int, width: int, batches) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row_key", "n_shingles", "cls", "sig", "bands"]
    for batch in batches:
        for a, raw, at in slices(batch["text"]):
            sets = shingle_sets(raw, at, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            cls, sig, bands = ([None] * len(sets) for _ in range(3))
            if full:
                minima = signatures([sets[i] for i in full])
                for i, s, b in zip(full, packed(minima).tolist(), band_keys(minima, width).tolist(), strict=True):
                    cls[i], sig[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s, b
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, len(sets)), batch["row_key"].slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, longs), pa.array(bands, longs)], names=names
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), F.col("text").cast("binary").alias("text"))


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    lanes = int("01" * (64 // BITS), 2)
    unlike = []
    for i in range(MINIMA * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unlike.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lanes))))
    return (1 - reduce(lambda p, q: p + q, unlike) / F.lit(float(MINIMA)) - CHANCE) / (1 - CHANCE)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and one text of each wanted class (cls, first; distinct). Keys are never broadcast, so that the plan is the same at every size."""
    keys = wanted.select("cls", F.col("first.i").alias("i"), F.col("first.k").alias("k")).hint("shuffle_hash")
    return _rows(docs).join(keys, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("cls", "text").dropDuplicates(["cls"])


def enough_in_common(a: bytes, b: bytes, percent: int, size: int) -> bool:
    """Whether two texts' sets of shingles are similar enough, by their words."""
    first, second = a.lower().split(), b.lower().split()  # bytes: A-Z, and the contract's white space
    if min(len(first), len(second)) < size:
        return first == second
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in (*first, *second)), dtype=np.int64, count=len(first) + len(second))
    code = word
    for k in range(1, size):
        code = np.unique(code[: len(word) - k] * len(ids) + word[k:], return_inverse=True)[1]
    p, q = np.unique(code[: len(first) - size + 1]), np.unique(code[len(first) :])
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def shared_counts(texts: DataFrame, among: DataFrame, size: int) -> DataFrame:
    """cls, n and shared (of its n shingles, those that some class of another component has too) for among: cls, comp.

    No class of another component has more in common with it.
    """

    def rows(batches):
        for batch in batches:
            for a, raw, at in slices(batch["text"]):
                found = shingle_sets(raw, at, size)
                n = pa.array([len(s) for s in found], pa.int64())
                of = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]))
                yield pa.RecordBatch.from_arrays([batch["cls"].slice(a, len(found)).take(of), batch["comp"].slice(a, len(found)).take(of), n.take(of), pa.array(np.concatenate(found).view(np.int64))], names=["cls", "comp", "n", "shingle"])

    each = texts.join(among, "cls").select("cls", "comp", "text").mapInArrow(rows, "cls binary, comp binary, n long, shingle long")
    common = each.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("shingle")
    return each.select("cls", "n", "shingle").join(common, "shingle").groupBy("cls", "n").agg(F.count("*").alias("shared"))


def odd_bits(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set, in ODD / 64 numbers, which bits an odd number of its shingles falls on. A shingle that one of two sets lacks changes one bit."""
    each = (np.bincount((s & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD).astype(np.uint8) & 1 for s in sets)
    return [np.packbits(x).view(np.int64) for x in each]


def with_odd_bits(texts: DataFrame, among: DataFrame, size: int) -> DataFrame:
    """cls and odd of the classes among (cls)."""

    def rows(batches):
        for batch in batches:
            for a, raw, at in slices(batch["text"]):
                odd = odd_bits(shingle_sets(raw, at, size))
                yield pa.RecordBatch.from_arrays([batch["cls"].slice(a, len(odd)), pa.array(odd, pa.list_(pa.int64()))], names=["cls", "odd"])

    return texts.join(among.select("cls"), "cls", "left_semi").mapInArrow(rows, "cls binary, odd array<long>")


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """leaf and hub: pairs of different components in a bucket that no bound rules out, once each.

    rows: band, cls, comp, n, shared, sig, bands (all of the class's) and odd.
    """
    sided = lambda side: rows.select(*(F.col(c).alias(c + side) for c in ("band", "cls", "comp", "n", "shared", "sig", "bands", "odd")))
    total = F.col("nx") + F.col("ny")
    in_common = (100 + percent) * F.least("sharedx", "sharedy") >= percent * total
    differing = F.aggregate(F.zip_with("oddx", "oddy", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = (estimate("sigx", "sigy") >= percent / 100 - margin(percent)) & ((100 + percent) * differing <= (100 - percent) * total)
    # Two classes meet once, in the least of the buckets that they share.
    once = F.array_min(F.array_intersect("bandsx", "bandsy")) == F.col("bandx")
    met = sided("x").join(sided("y"), F.col("bandx") == F.col("bandy")).where((F.col("clsx") < F.col("clsy")) & (F.col("compx") != F.col("compy")) & in_common & alike & once)
    return met.select(F.col("clsx").alias("leaf"), F.col("clsy").alias("hub"))


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (leaf, hub of classes) whose full sets are similar enough, as u and v. texts: cls, text.

    Leaves are dealt into blocks of some BLOCK_BYTES of text, each leaf's text to its own block alone, however many hubs it
    is held against; a hub's text goes once to each block that has leaves of it.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(8, -(-total // BLOCK_BYTES)))).alias("block")
    asked = pairs.select(block("leaf"), "leaf", "hub")
    hubs = asked.select("block", "hub").distinct().join(texts, F.col("hub") == F.col("cls")).select("block", F.lit(None).cast("binary").alias("leaf"), "hub", F.col("text").alias("words"))
    asked = asked.select("block", "leaf", "hub", F.lit(None).cast("binary").alias("words"))
    leaves = texts.select(block("cls"), "cls", "text")

    def similar(own: pa.Table, said: pa.Table) -> pa.Table:
        found = []
        if len(said):
            asks = pc.is_valid(said["leaf"])
            hub = dict(zip(*(said.filter(pc.invert(asks))[c].to_pylist() for c in ("hub", "words")), strict=True))
            wanted = said.filter(asks)
            own = own.filter(pc.is_in(own["cls"], pc.unique(wanted["leaf"])))
            leaf = dict(zip(own["cls"].to_pylist(), own["text"].to_pylist(), strict=True))
            found = [(u, v) for u, v in zip(wanted["leaf"].to_pylist(), wanted["hub"].to_pylist(), strict=True) if enough_in_common(leaf[u], hub[v], percent, size)]
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    return leaves.groupBy("block").cogroup(hubs.unionByName(asked).groupBy("block")).applyInArrow(similar, "u binary, v binary")


def near_groups(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """doc_id, row_key, n_shingles, first (place of the component's first document) and place for every row of docs."""
    least, width = percent / 100 - margin(percent), band_rows(percent)
    signed = checkpoint(_rows(docs).mapInArrow(lambda b: _signed(size, width, b), "doc_id long, row_key long, n_shingles long, cls binary, sig array<long>, bands array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    classes = compact(signed.where("cls is not null").groupBy("cls").agg(F.min(place).alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    sigs = classes.select("cls", "sig")
    banded = classes.select("cls", F.explode("bands").alias("band"))

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sigs.select(F.col("cls").alias("leaf"), F.col("sig").alias("su")), "leaf").join(sigs.select(F.col("cls").alias("hub"), F.col("sig").alias("sv")), "hub")
        return p.where(estimate("su", "sv") >= least).select("leaf", "hub")

    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs that were not held against each other before, either way round."""
        ends = lambda df: df.withColumn("x", F.least("leaf", "hub")).withColumn("y", F.greatest("leaf", "hub"))
        return ends(pairs).join(ends(tested).select("x", "y").distinct(), ["x", "y"], "left_anti").groupBy("x", "y").agg(F.max("leaf").alias("leaf"), F.max("hub").alias("hub")).select("leaf", "hub")

    buckets = banded.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    shared = compact(banded.join(buckets, "band"))
    texts = checkpoint(_texts_of(docs, classes.join(shared.select("cls").distinct(), "cls", "left_semi")))
    # First every class against one other alone, the least of all its buckets: most groups are one component then.
    tested = compact(likely(shared.groupBy(F.col("cls").alias("leaf")).agg(F.min("low").alias("hub")).where("leaf <> hub")))
    comps = compact(components(confirmed(texts, tested, percent, size)))
    # What is known of the components stands for the links they came from.
    known = lambda: comps.select(F.col("node").alias("u"), F.col("component").alias("v"))

    def still_apart(members: DataFrame) -> DataFrame:
        """Members (band, cls, ...) of the buckets whose classes are not yet one component, with comp."""
        named = members.join(comps, F.col("cls") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        open_ = named.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band")
        return named.join(open_, "band")

    def further(pairs: DataFrame) -> None:
        """Hold candidates against each other that were not yet, and join what they link."""
        nonlocal comps, tested
        new = compact(untested(pairs, tested))
        tested = tested.unionByName(new)
        new = compact(likely(new))
        if not new.isEmpty():
            comps = compact(components(known().unionByName(confirmed(texts, new, percent, size))))

    # Then, in buckets of several components, against the bucket's least and greatest class.
    rows = compact(still_apart(shared.select("band", "cls")))
    ends = rows.groupBy("band").agg(F.min(F.struct("cls", "comp")).alias("a"), F.max(F.struct("cls", "comp")).alias("b"))
    further(rows.join(ends, "band").select("cls", "comp", F.explode(F.array("a", "b")).alias("m")).where("comp <> m.comp").select(F.col("cls").alias("leaf"), F.col("m.cls").alias("hub")).distinct())
    # Once more against one class a bucket, the one with most open buckets, which in a group of copies is near its source.
    rows = compact(still_apart(rows.select("band", "cls")))
    wide = rows.join(rows.groupBy("cls").agg(F.count("*").alias("reach")), "cls")
    middle = wide.groupBy("band").agg(F.max_by(F.struct("cls", "comp"), F.struct("reach", "cls")).alias("m"))
    further(rows.join(middle, "band").where("comp <> m.comp").select(F.col("cls").alias("leaf"), F.col("m.cls").alias("hub")).distinct())
    rows = compact(still_apart(rows.select("band", "cls")))
    # What a class has in common with all other components together bounds, exactly, what it has with any class of them.
    able = shared_counts(texts, compact(rows.select("cls", "comp").distinct()), size).where(100 * F.col("shared") >= percent * F.col("n"))
    lists = rows.groupBy("cls").agg(F.collect_set("band").alias("bands"))  # at most one a band of the signature
    able = compact(able)
    rows = rows.join(able, "cls").join(sigs, "cls").join(lists, "cls").join(with_odd_bits(texts, able, size), "cls")
    further(candidates(compact(rows), percent))
    heads = classes.join(comps, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp"), "first")
    least_of = heads.groupBy("comp").agg(F.min("first").alias("first"))
    of_class = heads.select("cls", "comp").join(least_of, "comp").select("cls", "first")
    return signed.join(of_class, "cls", "left").select("doc_id", "row_key", "n_shingles", F.coalesce("first", place).alias("first"), place.alias("place"))


def near_dedup(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    return near_groups(docs, percent, size).select("doc_id", "n_shingles", F.col("first.i").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("first.i")).alias("kept"))


def near_filter(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs that stay: one document of each group, with all its columns; rows without words stay."""
    key, doc, nth, stays = fresh(docs, "row_key", "doc", "nth", "stays")
    stay = near_groups(docs, percent, size).where(F.col("place") == F.col("first")).select(F.col("row_key").alias(key), F.col("doc_id").alias(doc)).distinct()
    # A row is told from others by its doc_id and the hash of its text together.
    rows = docs.withColumn(key, F.xxhash64("text"))
    rows = rows.join(stay.withColumnRenamed(key, stays), (F.col(key) == F.col(stays)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(key))).where(F.col(nth) == 1).drop(nth, key)
