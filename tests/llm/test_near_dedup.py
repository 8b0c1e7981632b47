"""Operator 7 against all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spoorline.llm import near_dedup as nd
from spoorline.llm.graph import components


def sets_of(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, percent, size):
    sets = [sets_of(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(root(i), []).append((d is None, d))
    return [(d, len(s), min(least[root(i)])[1], d == min(least[root(i)])[1]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 8))) for _ in range(400)]
    docs = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "two one")]
    for g in range(30):
        base = [r.choice(words) for _ in range(r.choice([10, 40, 150, 400]))]
        for _ in range(r.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((len(docs), " ".join(w)))
        if g % 3 == 0:  # a chain: each link holds, the ends do not
            for _ in range(6):
                w = list(w)
                for _ in range(max(1, len(w) // 60)):
                    w[r.randrange(len(w))] = r.choice(words)
                docs.append((len(docs), " ".join(w)))
    r.shuffle(docs)
    return [*docs, (None, docs[0][1]), docs[1]]


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_against_all_pairs(spark, percent, size):
    docs = corpus()
    got = nd.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), percent, size).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, percent, size), key=str)


def test_estimate():
    r = np.random.default_rng(0)
    for share in (0.3, 0.85):
        both = r.integers(0, 2**63, int(3000 * share), dtype=np.uint64)
        one, two = (r.integers(0, 2**63, (3000 - len(both)) // 2, dtype=np.uint64) for _ in range(2))
        a, b = nd.signatures([np.concatenate([both, one]), np.concatenate([both, two])])
        low = ((a & 3) == (b & 3)).mean()
        assert abs((low - 0.25) / 0.75 - share) < 0.15
        p, q = nd.packed(np.stack([a, b]))
        unlike = sum(bin(((x | (x >> 1)) & int("01" * 32, 2))).count("1") for x in ((int(u) ^ int(v)) & (2**64 - 1) for u, v in zip(p, q, strict=True)))
        assert abs(1 - unlike / 128 - low) < 1e-9


def test_empty_and_components(spark):
    assert nd.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60)]
    got = components(spark.createDataFrame(links, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(21)] + [(40, 40), (50, 40), (60, 40)]


def test_layout_follows_the_threshold():
    """Pairs just at the pipeline's 0.8 share a band, and their estimate lies within the margin."""
    assert [nd.band_rows(p) for p in (85, 80)] == [6, 5]
    for percent in (50, 70, 80, 85, 90):
        rows = nd.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (nd.MINIMA // rows) <= nd.MISSED
        agree = 0.25 + 0.75 * percent / 100
        assert nd.margin(percent) >= 4 * (agree * (1 - agree) / nd.MINIMA) ** 0.5 / 0.75


def test_few_pairs_at_the_threshold_share_no_band():
    """21 bands of six lose about one pair in 600 at 0.8; of 6,000 some ten."""
    r = np.random.default_rng(2)
    a, b = [], []
    for _ in range(6000):
        both = r.integers(0, 2**63, 80, dtype=np.uint64)
        one, two = (r.integers(0, 2**63, 10, dtype=np.uint64) for _ in range(2))
        a.append(np.concatenate([both, one]))
        b.append(np.concatenate([both, two]))
    width = nd.band_rows(80)
    assert (nd.band_keys(nd.signatures(a), width) != nd.band_keys(nd.signatures(b), width)).all(axis=1).sum() <= 3


def thue_morse(n, a, b):
    s = a
    for _ in range(n):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_long_words_that_polynomials_confuse(spark):
    """Words of 1,024 letters with equal polynomial hashes modulo 2**64, whatever the base."""
    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    got = nd.near_dedup(spark.createDataFrame([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one} x  y")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_confirmed_on_words():
    r = random.Random(8)
    for _ in range(300):
        a = [r.choice("abcdefgh") for _ in range(r.randint(1, 30))]
        b = list(a)
        for _ in range(r.randint(0, 2)):
            b[r.randrange(len(b))] = r.choice("ABCXYZ")
        for percent, size in ((85, 3), (50, 5)):
            x, y = sets_of(" ".join(a), size), sets_of("\n".join(b), size)
            assert nd.enough_in_common(" ".join(a).encode(), "\n".join(b).encode(), percent, size) == (100 * len(x & y) >= percent * len(x | y))


def test_filter_keeps_clashing_columns(spark):
    docs = [(1, "a b c d e f g", 5, 6, 7), (2, "a b c d e f g", 5, 6, 8), (3, None, 1, 1, 1), (3, None, 1, 1, 1), (4, "w " * 30_000, 0, 0, 0), (5, "w " * 30_000 + "v", 0, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row_key long, nth long, cls long")
    got = nd.near_filter(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [docs[0], docs[2], docs[4], docs[5]]


def test_a_crowd_of_loose_copies_is_not_paired_out(spark, monkeypatch):
    """150 copies of one text, each with words of its own at five places: alike at some 0.75, so that estimates tell few pairs from 0.85."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for d in range(150):
        w = list(base)
        for i in r.sample(range(200), 5):
            w[i] = f"d{d}x{i}"
        docs.append((d, " ".join(w)))
    docs += [(200, docs[7][1] + " end"), (201, docs[9][1] + " end")]
    asked, confirmed = [], nd.confirmed
    monkeypatch.setattr(nd, "confirmed", lambda texts, pairs, *a: (asked.append(pairs.count()), confirmed(texts, pairs, *a))[1])
    got = nd.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, 85, 3))
    assert sum(asked) < 15 * len(docs)


def test_odd_bits_never_say_more_than_the_difference():
    r = np.random.default_rng(4)
    for n in (0, 3, 200, 9000):
        both = r.integers(0, 2**63, n, dtype=np.uint64)
        one, two = (np.concatenate([both, r.integers(0, 2**63, k, dtype=np.uint64)]) for k in (n // 7, n // 5 + 1))
        p, q = nd.odd_bits([one, two])
        assert len(p) == nd.ODD // 64
        unlike = int(np.unpackbits((p ^ q).view(np.uint8)).sum())
        assert unlike <= n // 7 + n // 5 + 1 and (n > 200 or unlike >= 0.9 * (n // 7 + n // 5))


def test_signing_holds_little_at_a_time():
    r = random.Random(6)
    text = [" ".join(str(r.randrange(10**6)) for _ in range(300)).encode() for _ in range(1000)]
    ids = pa.array(range(len(text)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(text, pa.binary())], names=["doc_id", "row_key", "text"])
    rows = 0
    tracemalloc.start()
    for out in nd._signed(5, nd.band_rows(80), [batch]):
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(text) and peak < 20 << 20
