"""Operator 1: its hash, and the operator against grouping in plain Python."""

import hashlib
import random

import numpy as np
import pytest

from spoorline.llm import exact_dedup as ed


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = r.integers(0, 256, (n, 32), dtype=np.uint8)
        h = ed.MinimalPerfectHash(keys)
        assert sorted(h.look_up(keys).tolist()) == list(range(n)) == sorted(h.slot.tolist())
        assert (h.look_up(keys) == h.slot).all()
        others = h.look_up(r.integers(0, 256, (500, 32), dtype=np.uint8))
        assert ((others >= -1) & (others < max(n, 1))).all()


def brute(docs):
    groups = {}
    for d, t in docs:
        key = hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in docs:
        key = hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()
        best = min(groups[key])
        out.append((d, best[2], len(groups[key]), (-len(t or ""), d) == (best[0], best[2]), key))
    return out


def corpus():
    r = random.Random(2)
    words = ["ab", "c", "dé", "日本", "x y"]
    docs = [(None, "a b"), (7, None), (8, ""), (9, " \n"), (50, "q" * 3000), (51, "q " * 3000)]
    docs += [(100 + i, r.choice([" ", "\n", "\t\t"]).join(r.choices(words, k=r.randint(1, 3)))) for i in range(200)]
    return [*docs, docs[20], (None, docs[21][1])]


@pytest.mark.parametrize("shard", [50_000, 9])
def test_against_grouping(spark, shard, monkeypatch):
    monkeypatch.setattr(ed, "SHARD_DIGESTS", shard)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, digest string").repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
    assert ed.exact_filter(df).columns == ["doc_id", "text", "digest"]
    kept = {r.doc_id for r in ed.exact_filter(df).collect()}
    assert ed.exact_filter(df).count() == len({k for *_, k in brute(docs)}) and kept == {w for _, w, *_ in brute(docs)}


def test_history_apart(spark):
    docs = corpus()
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in (docs[:90], docs[90:]))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(new, old).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_empty(spark):
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_tells_rows_apart(spark):
    """Rows of one doc_id with equal words and unlike lengths, repeated rows, nulls, and columns named like the operator's own."""
    docs = [(1, "a  b", "p", "q"), (1, "a b", "p", "q"), (1, "a  b", "p", "q"), (None, "c", "p", "q"), (None, "c", "p", "q"), (2, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, digest string, doc string")
    got = ed.exact_filter(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([docs[0], docs[3], docs[5]], key=str)
