"""Operators 4 and 5 against brute force."""

import hashlib
import random

import pytest

from spoorline.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, start long"


def brute(docs, window, words):
    """docs: (doc_id, text). Removed symbols per row by looking every window up."""
    rows = sorted((d if d is not None else 2**63 - 1, i) for i, (d, _) in enumerate(docs))
    parts = [(t or "").encode().split() if words else (t or "").encode() for _, t in docs]
    first = {}
    for d, i in rows:
        for s in range(len(parts[i]) - window + 1):
            w = tuple(parts[i][s : s + window]) if words else parts[i][s : s + window]
            first.setdefault(w, (d, s))
    out = []
    for (d, _), p in zip(docs, parts, strict=True):
        d = d if d is not None else 2**63 - 1
        gone = [False] * len(p)
        for s in range(len(p) - window + 1):
            w = tuple(p[s : s + window]) if words else p[s : s + window]
            if first[w] < (d, s):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(p, gone, strict=True) if not g]
        data = b" ".join(kept) if words else bytes(kept)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(p), sum(gone), spans, hashlib.sha256(data).hexdigest()))
    return out


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda k: r.choice([" ", "  ", "\n", "\t"]).join(r.choice(words) for _ in range(k))
    passage, line = text(60), text(30)
    docs = [(None, None), (1000, ""), (1001, " \n"), (1002, "a" * 350), (1003, "ab " * 90), (1004, "ab " * 90), (1005, text(3000))]
    for i in range(n):
        t = text(r.randint(0, 90))
        k = r.random()
        if k < 0.3:
            t = f"{t} {passage} {text(9)}"
        elif k < 0.5:
            t = f"{t}\n{line}\n{text(3)}\n{line}"
        elif k < 0.65 and i > 3:
            t = docs[r.randint(7, len(docs) - 1)][1]
        docs.append((i, t))
    docs.append((None, text(40) + passage))
    docs.append(docs[30])  # a row repeated in full
    return docs


@pytest.mark.parametrize("hot", [3000, 10])
@pytest.mark.parametrize("op", ["bytes", "words"])
def test_against_brute_force(spark, op, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(hot)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA).repartition(3)
    if op == "bytes":
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()]
        want = [(d, *x) for (d, _), x in zip(docs, brute(docs, 100, False), strict=True)]
    else:
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()]
        want = [(d, a, b, h) for (d, _), (a, b, _, h) in zip(docs, brute(docs, 20, True), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 1000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).count() == 0 == substring_dedup.substring_dedup(df).count()
