"""Operator 13 against winnowing spelled out window by window."""

import hashlib
import random

import pytest

fingerprints = pytest.importorskip("spoorline.llm.fingerprints")
G, W = fingerprints.GRAM, fingerprints.WINDOW
SCHEMA = "doc_id long, text string, hashes string, n int, place int, n_chars long"


def brute_kept(text):
    """Positions kept, from hashes of single grams."""
    g = min(G, len(text))
    h = [int(fingerprints.winnow(text[i : i + g])[0][0]) for i in range(len(text) - g + 1)] if text else []
    kept = []
    for i in range(max(1, len(h) - W + 1) if h else 0):
        window = h[i : i + W]
        j = i + max(k for k, x in enumerate(window) if x == min(window))
        if not kept or kept[-1] != j:
            kept.append(j)
    return [h[j] for j in kept], kept


def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop é中\n") for _ in range(r.randint(1, 9))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 2, 4, 5, 10, 12, 15, 16, 18, 20, 40, 90, 200)] + ["a" * 500, "ab" * 200, "x" * (G - 1), "x" * G, "y" * (G + W - 1), "y" * (G + W), "😀" * 30]


def test_windows():
    for text in texts():
        h, p = fingerprints.winnow(text)
        assert (h.tolist(), p.tolist()) == brute_kept(text)


def test_guarantee():
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = letters(G + W - 1)
        a, b = letters(r.randint(0, 300)) + shared + letters(r.randint(0, 300)), letters(r.randint(0, 300)) + shared + letters(r.randint(0, 300))
        (ha, pa_), (hb, pb) = fingerprints.winnow(a), fingerprints.winnow(b)
        places = {(x, i) for x, i in zip(ha.tolist(), (pa_ - a.index(shared)).tolist())} & {(x, i) for x, i in zip(hb.tolist(), (pb - b.index(shared)).tolist())}
        assert any(0 <= i < W for _, i in places)


def brute(docs, order):
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        a, b, c = (dict(zip(*brute_kept(t))) for t in (text, changed, after))
        like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
        said = lambda t: ",".join(f"{h:016x}:{p}" for h, p in zip(*brute_kept(t)))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), said(text), said(changed), like(a, b), like(a, c)))
    return out


def test_successors(spark):
    r = random.Random(2)
    docs = list(zip(r.sample(range(-500, 500), 63), texts() * 3))
    docs[5] = (docs[5][0], None)
    frame = spark.createDataFrame([(i, t, "h", 1, 2, 3) for i, t in docs], SCHEMA)
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    expected = sorted(brute(docs, order))
    for parts in (1, 6):
        assert sorted(map(tuple, fingerprints.edited_fingerprints(frame.repartition(parts)).collect())) == expected


def test_repeated_rows_and_nulls(spark):
    """Equal doc_ids, many equal rows, null doc_ids: each row has a successor that follows it in the stated order, and reruns agree."""
    docs = [(7, "one text of some length that is repeated")] * 40 + [(7, "another"), (9, "top"), (None, "nameless"), (None, None), (-(2**63), "least"), (2**63 - 1, "greatest")]
    frame = spark.createDataFrame([(i, t, "h", 1, 2, 3) for i, t in docs], SCHEMA)
    key = {(r.doc_id, r.text): r.k for r in frame.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS k").collect()}
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), key[d], d[1]))
    expected = sorted(brute(docs, order), key=str)
    for parts in (1, 5):
        assert sorted(map(tuple, fingerprints.edited_fingerprints(frame.repartition(parts)).collect()), key=str) == expected


@pytest.mark.parametrize("docs", [[], [(1, "alone in the table, a single document")]])
def test_few(spark, docs):
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(i, t, "h", 1, 2, 3) for i, t in docs], SCHEMA)).collect()
    assert list(map(tuple, got)) == brute(docs, docs)


def test_long_text(spark):
    text = " ".join(str(i) for i in range(300_000))
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(2, text, "h", 1, 2, 3), (1, "short", "h", 1, 2, 3)], SCHEMA)).collect()
    long = next(r for r in got if r.doc_id == 2)
    assert long.n_chars == len(text) and long.near_edited > 0.5 and long.near_next < 0.01
    assert {r.doc_id: len(r.hashes) for r in fingerprints.fingerprints(spark.createDataFrame([(2, text), (3, None)], "doc_id long, text string")).collect()} == {2: len(fingerprints.winnow(text)[0]), 3: 0}
