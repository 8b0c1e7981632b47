"""Operator 3 against counts in plain Python, and on held-out labels."""

import math
import random
from collections import Counter

from spoorline.llm import lm_scoring


def corpus(n=60):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(40)]
    good, bad = words[:25], words[15:]
    return [(i, r.choice([" ", "\n", "  "]).join(r.choice(good if i % 2 else bad) for _ in range(r.randint(0, 80)))) for i in range(n)]


def by_hand(docs, targets, d=lm_scoring.DISCOUNT):
    def train(rows):
        words, pairs = Counter(), Counter()
        for t in rows:
            w = (t or "").split()
            words.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
        return words, pairs

    everything = [t for _, t in docs]
    vocabulary = {w for t in everything for w in (t or "").split()}
    (all_words, all_pairs), (words, pairs) = train(everything), train([t for i, t in docs if i in targets])

    def loss(words, pairs, text):
        total, w = 0.0, text.split()
        first, seen = Counter(), Counter()
        for (a, _), c in pairs.items():
            first[a] += c
        for p in all_pairs:  # the inventory is shared
            seen[p[0]] += max(pairs[p] - d, 0) / max(first[p[0]], 1)
        for a, b in zip(["<s>", *w], w, strict=False):
            uni = (words[b] + 1) / (sum(words.values()) + len(vocabulary) + 1)
            total -= math.log(max(pairs[a, b] - d, 0) / max(first[a], 1) + (1 - seen[a]) * uni)
        return total / len(w)

    return {i: (len(t.split()), loss(words, pairs, t), loss(all_words, all_pairs, t)) if (t or "").split() else (0, None, None) for i, t in docs}


def test_against_plain_counts(spark):
    docs = [*corpus(), (1000, None), (1001, " \n")]
    targets = {i for i, _ in docs if i % 4 == 1}
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*targets, 1, None]], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(df, ids, 0.0, 0.0).collect()}
    for i, (n, t, b) in by_hand(docs, targets).items():
        assert got[i].n_tokens == n
        if n:
            assert math.isclose(got[i].target_loss, t, rel_tol=1e-9) and math.isclose(got[i].background_loss, b, rel_tol=1e-9)
            assert math.isclose(got[i].score, t - b, abs_tol=1e-9)
        else:
            assert got[i].score is None


def test_held_out(spark):
    """Documents like the targets, but not among them, score lower than the others."""
    docs = [(i, t) for i, t in corpus(400) if len(t) > 40]
    ids = spark.createDataFrame([(i,) for i, _ in docs if i % 4 == 1], "doc_id long")
    rows = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), ids).where("doc_id % 4 <> 1").collect()
    good, bad = [r.score for r in rows if r.doc_id % 2], [r.score for r in rows if not r.doc_id % 2]
    right = sum(g < b for g in good for b in bad) / len(good) / len(bad)
    assert right > 0.95


def test_shares_bound_the_models(spark):
    docs = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in corpus(200)], "doc_id long, text string, target boolean")
    v, t, b = lm_scoring.models(docs, 0.03, 0.01)
    assert len(v) <= 2 / 0.03 + 2 and len(t.codes) == len(b.codes) <= 2 / 0.01
    for m in (t, b):  # each context's probabilities sum to 1
        for a in range(len(v)):
            import numpy as np

            assert math.isclose(np.exp(-m.losses(np.full(len(v) - 1, a), np.arange(len(v) - 1))).sum(), 1.0, rel_tol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    assert lm_scoring.score(one, none.select("doc_id")).first().n_tokens == 4


def test_rare_entries_count_by_default(spark):
    """A word and its bigrams that are far below any fixed share of the corpus score as plain counts say."""
    docs = [*((i, "the same few words " * 2000) for i in range(40)), (100, "odd bird sang"), (101, "odd bird flew"), (102, "new bird sang")]
    targets = {100}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.quality_score(df, spark.createDataFrame([(100, 1), (101, 0)], "doc_id long, quality int")).collect()}
    for i, (n, t, b) in by_hand(docs, targets).items():
        assert got[i].n_tokens == n
        assert math.isclose(got[i].target_loss, t, rel_tol=1e-9) and math.isclose(got[i].background_loss, b, rel_tol=1e-9)
