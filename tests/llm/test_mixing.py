"""Operator 6: targets by hand, sizes taken, inclusion shares."""

import random
from collections import Counter, defaultdict

import pytest

from spoorline.llm import mixing


def corpus(n=3000):
    r = random.Random(6)
    source = lambda: r.choice(["a"] * 10 + ["b", "c", "d", None, "é", "z"])
    docs = [(i, " ".join("w" * r.randint(1, 4) for _ in range(int(r.lognormvariate(3, 1)))), source()) for i in range(n)]
    return [*docs, (n, None, "a"), (n + 1, "", "b"), (n + 2, "x " * 900, "c"), (None, "null id", "a"), docs[5], docs[5]]


def water(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > cap * sizes[s]}
        if not over:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("cell", [20_000, 50])
def test_mix(spark, cell, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", cell)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(docs)
    size = Counter()
    for _, t, s in docs:
        size[s] += len((t or "").split())
    want, taken, longest = water(size), Counter(), defaultdict(int)
    for g in got:
        assert abs(g.target - want[g.source]) < 1e-6 * want[g.source] and g.source_size == size[g.source]
        assert g.taken in (0, g.size, 2 * g.size)
        taken[g.source] += g.taken
        longest[g.source] = max(longest[g.source], g.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix_repeat(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(g.times for g in got)


def test_all_capped_and_empty(spark):
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(one).first().target == 4.5
    assert mixing.mix_sources(one, share=9.0).first().taken == 6
    assert mixing.mix_sources(one.where("false")).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix_sources(none).collect()] == [(0, 0), (0, 0)]


def plain_sample(rows, left):
    """Documents by rank until their words come nearest to what is left, each weighed by its middle."""
    out, words = [], 0
    for r in sorted(rows, key=lambda r: (r.rank, r.doc_id is None, r.doc_id or 0, r.size)):
        out.append(r.size if words + r.size / 2 < left and r.size else 0)
        words += r.size
    return sorted(out)


def test_taken_is_a_plain_order_sample(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 40)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    sizes = mixing.with_sizes(docs)
    groups = defaultdict(list)
    for r in mixing.pareto_take(sizes, mixing.targets(sizes)).collect():
        groups[r.source].append(r)
    for rows in groups.values():
        assert sorted(r.taken - r.copies * r.size for r in rows) == plain_sample(rows, rows[0].left)


@pytest.mark.parametrize("share", [0.001, 0.3, 0.999])
def test_inclusion_odds_are_calibrated(spark, share, monkeypatch):
    """Inclusion probabilities sum to the words wanted, documents are taken about as often as theirs say, and cells are even."""
    r = random.Random(2)
    n = 20_000 if share != 0.3 else 400
    docs = [(i, int(r.lognormvariate(4, 1.2)) + 1, "s") for i in range(n)]
    sizes = spark.createDataFrame(docs, "doc_id long, size long, source string").coalesce(2).cache()
    total = sum(d[1] for d in docs)
    t = mixing.targets(sizes, share=share)
    rows = mixing.pareto_take(sizes, t, 1).collect()
    p = {x.doc_id: x.odds / (1 + x.odds) for x in rows}
    assert abs(sum(p[i] * s for i, s, _ in docs) / (share * total) - 1) < 1e-6
    cells = Counter(x.cell for x in rows)
    assert max(cells.values()) <= 2 * mixing.ROWS_PER_CELL
    if share == 0.3:
        seen, runs = Counter(), 10
        for seed in range(runs):
            seen.update(x.doc_id for x in mixing.pareto_take(sizes, t, seed).where("taken > 0").select("doc_id").collect())
        size = dict(d[:2] for d in docs)
        for low, high in ((0, 40), (40, 120), (120, 10**9)):
            ids = [i for i in p if low <= size[i] < high]
            assert abs(sum(seen[i] for i in ids) / runs - sum(p[i] for i in ids)) < 0.1 * sum(p[i] for i in ids) + 1
    sizes.unpersist()


def test_repeat_keeps_clashing_columns(spark):
    docs = [(1, "a b c", "s", 5, 6, 7), (1, "a b c", "s", 5, 6, 7), (2, None, None, 1, 1, 1), (3, "x " * 50_000, "t", 0, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, times long, n long, copy long")
    got = mixing.mix_repeat(df)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(docs)
    assert got.count() == mixing.mix_sources(df).agg({"times": "sum"}).first()[0]
