"""Operator 12 against exhaustive search over plain lists."""

import hashlib
import math

import numpy as np
import pytest

vector_codes = pytest.importorskip("spoorline.llm.vector_codes")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, deal int"


def brute(rows):
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // 8
    kept = [(i, [[math.floor(4096 * x) for x in v[p * w : p * w + w]] for p in range(8)], lab) for i, v, lab in kept if len(v) == 8 * w]
    books = [[v[p] for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            of = [near(v[p], books[p])[1] for _, v, _ in kept]
            for j in range(len(books[p])):
                mine = [v[p] for (_, v, _), k in zip(kept, of) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [near(v[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, lab))
    return [(i, c, e, by_label[lab], sha) for i, c, e, lab in out]


def table(n, width=16, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(20, width))
    rows = [(int(i), [float(np.float32(x)) for x in centre[r.integers(20)] + 0.2 * r.normal(size=width)], int(r.integers(4)), "c", 1) for i in r.permutation(n)]
    return rows


def same(spark, rows, partitions=5):
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(partitions))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_edges_and_ties(spark):
    rows = table(300)
    grid = [[float(np.float32(x)) for x in v] for v in np.random.default_rng(5).integers(-2, 3, (40, 16)) / 4096]  # many equal distances
    rows += [(1000 + i, v, None, "c", 1) for i, v in enumerate(grid)]
    rows += [(-1, None, 1, "c", 1), (2000, [None] * 16, 1, "c", 1), (2001, [float("nan")] * 16, 1, "c", 1), (2002, [float("inf")] * 16, 2, "c", 1), (2003, [0.5] * 8, 2, "c", 1), (2004, [], 2, "c", 1)]
    rows += [(None, rows[0][1], 3, "c", 1), rows[5], rows[5], rows[6]]
    same(spark, rows)


def test_equal_start_entries(spark):
    rows = [(i, [0.25] * 16, i % 2, "c", 1) for i in range(20)] + [(100 + i, [i / 7.0 if j % 3 else -i / 9.0 for j in range(16)], 5, "c", 1) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], lab, a, b) for i, v, lab, a, b in rows]
    same(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few(spark, n):
    same(spark, table(n), 3)


def test_not_divisible(spark):
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1, "c", 1)], SCHEMA))


def test_search_is_exact_and_saves_distances():
    r = np.random.default_rng(1)
    book, x = r.integers(-50, 50, (16, 3)), r.integers(-50, 50, (4000, 3))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    code, best = vector_codes.orchard(x, book)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
