"""Operator 11 against a walk through all orders, document by document."""

import re
from collections import Counter
from itertools import permutations

import pytest

filter_audit = pytest.importorskip("spoorline.llm.filter_audit")

SCHEMA = "doc_id long, text string, lang string, words string, n long, deal int"
LONG = " ".join(f"w{i}" for i in range(120))


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        fails.append((lang or "", i, f))
    out, shares = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            alive = [True] * len(fails)
            for k, c in enumerate(order):
                row = Counter()
                for j, (p, i, f) in enumerate(fails):
                    if p != part:
                        continue
                    row["kept"] += alive[j] and not f[c]
                    row["removed"] += alive[j] and f[c]
                    row["redundant"] += not alive[j] and f[c]
                    row["unique_fails"] += f[c] and sum(f.values()) == 1
                    row["good_lost"] += alive[j] and f[c] and i in good
                    row["toxic_lost"] += alive[j] and f[c] and i in toxic
                    alive[j] = alive[j] and not f[c]
                out[part, "".join(order), k + 1] = row
                shares[part, c] += row["removed"]
    return {(p, o, k, *(r[c] for c in filter_audit.COUNTS), shares[p, o[k - 1]]) for (p, o, k), r in out.items()}


def test_all_orders(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (7, LONG, "fr"), (None, LONG, "en"), (None, LONG, None), (3, LONG.upper(), "en"), (4, LONG + " #", ""),
        (5, "", "en"), (6, None, "en"), (8, None, None), (9, "a b", "en"), (9, "a b", "en"), (10, "a b", "fr"), (11, "same " * 300, "en"), (12, "X\x85Y Z \x0b\x1c" + LONG, "fr"),
        (13, "é" * 70 + " Ä " + LONG, "fr"), (14, "word " * 200_000, "en"), (None, None, None), (-5, "a b", "en"),
    ]
    docs = [(*d, "x", 1, 2) for d in docs]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (None, 1, 1), (9, 0, 1), (99, 1, 1), (5, 1, 1)]
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(d, lab).collect()
    assert len(got) == 3 * 600
    assert {tuple(r) for r in got} == brute(docs, labels)
    assert {tuple(r) for r in filter_audit.filter_audit(d.repartition(7), lab).collect()} == {tuple(r) for r in got}


def test_empty(spark):
    d, lab = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(d, lab).collect() == []
