"""Operator 10: enumeration, round trips, and the sampling distribution."""

import math
from collections import Counter

import numpy as np
import pytest

from spoorline.llm import pieces
from spoorline.llm.common import mix


@pytest.fixture(scope="module")
def model():
    return pieces.Model()


def segmentations(model, text):
    s = "▁" + text.replace(" ", "▁")
    weight = {model.text[i]: w for i, w in enumerate(model.weight) if np.isfinite(w)}
    found = {}

    def go(i, path, w):
        if i == len(s):
            found[path] = w
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in weight:
                go(j, (*path, s[i:j]), w + weight[s[i:j]])

    go(0, (), 0.0)
    top = max(found.values())
    total = sum(math.exp(w - top) for w in found.values())
    return {p: math.exp(w - top) / total for p, w in found.items()}


@pytest.mark.parametrize("near", [pieces.NEAR, 1, 2])
def test_distribution_without_replacement(model, near, monkeypatch):
    """near: places that are sets of their own; what differs later is split when popped."""
    monkeypatch.setattr(pieces, "NEAR", near)
    text, n = "ab the", 6000
    p = segmentations(model, text)
    first, second = Counter(), Counter()
    for rows in pieces.sample(model, [text] * n, mix(np.arange(n, dtype=np.uint64) + np.uint64(9)), 3):
        found = [tuple(model.text[i] for i in r[3]) for r in rows]
        assert len(set(found)) == 3
        assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)
        for f, r in zip(found, rows, strict=True):
            assert math.isclose(r[0], math.log(p[f]), abs_tol=1e-6)
        first[found[0]] += 1
        second[found[1]] += 1
    for x in sorted(p, key=p.get)[-4:]:
        assert abs(first[x] / n - p[x]) < 0.02
        assert abs(second[x] / n - sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)) < 0.02


@pytest.mark.parametrize("near", [pieces.NEAR, 1, 2])
def test_all_segmentations_of_a_short_text(model, near, monkeypatch):
    monkeypatch.setattr(pieces, "NEAR", near)
    p = segmentations(model, "ant")
    (rows,) = pieces.sample(model, ["ant"], np.array([3], dtype=np.uint64), 500)
    assert sorted(tuple(model.text[i] for i in r[3]) for r in rows) == sorted(p)
    assert all(r[2] == 0.0 for r in rows)


@pytest.mark.parametrize("near", [pieces.NEAR, 1])
def test_inclusion(model, near, monkeypatch):
    """Inverse inclusion probabilities estimate the number of segmentations without bias."""
    monkeypatch.setattr(pieces, "NEAR", near)
    p, n = segmentations(model, "ants"), 3000
    out = pieces.sample(model, ["ants"] * n, mix(np.arange(n, dtype=np.uint64)), 4)
    got = sum(math.exp(r[0] - r[2]) for rows in out for r in rows) / n
    assert abs(got - 1) < 0.05 and len(p) > 4


TEXTS = [None, "", " ", "a", "  two  spaces \n\n", "né\tß 日本 \U0001f600\U00013000", "x" * 5000, "b " * 4000, "Ends.\r\n", "▁odd"]


def test_spark_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the end", "x"), (3, "a", "x")], "doc_id long, text string, ids string")
    out = pieces.sampled_pieces(docs, k=3)
    rows = out.collect()
    again = pieces.sampled_pieces(docs.repartition(4), k=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert all(r.round_trip == (r.doc_id != 9) for r in rows)
    assert {(r.doc_id, r.n_pieces) for r in rows if r.doc_id in (0, 1)} == {(0, 0), (1, 0)}
    text = {(r.doc_id, r.sample): r.text for r in pieces.decoded(out).collect()}
    assert all(text[i, 1] == (TEXTS[i] or "") for i in range(9))
    assert pieces.sampled_pieces(docs.where("false")).count() == 0


def test_ids_decode_with_the_library(model):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    for text in TEXTS[3:9]:
        for _, _, _, ids in pieces.sample(model, [text], np.array([1], dtype=np.uint64), 2)[0]:
            assert sp.decode(ids.tolist()) == text == model.decode(ids.tolist())


def test_chunks_against_a_pattern(model, monkeypatch):
    """Cut by arrays as by the pattern; one number for equal chunks, also when rare ones are given up."""
    import re

    monkeypatch.setattr(pieces, "KEPT", 40)
    texts = [t or "" for t in TEXTS] + ["\n\n a\n b", "▁▁ x", "the the a", " ", "a\nthe"]
    alone = "\n" if model.alone else ""
    cut = [re.findall(f"▁+[^▁{alone}]*|[^▁{alone}]+" + (f"|{alone}" if alone else ""), "▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    lattice = pieces.Lattice(model)
    for a in (0, 5, 0):
        codes, at, first = model.chunks(texts[a:])
        assert first.tolist() == np.cumsum([0, *map(len, cut[a:])]).tolist()
        flat = [c for chunks in cut[a:] for c in chunks]
        assert ["".join(map(chr, codes[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)] == flat
        number = lattice.numbers(codes, at)
        assert len(set(zip(flat, number.tolist(), strict=True))) == len(set(flat)) == len(set(number.tolist()))
        assert ["".join(map(chr, lattice.codes[lattice.start[n] : lattice.stop[n]])) for n in number.tolist()] == flat
