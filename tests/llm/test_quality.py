"""Operator 8: measures by brute force, sketches against exact quantiles, verdicts."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from spoorline.llm import quality


def by_hand(text):
    text = text or ""
    ws = set(" \t\n\x0b\x0c\r")
    words, now = [], ""
    for c in [*text, " "]:
        if c in ws:
            words += [now] if now else []
            now = ""
        else:
            now += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines, dup = [x for x in text.split("\n") if set(x) - ws], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(lines)


def texts(n=80):
    r = random.Random(8)
    words = ["ab", "c", "dé", "日本", "x#", "<&>", "long" * 5]
    return [None, "", " \n", "a b c a b c", "x\nx\n x\n\x0bx", "q" * 5000, "w " * 3000, *("".join(r.choice(words) + r.choice([" ", "\n", "\t", "  ", "\x1c", " "]) for _ in range(r.randint(0, 120))) for _ in range(n))]


def test_measures():
    for t in texts():
        assert quality.measure(t) == by_hand(t)


def test_sketch(spark):
    r = np.random.default_rng(1)
    data = [(k, float(x)) for k in ("a", "b") for x in np.concatenate([r.lognormal(0, 1, 2000), np.zeros(50)])]
    df = spark.createDataFrame(data, "k string, value double")
    whole = quality.sketch(df, ["k"])
    parts = quality.sketch(df.where("value < 1"), ["k"]).unionByName(quality.sketch(df.where("value >= 1"), ["k"])).groupBy("k", "cell").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select("k", "cell", "n").collect()))  # sketches merge
    for row in quality.quantiles(whole, ["k"], {"q1": 0.25, "q3": 0.75, "top": 0.995}).collect():
        exact = np.sort([v for k, v in data if k == row.k])
        assert row.n_rows == len(exact)
        for name, q in (("q1", 0.25), ("q3", 0.75), ("top", 0.995)):
            want = exact[int(np.ceil(q * len(exact))) - 1]
            assert abs(row[name] / want - 1) < quality.GROWTH - 1 + 1e-9


def test_verdicts(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(r.choice(words) for _ in range(r.randint(60, 300))), "en", f"s{i % 2}") for i in range(400)]
    bad = [(1000, "x " * 20, "en", "s0"), (1001, "a b c " * 60, "en", "s0"), (1002, " ".join(w + "%%%###" for w in words[:200]), "en", "s0"), (1003, None, None, None), (1004, " ".join(w * 12 for w in words[:200]), "en", "s1")]
    alone = [(2000, " ".join(words[:100]), None, None)]
    df = spark.createDataFrame([(*x, 1) for x in [*clean, *bad, *alone, clean[0]]], "doc_id long, text string, lang string, source string, n_words int")
    got = quality.quality_rules(df).collect()
    for g in got:
        t = next(x[1] for x in [*clean, *bad, *alone] if x[0] == g.doc_id)
        n, chars, symbols, dup, repeat, _ = by_hand(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert g.base_failed == (n < 50 or 100 * repeat > 50 * n)
    assert {g.doc_id for g in got if not g.kept} == {1000, 1001, 1002, 1003, 1004}
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and kept.count() == len(clean) + 2
    none = df.where("false")
    assert quality.quality_rules(none).count() == 0 == quality.quality_filter(none).count()


def test_junk_does_not_move_its_cutoff(spark):
    """A few percent of junk in a group, far more than the last half percent, are still beyond the group's threshold."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    for percent in (3, 5, 20):
        rows = [(i, " ".join(w + ("#$" if i < 3 * percent else "") for w in r.sample(words, 100)), "en", "s") for i in range(300)]
        got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
        assert {g.doc_id for g in got if not g.kept} == set(range(3 * percent))
        assert not any(g.base_failed for g in got)


def test_kept_by_exact_quantiles(spark):
    """Verdicts against thresholds from sorted values; the sketch may only decide otherwise near a threshold."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(700):
        lang, source = ("en", f"s{i % 2}") if i < 600 else ("de", f"s{i % 5}") if i < 690 else ("xx", "s9")
        w = [r.choice(words) for _ in range(r.randint(55, 120))]
        if i % 23 == 0:
            w = [x + "#$%" for x in w]
        rows.append((i, ("\n" if i % 7 == 0 else " ").join(w), lang, source))
    got = {g.doc_id: g for g in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    measured = {i: dict(zip(quality.MEASURES, (c[2] / c[0], c[3] / max(c[5], 1), c[4] / c[0], c[1] / c[0]), strict=True)) for i, c in ((i, by_hand(t)) for i, t, *_ in rows)}
    good = [(i, lang, source) for i, _, lang, source in rows if not got[i].base_failed]
    near = 0
    for i, lang, source in good:
        beyond = False
        for m, floor in quality.MEASURES.items():
            q1 = q3 = 0.0
            for own in (good, [x for x in good if x[1] == lang], [x for x in good if x[1:] == (lang, source)]):
                v = sorted(measured[x[0]][m] for x in own)
                a, b = (v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.75))
                lean = 0 if own is good else quality.LEAN
                q1, q3 = (len(v) * a + lean * q1) / (len(v) + lean), (len(v) * b + lean * q3) / (len(v) + lean)
            s = quality.SLACK * max(q3 - q1, floor)
            x = measured[i][m]
            if min(abs(x - (q1 - s)), abs(x - (q3 + s))) < 0.03 * (abs(q1) + abs(q3) + s):
                near += 1
                break
            beyond |= not q1 - s <= x <= q3 + s
        else:
            assert got[i].kept == (not beyond)
    assert near < 40 and sum(not got[i].kept for i, *_ in good) >= 25


def test_filter_measures_each_text_once_in_a_task(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", f"s{i % 2}") for i in range(20)] + [(20, "short", "en", "s0")], "doc_id long, text string, lang string, source string")
    out = quality.quality_filter(docs)
    assert sorted(r.doc_id for r in out.collect()) == list(range(20))
    # Two in a row are two workers for each task.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_counts_take_one_text_at_a_time():
    text = pa.array(["word " * 2000] * 500)
    tracemalloc.start()
    found = quality.counts_of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [dict(zip(quality.COUNTS, quality.measure("word " * 2000), strict=True))] * 500
    assert peak < 2 << 20
    assert len(quality.counts_of(pa.array([], pa.string()))) == 0 and quality.counts_of(pa.array([None], pa.string())).to_pylist() == [dict.fromkeys(quality.COUNTS, 0)]
