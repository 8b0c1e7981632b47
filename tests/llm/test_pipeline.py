"""The pipeline's stages, each judged on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents(n=120):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    docs = []
    for i in range(n):
        docs.append((i, " ".join(r.choice(words) for _ in range(r.randint(60, 200))), "en", f"s{i % 3}", 1))
    docs += [(500, docs[0][1], "en", "s0", 1), (501, docs[1][1].replace(" ", "  "), "en", "s1", 1), (502, "too short", "en", "s0", 1), (503, None, None, None, None)]
    near = docs[2][1].split()
    near[5] = "changed"
    docs.append((504, " ".join(near), "en", "s2", 1))
    return docs


def test_stages(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    everything = {d[0] for d in docs}
    assert everything - kept[0] == {502, 503}
    assert kept[0] - kept[1] == {500, 501} or kept[0] - kept[1] == {500, 1}
    assert kept[1] - kept[2] == {504}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert now.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, now.collect()))
