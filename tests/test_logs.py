"""Readers of other tools' files, on small files written by hand."""

import numpy as np
import pytest

from spoorline.sources import logs
from spoorline.sources import tracks as io


def test_comments_and_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# model: big\n# total_inference_time_s: 12.5\n#no pair\nvideo,track_id,frame,x,y\nv,1,0,2.0,3.0\n")
    assert {(r.key, r.value) for r in logs.read_comments(spark, str(tmp_path / "t.csv")).collect()} == {("model", "big"), ("total_inference_time_s", "12.5")}
    assert [r.seconds for r in logs.inference_seconds(spark, str(tmp_path / "t.csv")).collect()] == [12.5]
    assert [(r.track_id, r.frame, r.x, r.y) for r in logs.read_any(spark, str(tmp_path / "t.csv")).collect()] == [("1", 0, 2.0, 3.0)]


def test_wide_tracks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("track,frame_idx,instance.score,a.x,a.y,a.score,b.x,b.y,b.score\n,0,1,1.5,2.5,.9,,,\n,1,1, , ,,3,4,\n")
    assert sorted(map(tuple, logs.read_wide_tracks(spark, str(tmp_path / "w.csv")).collect())) == [("a", 0, 1.5, 2.5, 0.9), ("b", 1, 3.0, 4.0, None)]
    (tmp_path / "n.csv").write_text("frame_idx,x\n1,2\n")
    with pytest.raises(ValueError):
        logs.read_wide_tracks(spark, str(tmp_path / "n.csv"))


def test_training_logs(spark, tmp_path):
    for name, rows in (("m.n=21.centroid", "train/loss,train/time,val/time\n1,2.5,0.5\n2,,1\n"), ("m.n=4.top", "val/time,train/time\n1,2\n"), ("plain", "train/time\n7\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "training_log.csv").write_text(rows)
    own = {}
    for name in ("m.n=21.centroid", "m.n=4.top", "plain"):
        r = logs.read_training_logs(spark, str(tmp_path / name / "training_log.csv")).first()
        own[name] = (r.epochs, r.seconds, r.labels)
    assert own == {"m.n=21.centroid": (2, 4.0, 21), "m.n=4.top": (1, 3.0, 4), "plain": (1, 7.0, None)}
    every = logs.read_training_logs(spark, str(tmp_path / "m.n=21.centroid")).unionByName(logs.read_training_logs(spark, str(tmp_path / "m.n=4.top")))
    assert tuple(logs.training_totals(every).first()) == (7.0, 25, 2)


def test_point_rows(spark, tmp_path):
    (tmp_path / "p.csv").write_text("v1,0.5,0.25,0,1,1,1\nv1,0,0,1,0.1,0.2,0\nv2,0.5,0.5,0\n\n")
    got = logs.read_point_rows(spark, str(tmp_path / "p.csv"), 200, 100).collect()
    assert sorted((r.video, r.frame, r.x, r.y, r.occluded) for r in got) == [("v1", 0, 0.0, 0.0, True), ("v1", 0, 100.0, 25.0, False), ("v1", 1, 20.0, 20.0, False), ("v1", 1, 200.0, 100.0, True), ("v2", 0, 100.0, 50.0, False)]
    assert len({r.track_id for r in got}) == 3
    (tmp_path / "bad.csv").write_text("v1,0.5,0.25\n")
    with pytest.raises(Exception, match="no whole triples"):
        logs.read_point_rows(spark, str(tmp_path / "bad.csv")).collect()


XML = '<?xml version="1.0"?><Tracks>{}</Tracks>'


def particle(*places):
    return '<particle nSpots="1">' + "".join(f'<detection t="{t}" x="{x}" y="{y}" z="0"/>' for t, x, y in places) + "</particle>"


def test_datasets_and_points(spark, tmp_path):
    (tmp_path / "p.xml").write_text(XML.format(particle((0, 1.0, 1.0), (1, 2.0, 2.0)) + particle((0, 4.0, 1.0)) + particle((0, 9.0, 9.0)) + particle((1, 0.0, 0.0))))
    (tmp_path / "t.json").write_text('{"tracks": [{"track_id": "a", "frames": [{"frame": 3, "x": 1, "y": 2}]}]}')
    m = np.zeros((3, 3, 2), np.uint8)
    m[1, 2, 1] = 1
    (tmp_path / "id4.nrrd").write_bytes(b"NRRD0004\ntype: uint8\ndimension: 3\nsizes: 3 3 2\nencoding: raw\n\n" + m.tobytes(order="F"))
    d = logs.read_datasets(spark, {"one": [("xml", str(tmp_path / "p.xml"))], "two": [("json", str(tmp_path / "t.json")), ("nrrd", str(tmp_path / "id4.nrrd"))]})
    got = d.collect()
    assert {(r.dataset, r.track_id, r.frame, r.x, r.y) for r in got if r.dataset == "two"} == {("two", "a", 3, 1.0, 2.0), ("two", "id4", 1, 1.0, 2.0)}
    one = d.where("dataset = 'one'")
    assert one.count() == 5 and {r.track_id for r in one.collect()} == {r.track_id for r in one.repartition(3).collect()}
    # The second point's nearest track is taken by the first one.
    wanted = spark.createDataFrame([(1, 2.0, 1.0), (2, 0.0, 1.0), (3, 0.0, 0.0)], "query_id int, x double, y double")
    found = {r.query_id: round(r.d, 6) for r in logs.nearest_to_points(one, wanted, "dataset").collect()}
    assert found == {1: 1.0, 2: 4.0, 3: round(162**0.5, 6)}
    with pytest.raises(ValueError):
        logs.read_any(spark, "x.unknown")


def test_report_does_not_cut(spark):
    assert io.markdown(spark.range(2)).count("\n") == 3
    with pytest.raises(ValueError):
        io.markdown(spark.range(5), 4)
