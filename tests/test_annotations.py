import pytest
from conftest import rows
from pyspark.sql import functions as F

from plateworks.operators import annotations as a
from plateworks.operators import training
from plateworks.plans import curation, streams


def edit(op, **k):
    base = dict(job="j", record="r001", seq=1, op=op, label="A", x0=50, y0=0, x1=100, y1=40, expected=None, text="t", status=None, mode=None, reviewer="me", confirmed=True, width=100, height=80)
    return base | k


def test_life_of_a_figure():
    f = a.new_figure()
    assert a.apply_edit(f, edit("crop", confirmed=False))[0] == 400
    assert a.apply_edit(f, edit("crop", x1=104))[0] == 400 and a.apply_edit(f, edit("crop", x1=55))[0] == 400
    assert a.apply_edit(f, edit("crop")) == (200, 1)
    assert a.apply_edit(f, edit("crop"))[0] == 409
    assert a.apply_edit(f, edit("review", status="verified"))[0] == 200 and f["complete"]
    assert a.apply_edit(f, edit("understanding", expected=0)) == (200, 1) and f["status"] == "verified"
    assert a.apply_edit(f, edit("understanding", expected=0))[0] == 409
    assert a.apply_edit(f, edit("delete", expected=2))[0] == 409
    assert a.apply_edit(f, edit("delete", expected=1))[0] == 200 and f["status"] == "proposed" and not f["complete"]
    assert a.apply_edit(f, edit("delete", expected=1))[0] == 404
    assert a.apply_edit(f, edit("review", status="verified"))[0] == 400
    assert a.apply_edit(f, edit("review", status="verified", mode="no_split"))[0] == 200
    assert a.apply_edit(f, edit("crop")) == (200, 2) and f["mode"] == "panel_boxes"  # the history stays
    assert a.apply_edit(f, edit("review", status="best"))[0] == 400 and a.apply_edit(f, edit("crop", label="AB"))[0] == 400
    assert f["version"] == 5


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    assert rows(streams.edit_stream(spark, d)) == rows(curation.edit_outcomes(spark, d))


def test_label_text_golden(spark):
    schema = "b array<struct<x0:double,y0:double,x1:double,y1:double>>, w int, h int"
    df = spark.createDataFrame([([(50.0, 0.0, 100.0, 40.0)], 100, 80), ([], 100, 80), (None, 9, 9)], schema)
    got = [r[0] for r in df.select(training.yolo_text(F.col("b"), F.col("w"), F.col("h"))).collect()]
    assert got == ["0 0.75000000 0.25000000 0.50000000 0.50000000\n", "", ""]
    with pytest.raises(Exception, match="invalid normalized box"):
        spark.createDataFrame([([(50.0, 0.0, 160.0, 40.0)], 100, 80)], schema).select(training.yolo_text(F.col("b"), F.col("w"), F.col("h"))).collect()


def test_readiness_and_sample_id(spark):
    df = spark.createDataFrame([("VERIFIED ", True, "no_split", 0, 3), ("verified", True, "panel_boxes", 0, 0), ("verified", None, "panel_boxes", 2, 0), ("verified", True, None, 2, 0)], "s string, c boolean, m string, p int, i int")
    assert [r[0] for r in df.select(training.ready(*[F.col(c) for c in "scmpi"])).collect()] == [True, False, False, True]
    import hashlib

    want = "sample_" + hashlib.sha256(b"g\0f\0i").hexdigest()[:24]
    assert df.limit(1).select(training.sample_id(F.lit("g"), F.lit("f"), F.lit("i"))).first()[0] == want


def test_effective_panels_fall_back_for_version_zero_only(spark):
    t = spark.createDataFrame([("j", "r", "a", 0, None, 100, 80), ("j", "r", "B", 1, True, 100, 80), ("j", "r", "C", 0, False, 100, 80)], "job string, record string, label string, current_version int, active boolean, width int, height int")
    v = spark.createDataFrame([("j", "r", "B", 1, 0.0, 0.0, 500.0, 5.0)], "job string, record string, label string, version int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([("j", "r", x, 0.0, 0.0, 9.0, 9.0) for x in "ABC"], "job string, record string, label string, x0 double, y0 double, x1 double, y1 double")
    got = {r.label: (r.annotation_source, r.issue) for r in a.effective_panels(t, v, p).collect()}
    assert got == {"A": ("rule_proposal", None), "B": (None, "panel_B_missing_or_invalid_bbox")}


def test_reconcile_and_upsert(spark):
    old = spark.createDataFrame([("j", "r", "A", 0), ("j", "r", "B", 2), ("j", "r", "C", 0)], "job string, record string, label string, current_version int")
    new = spark.createDataFrame([("j", "r", "A"), ("j", "r", "D")], "job string, record string, label string")
    assert {(r.label, r.state) for r in a.reconcile(old, new).collect()} == {("A", "kept"), ("B", "restored"), ("C", "dropped"), ("D", "added")}
    assert rows(training.upsert(old.drop("job"), old.drop("job").where("label = 'A'").withColumn("current_version", F.lit(7)), "label"))[0] == ("r", "A", 7)
