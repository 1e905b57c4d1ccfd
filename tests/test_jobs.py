import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plateworks import __main__ as command
from plateworks.functions.rects import Rect
from plateworks.operators import jobs, labels, panels, regions, training
from plateworks.sources import files, sinks

BOX = "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double"


def test_pictures_are_written_and_read_again(spark, tmp_path):
    image = np.arange(40 * 50 * 3, dtype=np.int64).reshape(40, 50, 3).astype(np.uint8)
    images = spark.createDataFrame([(1, 40, 50, image.tobytes()), (2, 3, 3, b"x")], "key long, height int, width int, data binary")
    boxes = spark.createDataFrame([(1, "A", 0, 0, 20, 30), (1, "B", 40, 10, 90, 20), (1, "C", 60, 0, 70, 9), (2, "A", 0, 0, 1, 1), (3, "A", 0, 0, 9, 9)], "key long, label string, x0 int, y0 int, x1 int, y1 int")
    cut = sinks.crops(images, boxes)
    n = sinks.write_files(cut.select(F.concat("label", F.lit(".png")).alias("name"), F.col("png").alias("data")), f"file://{tmp_path}/out")
    assert n == 2 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["A.png", "B.png"]
    got = {r.path[-5:]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in files.images(spark, f"{tmp_path}/out").collect()}
    assert np.array_equal(got["A.png"], image[0:30, 0:20]) and np.array_equal(got["B.png"], image[10:20, 40:50])
    shown = sinks.previews(images, boxes).collect()
    assert [r.key for r in shown] == [1] and shown[0].png.startswith(b"\x89PNG")
    sheet = sinks.contact_sheets(images.withColumn("batch", F.lit("b")), per_sheet=2)
    assert [(r.batch, r.sheet) for r in sheet.collect()] == [("b", 0)]
    assert sinks.write_files(spark.createDataFrame([(None, b"x"), ("n", None)], "name string, data binary"), f"file://{tmp_path}/none") == 0


def collection(spark, status, mode="panel_boxes", issue=None):
    figures = spark.createDataFrame(
        [("j1", "r1", "f1", "1", "figure", None, ("a.PNG", 100, 80), "e" * 64, status, mode, True, 3, "rev", None)],
        "job_id string, record_id string, figure_id string, figure_number string, caption_kind string, caption string, image struct<file_name:string,width:int,height:int>, image_sha256 string, "
        "review_status string, annotation_mode string, annotation_complete boolean, annotation_version int, reviewer string, reviewed_at timestamp",
    )
    found = spark.createDataFrame(
        [("j1", "r1", "A", (0.0, 0.0, 50.0, 80.0), "human_manual", 1, None), ("j1", "r1", "B", None if issue else (50.0, 0.0, 100.0, 80.0), "human_manual", 1, issue)],
        "job string, record string, label string, box struct<x0:double,y0:double,x1:double,y1:double>, annotation_source string, panel_version int, issue string",
    )
    sources = spark.createDataFrame([("j1", "d" * 64, True)], "job_id string, file_sha256 string, is_pdf boolean")
    return training.build_records(figures, found, sources, F.lit("now"))


def test_collection_on_disk(spark, tmp_path):
    root, base = f"file://{tmp_path}/c", tmp_path / "c"
    assets = spark.createDataFrame([("img_" + "e" * 64, b"picture")], "image_id string, data binary")
    r = collection(spark, "verified")
    (row,) = r.collect()
    assert row.ready_for_training and row.human_panel_count == 2 and row.paper_id == "paper_" + "d" * 64 and row.caption == ""
    sinks.write_collection(r, assets, root)
    assert (base / f"assets/images/img_{'e' * 64}.png").read_bytes() == b"picture" == (base / f"ready/images/{row.sample_id}.png").read_bytes()
    assert (base / f"ready/labels/{row.sample_id}.txt").read_text() == "0 0.25000000 0.50000000 0.50000000 1.00000000\n0 0.75000000 0.50000000 0.50000000 1.00000000\n"
    assert json.loads((base / f"annotations/{row.sample_id}.json").read_text())["panels"][1]["bbox_xyxy"] == [50.0, 0.0, 100.0, 80.0]
    sinks.write_collection(collection(spark, "proposed"), assets, root)  # taken back: label and picture go, the rest stays
    assert not list((base / "ready/labels").glob("*.txt")) and not list((base / "ready/images").glob("*.png")) and list((base / "annotations").glob("*.json"))
    (whole,) = collection(spark, "verified", "no_split", "panel_B_missing_or_invalid_bbox").collect()
    assert whole.ready_for_training and whole.panels == [] and whole.issues == [] and whole.human_panel_count == 0
    (bad,) = collection(spark, "verified", issue="panel_B_missing_or_invalid_bbox").collect()
    assert not bad.ready_for_training and bad.human_panel_count is None and len(bad.panels) == 1 and bad.issues == ["panel_B_missing_or_invalid_bbox"]


def test_one_run_of_a_batch_at_a_time(spark, tmp_path):
    guard = jobs.RunGuard(spark, f"file://{tmp_path}/runs")
    first = guard.start("b1")
    assert first == 1 and guard.start("b1") is None and guard.start("b2") == 1
    guard.end("b1", first)
    assert guard.start("b1") == 3


def test_updates_and_new_batches(spark):
    listed = spark.createDataFrame([("i000001", "a.pdf", "/x/a.pdf", 5), ("i000002", "b.pdf", "/x/b.pdf", 6)], "item_id string, filename string, source_path string, size_bytes long")
    batch, items = jobs.new_batch(listed, "b1", "folder", "/x", "2026-01-01")
    assert batch.first().total == 2 and {r.status for r in items.collect()} == {"queued"} and len({r.job_id for r in items.collect()}) <= 2
    changes = spark.createDataFrame([("b1", "i000001", "failed", "x")], "batch_id string, item_id string, status string, filename string")
    assert rows(jobs.updated_items(items, changes).select("item_id", "status", "filename")) == [("i000001", "failed", "a.pdf"), ("i000002", "queued", "b.pdf")]
    with pytest.raises(Exception, match="no such item"):
        jobs.updated_items(items, changes.withColumn("item_id", F.lit("i9"))).collect()


def test_hashes_are_kept(spark):
    listed = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, length long, modified long")
    cache = spark.createDataFrame([("a", 1, 1, "old"), ("b", 2, 1, "stale")], "path string, length long, modified long, sha256 string")
    contents = spark.createDataFrame([("a", b"changed"), ("b", b"b")], "path string, content binary")
    got, fresh = jobs.with_hashes(listed, cache, contents)
    digest = "3e23e8160039594a33894f6564e1b1348bbd7a0088d42c4acb73eeaed59c009d"
    assert {(r.path, r.sha256) for r in got.collect()} == {("a", "old"), ("b", digest)} and rows(fresh) == [("b", 2, 2, digest)]


def test_placements_fill_up_what_rasters_leave(spark):
    page = Rect(*[F.lit(v) for v in (0.0, 0.0, 600.0, 800.0)])
    rasters = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 100.0, 100.0), (1, 1, 8, 0.0, 0.0, 10.0, 100.0)], BOX)
    placements = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0.0, 100.0, 99.0), (1, 1, 2, 0.0, 700.0, 100.0, 900.0), (1, 1, 3, 0.0, 705.0, 100.0, 900.0), (1, 1, 4, 300.0, 0.0, 310.0, 500.0), (1, 1, 5, 50.0, 0.0, 300.0, 100.0)], BOX
    )
    got = rows(regions.raster_blocks(rasters, placements, page))
    assert got == [(1, 1, 100001, 0.0, 700.0, 100.0, 800.0), (1, 1, 100002, 50.0, 0.0, 300.0, 100.0), (1, 1, 7, 0.0, 0.0, 100.0, 100.0)]
    assert regions.raster_blocks(spark.createDataFrame([], BOX), spark.createDataFrame([], BOX), page).count() == 0


def test_command_line(spark, tmp_path):
    bank = labels.template_bank(spark)
    drawn = panels.draw_figures(spark.createDataFrame([(1, 4)], "key long, n int"), bank).first()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "fig.png").write_bytes(sinks.png(np.frombuffer(drawn.data, np.uint8).reshape(drawn.height, drawn.width, 3)))
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    command.main(["split", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--crops"])
    out = tmp_path / "out" / "fig.png"
    assert sorted(p.name for p in out.iterdir()) == ["A.png", "B.png", "C.png", "D.png", "layout.json", "preview.png"]
    assert [p["letter"] for p in json.loads((out / "layout.json").read_text())["panels"]] == list("ABCD")
    command.main(["folder", f"file://{tmp_path}/in", f"file://{tmp_path}/out"])
    assert spark.read.parquet(f"file://{tmp_path}/out/items").first().item_id == "i000001"


def test_regions_grow_by_what_is_near(spark):
    region = spark.createDataFrame([(1, 1, 1, 100.0, 100.0, 300.0, 300.0), (1, 1, 2, 400.0, 100.0, 500.0, 200.0)], BOX)
    caption = spark.createDataFrame([(1, 1, 1, 100.0, 310.0, 300.0, 320.0)], BOX)
    marks = spark.createDataFrame(
        [(1, 1, 1, 80.0, 110.0, 95.0, 120.0, "label"), (1, 1, 2, 100.0, 302.0, 300.0, 309.0, "text"), (1, 1, 3, 305.0, 100.0, 312.0, 250.0, "drawing"), (1, 1, 4, 345.0, 100.0, 350.0, 250.0, "drawing")],
        BOX + ", kind string",
    )
    got = rows(regions.grow_regions(region, caption, marks, (0.0, 0.0, 600.0, 800.0)))
    assert got == [(1, 1, 1, 76.0, 96.0, 316.0, 304.0), (1, 1, 2, 400.0, 100.0, 500.0, 200.0)]
    assert regions.grow_regions(spark.createDataFrame([], BOX), caption, marks, (0.0, 0.0, 600.0, 800.0)).count() == 0


def test_fallback_regions_end_at_paragraphs(spark):
    page = Rect(*[F.lit(v) for v in (0.0, 0.0, 600.0, 800.0)])
    prose = "word and more of it " * 8
    blocks = spark.createDataFrame([(1, 1, 1, 40.0, 100.0, 560.0, 150.0, prose), (1, 1, 2, 40.0, 160.0, 560.0, 170.0, "short"), (1, 1, 3, 40.0, 600.0, 560.0, 612.0, "Figure 1. A map"), (1, 2, 4, 40.0, 60.0, 560.0, 72.0, "Figure 2. B")], BOX + ", text string")
    caps = blocks.where("id >= 3")
    got = rows(regions.fallback_regions(regions.caption_columns(caps, blocks, page), blocks, page))
    assert got == [(1, 1, 3, 34.0, 156.0, 566.0, 596.0), (1, 2, 4, 34.0, 76.0, 566.0, 764.0)]
