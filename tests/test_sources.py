import json
import struct

from plateworks.sources import files, pages, sinks


def test_folders(spark, tmp_path):
    for p in ("root.pdf", "group-a/nested.pdf", "group-a/day-1/two.pdf", "group-a/note.txt", "Up.PDF"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"%PDF-1.7\n")
    flat = files.pdf_folder(spark, str(tmp_path)).collect()
    assert [(r.item_id, r.filename, r.size_bytes) for r in flat] == [("i000001", "root.pdf", 9)]
    assert files.pdf_folder(spark, str(tmp_path), True).count() == 3
    counts = {r.folder.split("/")[-1]: r.files for r in files.folder_counts(spark, str(tmp_path)).collect()}
    assert counts == {tmp_path.name: 1, "group-a": 1, "day-1": 1}
    up = spark.createDataFrame([("a.pdf", 9), ("b.txt", 9), ("c.pdf", 0), ("d.PDF", 2**40)], "filename string, length long")
    assert [r.refused for r in files.upload_check(up).collect()] == [None, "not a PDF", "empty", "too large"]


def test_images_are_blue_green_red(spark, tmp_path):
    px = bytes((50, 100, 200)) * 2 + b"\0\0"  # one row of two pixels, padded to four bytes
    head = b"BM" + struct.pack("<IHHI", 54 + len(px), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(px), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + px)
    r = files.images(spark, str(tmp_path)).first()
    assert (r.width, r.height, list(r.data)[:3]) == (2, 1, [50, 100, 200])


def test_states_and_manifests(spark, tmp_path):
    state = {"job_id": None, "figures": {"r001": {"annotation_mode": "odd", "panels": {"A": {"label": "A", "current_version": 0}}}}}
    (tmp_path / "job1").mkdir()
    (tmp_path / "job1" / "editor_state.json").write_text(json.dumps(state))
    r = files.editor_figures(files.json_states(spark, f"{tmp_path}/*/editor_state.json")).first()
    assert (r.job, r.record, r.review_status, r.annotation_mode, r.annotation_complete, r.annotation_version) == ("job1", "r001", "proposed", "panel_boxes", False, 0)
    (tmp_path / "m.json").write_text(json.dumps({"document_name": "d", "figures": [{"figure_id": "f", "panels": [{"label": "B"}], "expected_panel_labels": ["A"]}]}))
    m = files.manifest_figures(files.json_states(spark, f"{tmp_path}/m.json", files.MANIFEST)).first()
    assert (m.figure_id, m.panel_count, m.labels) == ("f", 1, ["A", "B"])


def test_page_objects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"pdf": "a", "page_number": 1, "kind": "text", "text": "x", "x0": 1.0}\nbad\n')
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7\n")
    pages.register(spark)
    got = spark.read.format("page_objects").load(str(tmp_path)).collect()
    assert sorted((r.pdf, r.page_number, r.error is not None) for r in got if r.page_number) == [("a", 1, False)] and len(got) == 3


def test_ocr_and_sinks(spark, tmp_path):
    from plateworks.operators.panels import ocr_words

    (tmp_path / "o.tsv").write_text("level\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t2\t3\t4\t90\tword\n5\t1\t2\t3\t4\t10\tweak\n5\t1\t2\t3\t4\t-1\tkept\n5\t1\t2\t0\t4\t90\tflat\n5\t1\n5\t1\t2\t3\t4\tx\tbad\n5\t1\t2\t3\t4\t90\t--\n")
    lines, header = files.ocr_lines(spark, str(tmp_path / "o.tsv"))
    assert sorted(r.text for r in ocr_words(lines, header).collect()) == ["kept", "word"]
    labels = spark.createDataFrame([("s1", "0 1\n"), ("s2", ""), ("s1", "0 1\n")], "sample_id string, label_text string")
    assert sinks.write_labels(labels, str(tmp_path / "labels")) == 2
    assert (tmp_path / "labels" / "s1.txt").read_text() == "0 1\n" and (tmp_path / "labels" / "s2.txt").read_text() == ""
    sinks.write_jsonl(labels, str(tmp_path / "j"), ["sample_id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 3
