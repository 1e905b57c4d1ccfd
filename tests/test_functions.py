import pytest
from pyspark.sql import functions as F

from plateworks.functions import notation, text
from plateworks.functions.rects import Rect, coverage, gap_rect, in_page, iou, smaller_coverage


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


CASES = [
    ("Figure 1. (A) one (B) two", "AB"), ("Fig. 2 (a, b) x (c-d) y", "abcd"), ("Figure 3. (A–C) three", "ABC"), ("Fig. a) one b) two", "ab"),
    ("Fig. 1 panels A-D show", "ABCD"), ("Fig. 1. A TEM. B DLS. C SEM.", "ABC"), ("Fig (n=3) and author(s)", ""), ("Figure (A) x (B) y (c) z", "ABC"),
    ("panel B alone", "B"), (None, ""), ("Fig 1. single panel.", ""), ("Fig. (A, B, and D)", ""), ("Fig. 1. B, C images. A one. D two", "ABCD"), ("", ""),
]


def test_expected_labels(spark):
    df = text.with_expected_labels(spark.createDataFrame(CASES, "caption string, want string"))
    assert [("".join(r.labels), r.caption) for r in df.collect()] == [(w, c) for c, w in CASES]


def test_formal_captions(spark):
    cases = {
        "Figure 3B shows cells": False, "Figure 3B. Description": True, "Figure 1 Description of things": True, "Figure 2 shows the map of": False,
        "Fig. 4: two": True, "Fig. 4 two words": False, "Scheme 1. Route": True, "图 3：样品 的": True, "See Figure 1. x": False, "Figure 7.": False,
    }
    got = dict(values(spark, [(c,) for c in cases], "c string", "c", text.is_formal_caption(F.col("c"))))
    assert got == cases


def test_names(spark):
    cases = [("a b/c:d?.pdf", "a_b_c_d_.pdf"), (None, "item"), ("  ._ ", "item"), ("x y", "x_y")]
    assert values(spark, [(c,) for c, _ in cases], "c string", text.sanitize_name(F.col("c"))) == [(w,) for _, w in cases]
    long = "n" * 60
    (slug,), = values(spark, [(long,)], "c string", text.document_slug(F.col("c")))
    assert len(slug) == 48 and slug.startswith("n" * 39 + "_")


def test_page_selector(spark):
    assert values(spark, [("1,3-5, 4",), (None,)], "s string", text.page_numbers(F.col("s"))) == [([1, 3, 4, 5],), (None,)]
    for bad in ("5-3", "0", "x", "1-2-3", ""):
        with pytest.raises(Exception, match="bad page selector"):
            values(spark, [(bad,)], "s string", text.page_numbers(F.col("s")))


def test_styles_headings_and_labels(spark):
    s = lambda *a: text.style_compatible(*map(F.lit, a))
    got = values(spark, [(1,)], "i int", s(9.0, "ABC+Times-Bold", 10.0, "Times"), s(9.0, "Times", 11.0, "Times"), s(9.0, "Times", 9.8, "Arial"), s(9.0, "Times", 9.4, "Arial"))
    assert got == [(True, False, False, True)]
    heads = [("1.2 Methods", True), ("RESULTS", True), ("A normal line", False), ("123", False), (None, False)]
    assert [r[0] for r in values(spark, heads, "t string, w boolean", text.looks_like_heading(F.col("t")))] == [w for _, w in heads]
    marks = [("(B)", True), ("c2", True), ("12.5%", True), ("text", False), ("", False)]
    assert [r[0] for r in values(spark, marks, "t string, w boolean", text.is_native_label(F.col("t"), F.array(F.lit("A"))))] == [w for _, w in marks]


def test_notations(spark):
    h = "ab" * 32
    ids = [f"paper_{h}", f" SHA256:{h.upper()}\n", h, f"source-{h}.pdf", f"paper:{h}", h[:-1], None, f"job_{h[:32]}"]
    assert [r[0] for r in values(spark, [(i,) for i in ids], "c string", notation.hex_id(F.col("c"), 64))] == [h] * 5 + [None] * 3
    times = ["2025-03-03T05:00:00.000001Z", "2025-03-03 05:00:00.000001+00:00", "2025-03-02T23:30:00.000001-05:30", "2025-03-03T05:00:00.000001", "soon", None]
    got = [r[0] for r in values(spark, [(t,) for t in times], "c string", notation.instant(F.col("c")))]
    assert got == [1740978000000001] * 4 + [None] * 2


def test_rectangles(spark):
    a, b = Rect.of("a"), Rect.of("b")
    data = [(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 4.0, 4.0, 10.0, 0.0, 12.0, 4.0)]
    schema = ", ".join(f"{r}{c} double" for r in "ab" for c in ("x0", "y0", "x1", "y1"))
    g = gap_rect(a, b)
    got = values(spark, data, schema, iou(a, b), iou(b, a), coverage(a, b), smaller_coverage(a, b), g.x0, g.x1, in_page(a, F.lit(10), F.lit(9)))
    assert got[0] == (25 / 175, 25 / 175, 0.25, 0.25, 0.0, 0.0, False)
    assert got[1][:4] == (0.0, 0.0, 0.0, 0.0) and got[1][4:6] == (4.0, 10.0) and got[1][6]
