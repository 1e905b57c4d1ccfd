from conftest import rows

from plateworks.operators import captions as c

BLOCK = "doc int, page int, id int, text string, x0 double, y0 double, x1 double, y1 double"


def line(page, i, text, y, x=70.0, wide=400.0):
    return (1, page, i, text, x, float(y), x + wide, float(y + 12))


def test_blocks_merge_until_something_else_begins(spark):
    data = [
        line(1, 1, "Figure 1. A map of", 100), line(1, 2, "the surface and", 114), line(1, 3, "RESULTS", 128), line(1, 4, "of cells.", 142),
        line(1, 5, "Figure 2. Second", 300), line(1, 6, "far away", 400), line(1, 7, "Figure 3. Third.", 500), line(1, 8, "aside", 514, 480.0, 60.0), line(1, 9, None, 600),
        line(2, 1, "Figure 4. Done.", 100), line(2, 2, "A paragraph of many words that follows " * 4, 114),
    ]
    got = {(r.page, r.id): (r.blocks, r.text) for r in c.merge_blocks(spark.createDataFrame(data, BLOCK)).collect()}
    assert got == {(1, 1): (2, "Figure 1. A map of the surface and"), (1, 5): (1, "Figure 2. Second"), (1, 7): (1, "Figure 3. Third."), (2, 1): (1, "Figure 4. Done.")}
    assert c.merge_blocks(spark.createDataFrame([], BLOCK)).count() == 0


def test_captions_go_on_at_the_next_page(spark):
    caps = spark.createDataFrame([line(1, 5, "Figure 2. Two coloured panels that", 820)], BLOCK)
    first, rival = line(2, 1, "show the same sample.", 30), line(2, 2, "show another sample.", 30)
    assert rows(c.continuations(caps, spark.createDataFrame([first], BLOCK), 842.0, 595.0)) == [(1, 1, 5, 1)]
    assert c.continuations(caps, spark.createDataFrame([first, rival], BLOCK), 842.0, 595.0).count() == 0
    head = line(2, 1, "Results", 30)
    assert c.continuations(caps, spark.createDataFrame([head], BLOCK), 842.0, 595.0).count() == 0


def test_one_line_with_two_captions(spark):
    df = spark.createDataFrame([(1, "Fig. 1. Left one Fig. 2. Right", 0.0, 300.0), (2, "See Fig. 3. x", 0.0, 9.0), (3, None, 0.0, 9.0)], "key long, text string, x0 double, x1 double")
    got = [(r.key, r.part, r.number, r.caption, r.x0) for r in c.split_captions(spark, df).orderBy("part").collect()]
    assert got == [(1, 1, "1", "Fig. 1. Left one", 0.0), (1, 2, "2", "Fig. 2. Right", 170.0)]


def test_figures_grow_by_near_blocks(spark):
    box = "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([(1, 1, 1, 0.0, 100.0, 100.0, 200.0), (1, 1, 2, 110.0, 100.0, 200.0, 200.0), (1, 1, 3, 0.0, 10.0, 200.0, 90.0), (1, 1, 4, 0.0, 230.0, 200.0, 300.0), (1, 1, 5, 400.0, 100.0, 500.0, 200.0)], box)
    captions = spark.createDataFrame([(1, 1, 1, 0.0, 205.0, 200.0, 215.0)], box)
    assert rows(c.grow_figures(images, captions)) == [(1, 1, 1, [1, 2, 3], 0.0, 10.0, 200.0, 200.0)]


def test_query_reads_the_lines_of_all_documents(spark, tmp_path):
    from plateworks.plans import documents

    line = "Fig. 1. Left one Fig. 2. Right"
    docs = [(1, line, "caption_sheet"), (2, f"A page.\n{line}\nFig. 3. More", "page_text"), (3, line, "review_note"), (4, line, None), (5, None, "guide"), (6, "See Fig. 3. x", "outreach")]
    spark.createDataFrame(docs, "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(documents.split_captions(spark, str(tmp_path))) == [(1, 2, 2), (2, 3, 2), (3, 2, 2), (4, 2, 2)]


def test_print_of_another_size_or_font_ends_a_caption(spark):
    styled = BLOCK + ", size double, font string"
    data = [
        (*line(1, 1, "Figure 1. A map of", 100), 9.0, "AB+Serif-Bold"), (*line(1, 2, "the surface", 114), 9.5, "Serif"), (*line(1, 3, "of cells", 128), 9.9, "Sans"), (*line(1, 4, "and more", 142), 12.0, "Serif"),
        (*line(2, 1, "Figure 2. A map", 100), 9.0, None), (*line(2, 2, "of cells.", 114), None, "Sans"),
    ]
    got = {(r.page, r.id): r.blocks for r in c.merge_blocks(spark.createDataFrame(data, styled)).collect()}
    assert got == {(1, 1): 2, (2, 1): 2}
    caps = spark.createDataFrame([(*line(1, 5, "Figure 2. Two coloured panels that", 820), 9.0, "Serif")], styled)
    for size, n in ((9.2, 1), (14.0, 0), (None, 1)):
        follow = spark.createDataFrame([(*line(2, 1, "show the same sample.", 30), size, "Serif")], styled)
        assert c.continuations(caps, follow, 842.0, 595.0).count() == n
