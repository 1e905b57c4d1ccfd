import random

from conftest import rows

from plateworks.functions.rects import Rect, intersection_area
from plateworks.operators import matching as m

BOX = "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, hot=0):
    r = random.Random(seed)
    out = []
    for i in range(n + hot):
        x, y = r.randint(0, 500), r.randint(0, 700)
        page = (1, 1) if i >= n else (r.randint(1, 2), r.randint(1, 4))
        out.append((*page, i, float(x), float(y), float(x + r.randint(5, 250)), float(y + r.randint(5, 250))))
    return out


def area(a, b):
    return max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))


def test_grid_join_equals_nested_loop(spark):
    data = boxes(1, 80, 40)  # a third of the boxes is on one page
    df = spark.createDataFrame(data, BOX)
    got = {tuple(r) for r in m.overlaps(df).select("doc", "page", "a_id", "b_id").collect()}
    want = {(a[0], a[1], a[2], b[2]) for a in data for b in data if a[:2] == b[:2] and a[2] < b[2] and area(a, b) > 0}
    assert got == want and m.overlaps(df).count() == len(want)
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    near = m.near_pairs(m.tagged(df, "a"), m.tagged(df, "b"), (b.y0 - a.y1).between(0, 90) & (intersection_area(a, b) == 0) & (b.x0 < a.x1 + 90) & (a.x0 < b.x1 + 90), 90)
    want = sum(0 <= q[4] - p[6] <= 90 and q[3] < p[5] + 90 and p[3] < q[5] + 90 for p in data for q in data if p[:2] == q[:2])
    assert near.count() == want


def test_captions_take_images_once(spark):
    images = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 0.0, 0.0, 100.0, 90.0), (1, 2, 3, 0.0, 0.0, 100.0, 90.0)], BOX)
    captions = spark.createDataFrame([(1, 1, 1, 0.0, 102.0, 100.0, 110.0), (1, 1, 2, 0.0, 104.0, 100.0, 112.0), (1, 1, 3, 0.0, 120.0, 100.0, 130.0)], BOX)
    assert rows(m.caption_above(images, captions)) == [(1, 1, 1, 1), (1, 1, 2, 1), (1, 1, 3, 1)]
    assert rows(m.consume_once(images, captions)) == [(1, 1, 1, 1), (1, 1, 2, 2)]


def test_layers_fold_into_the_first_that_fits(spark):
    images = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 1.0, 1.0, 101.0, 101.0), (1, 1, 3, 0.0, 2.0, 20.0, 20.0), (1, 1, 4, 300.0, 0.0, 320.0, 9.0)], BOX
    )
    got = {tuple(sorted(r.members)): (r.x0, r.y0, r.x1, r.y1) for r in m.merge_layers(images).collect()}
    assert got == {(1, 2): (0.0, 0.0, 101.0, 101.0), (3,): (0.0, 2.0, 20.0, 20.0), (4,): (300.0, 0.0, 320.0, 9.0)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], BOX)
    for df in (m.overlaps(e), m.caption_owner(e, e), m.neighbors(e, e), m.clusters(e, m.neighbors(e, e)), m.caption_above(e, e), m.caption_beside(e, e), m.row_match(e, e), m.consume_once(e, e), m.merge_layers(e)):
        assert df.count() == 0


def test_rival_blocks_the_best(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 4.5), (2, "a", 5.0), (2, "b", 3.0), (3, "a", 1.0)], "k int, n string, score double")
    assert rows(m.unless_rival(df, ["k"], "score", 1.0, ["n"]).select("k", "n")) == [(2, "a"), (3, "a")]
