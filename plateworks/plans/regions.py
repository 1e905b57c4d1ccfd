"""Queries of regions on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixtures
from plateworks.functions import rects, text
from plateworks.functions.rects import Rect
from plateworks.operators import matching as m
from plateworks.operators import regions as g
from plateworks.plans import pages
from plateworks.runtime import table

W_, H_ = fixtures.PAGE_WIDTH, fixtures.PAGE_HEIGHT


def _sheet() -> Rect:
    """The page."""
    return Rect(*[F.lit(v) for v in (0.0, 0.0, W_, H_)])


def raster_blocks(spark, sf_dir):
    """Blocks of odd ids as rasters, those of even ids, moved down, as placements."""
    images = fixtures.images(spark, sf_dir)
    moved = images.where("id % 2 = 0").withColumn("y0", F.col("y0") + 90).withColumn("y1", F.col("y1") + 90)
    return g.raster_blocks(images.where("id % 2 = 1"), moved, _sheet())


def size_gates(spark, sf_dir):
    """blocks large enough for a figure, or small by the caption of a scheme."""
    return g.size_gate(*fixtures.pages(spark, sf_dir))


def free_candidates(spark, sf_dir):
    """The images above captions that no other caption owns or has reserved."""
    images, captions = fixtures.pages(spark, sf_dir)
    return g.free_candidates(m.caption_above(images, captions), images, captions)


def clipped_figures(spark, sf_dir):
    """blocks cut by the lower page edge."""
    images = fixtures.images(spark, sf_dir).withColumn("y1", F.col("y1") + 60)
    return g.clipped_by_page(images.withColumn("y1", F.least("y1", F.lit(H_))).withColumn("y0", F.least("y0", F.lit(H_ - 1))), images, _sheet())


def accepted_regions(spark, sf_dir):
    """Blocks accepted in order, unless an accepted one shows the same region."""
    return g.accept_in_order(fixtures.images(spark, sf_dir))


def next_page_markers(spark, sf_dir):
    """pages that say their caption is on the next one; every seventh line of a page ends so here."""
    lines = fixtures.lines(spark, sf_dir)
    return g.next_page_markers(lines.withColumn("text", F.when(F.col("id") % 7 == 3, F.concat("text", F.lit(" (Caption  on next page)"))).otherwise(F.col("text"))))


def _words(spark, sf_dir):
    """Words on pages: the letters A to D at the corners of blocks."""
    n = F.col("id") % 4
    return fixtures.images(spark, sf_dir).select(
        "doc", "page", "id", F.concat(F.lit("("), F.char(F.lit(65) + n), F.lit(")")).alias("text"), (F.lit(6.0) + n).alias("size"),
        (F.col("x0") + 4).alias("x0"), (F.col("y0") + 4).alias("y0"), (F.col("x0") + 12).alias("x1"), (F.col("y0") + 14).alias("y1"),
    )


def words_in_regions(spark, sf_dir):
    """How many words lie in each block."""
    return g.words_in(fixtures.images(spark, sf_dir), _words(spark, sf_dir)).groupBy("doc", "page", "id").agg(F.count("*").alias("words"), F.min("text").alias("first"))


def native_labels(spark, sf_dir):
    """The letters A and B found as words of each block, in pixels."""
    return g.native_labels(fixtures.images(spark, sf_dir).withColumn("expected", F.array(F.lit("a"), F.lit("B"))), _words(spark, sf_dir))


def native_evidence(spark, sf_dir):
    """Letters of glyphs confirmed by words near them."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("key"), F.char(F.lit(65) + n % 3).alias("letter"), (n % 97).cast("double").alias("x"), (n % 89).cast("double").alias("y"),
        F.lit(8.0).alias("w"), F.lit(10.0).alias("h"), (n % 40).cast("double").alias("unit"),
    )
    native = e.select(F.col("user_id").alias("key")).distinct().select("key", F.lit("b").alias("label"), F.lit(40.0).alias("x"), F.lit(40.0).alias("y"))
    return g.native_evidence(rows, native).groupBy("key", "source").agg(F.count("*").alias("labels"), F.min("native_distance").alias("nearest"))


def block_relations(spark, sf_dir):
    """Pairs of blocks above a caption: the gap between them, direction, page share, rank of merging."""
    images, captions = fixtures.pages(spark, sf_dir)
    a, b, c = Rect.of("a", "_"), Rect.of("b", "_"), Rect.of("c", "_")
    pairs = m.near_pairs(m.tagged(images, "a"), m.tagged(images, "b"), F.col("a_id") < F.col("b_id"), (30.0, 60.0))
    near = pairs.join(m.tagged(captions, "c").where("c_id = 1"), ["doc", "page"])
    gap, cut, rank = rects.gap_rect(a, b), rects.clip(b, a), g.merge_rank(a, b, c, W_, H_)
    return near.select(
        "doc", "page", "a_id", "b_id", rects.same_side(c, a, b).alias("same_side"), rects.background_penalty(rects.union(a, b), _sheet()).alias("penalty"),
        rects.almost_equal(a, b, 25.0).alias("alike"), gap.x0.alias("gap_x0"), gap.y1.alias("gap_y1"), (cut.x1 - cut.x0).alias("cut_width"),
        rank["gap"].alias("rank_gap"), rank["off"].alias("rank_off"),
    )


def _columns(spark, sf_dir):
    """Lines of documents in two columns, odd documents only; and their captions."""
    lines = fixtures.lines(spark, sf_dir)
    right = F.when((F.col("doc") % 2 == 1) & (F.col("id") % 2 == 1), 260.0).otherwise(0.0)
    two = lines.withColumn("x0", F.col("x0") - 30 + right).withColumn("x1", F.least(F.col("x1"), F.lit(320.0)) - 30 + right)
    return two, two.where(text.caption_parts(text.clean_text(F.col("text")))["is_caption"])


def caption_columns(spark, sf_dir):
    """The column of each caption."""
    lines, caps = _columns(spark, sf_dir)
    return g.caption_columns(caps, lines, _sheet()).select("doc", "page", "id", "left", "right")


def fallback_regions(spark, sf_dir):
    """Where the figure of a caption must be if nothing is drawn."""
    lines, caps = _columns(spark, sf_dir)
    return g.fallback_regions(g.caption_columns(caps, lines, _sheet()), lines, _sheet())


def grown_regions(spark, sf_dir):
    """Blocks grown by words, lines and drawings just outside."""
    images, captions = fixtures.pages(spark, sf_dir)
    n = F.col("id") % 3
    marks = images.withColumn("kind", F.when(n == 0, "label").when(n == 1, "text").otherwise("drawing"))
    marks = marks.withColumn("x0", F.col("x0") - 18).withColumn("x1", F.col("x0") + 30).withColumn("y0", F.col("y0") - 15).withColumn("y1", F.col("y0") + 12)
    return g.grow_regions(images, captions, marks, (0.0, 0.0, W_, H_))


QUERIES = {f.__name__: f for f in (
    raster_blocks, size_gates, free_candidates, clipped_figures, accepted_regions, next_page_markers, words_in_regions, native_labels, native_evidence, block_relations,
    caption_columns, fallback_regions, grown_regions,
)}

_FX = fixtures.SQL
_ON = "a.doc = b.doc AND a.page = b.page"
_I = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_XO = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0))"
_YO = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))"
_GX, _GY = "greatest(0, b.x0 - a.x1, a.x0 - b.x1)", "greatest(0, b.y0 - a.y1, a.y0 - b.y1)"
_WORDS = """w AS (SELECT doc, page, id, '(' || chr(CAST(65 + id % 4 AS INT)) || ')' AS text, 6 + id % 4 AS size, x0 + 4 AS x0, y0 + 4 AS y0, x0 + 12 AS x1, y0 + 14 AS y1 FROM img),
i AS (SELECT a.doc, a.page, a.id, b.id AS word_id, b.text, b.size, a.x0 AS ax, a.y0 AS ay, b.x0, b.y0 FROM img a JOIN w b ON a.doc = b.doc AND a.page = b.page
  AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1)"""
_RATIO = "least({0}, {1}) / greatest(1, {0}, {1})"
_WR, _HR = _RATIO.format("(a.x1 - a.x0)", "(b.x1 - b.x0)"), _RATIO.format("(a.y1 - a.y0)", "(b.y1 - b.y0)")
_NARROW, _WIDE = "least(a.x1 - a.x0, b.x1 - b.x0)", "greatest(a.x1 - a.x0, b.x1 - b.x0)"
_DX, _DY = "abs(a.x0 + a.x1 - b.x0 - b.x1) / 2", "abs(a.y0 + a.y1 - b.y0 - b.y1) / 2"
_SIDE = """CASE WHEN c.y0 >= a.y1 - 8 THEN b.y1 <= c.y0 + 2 WHEN c.y1 <= a.y0 + 8 THEN b.y0 >= c.y1 - 2 WHEN c.x0 >= a.x1 - 8 THEN b.x1 <= c.x0 + 2
  WHEN c.x1 <= a.x0 + 8 THEN b.x0 >= c.x1 - 2 ELSE true END"""
_SHARE = f"(greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) / {W_ * H_}"
_ACCEPTED = """o AS (
  SELECT a.doc, a.page, a.id AS a_id, b.id AS b_id, {0} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS p, (b.x1 - b.x0) * (b.y1 - b.y0) AS q FROM img a JOIN img b ON {1} AND a.id < b.id),
x AS (SELECT doc, page, a_id, b_id FROM o WHERE i > 0 AND (i / greatest(1, p + q - i) >= 0.80 OR i / greatest(1, least(p, q)) >= 0.92)),
l AS (SELECT doc, page, b_id AS id, list(a_id ORDER BY a_id) AS before FROM x GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY id) AS k FROM l),
walk AS (
  SELECT doc, page, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS refused, CAST(NULL AS INT) AS id, CAST(NULL AS INT) AS conflict FROM (SELECT DISTINCT doc, page FROM n)
  UNION ALL
  SELECT w.doc, w.page, n.k, CASE WHEN len(list_filter(n.before, lambda z: NOT list_contains(w.refused, CAST(z AS INT)))) > 0 THEN list_append(w.refused, CAST(n.id AS INT)) ELSE w.refused END,
    CAST(n.id AS INT), CAST(list_filter(n.before, lambda z: NOT list_contains(w.refused, CAST(z AS INT)))[1] AS INT)
  FROM walk w JOIN n ON n.doc = w.doc AND n.page = w.page AND n.k = w.k + 1)""".format(_I, _ON)

SQL = {
    "size_gates": f"""WITH {_FX}, s AS (SELECT * FROM cap WHERE kind = 'scheme'),
m AS (SELECT DISTINCT a.doc, a.page, a.id FROM img a JOIN s b ON {_ON} WHERE a.x1 - a.x0 >= 96 AND a.y1 - a.y0 >= 54 AND (a.x1 - a.x0) * (a.y1 - a.y0) >= 2851.2
  AND ((({_XO} >= 0.28 OR {_DX} <= greatest(42, 0.32 * {_WIDE})) AND {_GY} <= greatest(300, 2.5 * (a.y1 - a.y0))) OR ({_YO} >= 0.42 AND {_GX} <= 48)))
SELECT img.doc, img.page, img.id, x1 - x0 >= 180 AND y1 - y0 >= 120 AS ordinary, m.id IS NOT NULL AS compact FROM img LEFT JOIN m USING (doc, page, id)
WHERE (x1 - x0 >= 180 AND y1 - y0 >= 120) OR m.id IS NOT NULL""",
    "clipped_figures": f"""WITH {_FX}, p AS (SELECT doc, page, id, x0, y0, x1, y1 + 60 AS y1 FROM img),
a AS (SELECT doc, page, id, x0, least(y0, {H_ - 1}) AS y0, x1, least(y1, {H_}) AS y1 FROM p),
b AS (SELECT doc, page, x0, y0, least(x1, {W_}) AS x1, {H_} AS y1 FROM p WHERE y1 > {H_} + 2 AND y0 < {H_}),
m AS (SELECT DISTINCT a.doc, a.page, a.id FROM a JOIN b ON {_ON} WHERE a.y1 >= {H_} - 3 AND {_I} >= 0.70 * (b.x1 - b.x0) * (b.y1 - b.y0))
SELECT a.doc, a.page, a.id, m.id IS NOT NULL AS clipped FROM a LEFT JOIN m USING (doc, page, id)""",
    "accepted_regions": f"""WITH RECURSIVE {_FX}, {_ACCEPTED}
SELECT img.doc, img.page, img.id, walk.conflict FROM img LEFT JOIN walk ON walk.doc = img.doc AND walk.page = img.page AND walk.id = img.id""",
    "words_in_regions": f"WITH {_FX}, {_WORDS} SELECT doc, page, id, count(*) AS words, min(text) AS first FROM i GROUP BY 1, 2, 3",
    "native_labels": f"""WITH {_FX}, {_WORDS}
SELECT doc, page, id, substr(text, 2, 1) AS label, (x0 + 4 - ax) * 300 / 72.0::DOUBLE AS x, (y0 + 5 - ay) * 300 / 72.0::DOUBLE AS y FROM i WHERE text IN ('(A)', '(B)')
QUALIFY row_number() OVER (PARTITION BY doc, page, id, text ORDER BY size DESC, y0, x0, word_id) = 1""",
    "native_evidence": """WITH e AS (SELECT user_id AS key, event_id % 3 AS l, sqrt(power(event_id % 97 + 4.0::DOUBLE - 40, 2) + power(event_id % 89 + 5.0::DOUBLE - 40, 2)) AS d, event_id % 40 AS unit FROM events),
f AS (SELECT key, l = 1 AND d <= greatest(24, unit) AS near, d FROM e)
SELECT key, CASE WHEN near THEN 'pdf_text+cv' ELSE 'cv' END AS source, count(*) AS labels, min(CASE WHEN near THEN d END) AS nearest FROM f GROUP BY 1, 2""",
    "block_relations": f"""WITH {_FX} SELECT a.doc, a.page, a.id AS a_id, b.id AS b_id, {_SIDE} AS same_side,
  CASE WHEN {_SHARE} >= 0.90 THEN 10.0 WHEN {_SHARE} >= 0.76 AND greatest(abs(least(a.x0, b.x0)), abs(least(a.y0, b.y0)), abs(greatest(a.x1, b.x1) - {W_}), abs(greatest(a.y1, b.y1) - {H_})) <= 8 THEN 7.0
    WHEN {_SHARE} >= 0.72 THEN 3.0 ELSE 0.0 END AS penalty,
  greatest(abs(a.x0 - b.x0), abs(a.y0 - b.y0), abs(a.x1 - b.x1), abs(a.y1 - b.y1)) <= 25 AS alike,
  CASE WHEN a.y1 <= b.y0 OR b.y1 <= a.y0 THEN greatest(a.x0, b.x0) WHEN a.x1 <= b.x0 THEN a.x1 WHEN b.x1 <= a.x0 THEN b.x1 ELSE 0 END AS gap_x0,
  CASE WHEN a.y1 <= b.y0 THEN b.y0 WHEN b.y1 <= a.y0 THEN a.y0 WHEN a.x1 <= b.x0 OR b.x1 <= a.x0 THEN least(a.y1, b.y1) ELSE 0 END AS gap_y1,
  least(a.x1, b.x1) - greatest(a.x0, b.x0) AS cut_width,
  CASE WHEN {_SIDE} THEN CASE WHEN {_XO} >= 0.62 AND {_WR} >= 0.52 AND {_GY} <= greatest(34, least(240, 20 + CASE WHEN {_XO} >= 0.80 AND {_WR} >= 0.68 AND {_DX} <= greatest(22, 0.11 * {_WIDE}) THEN 0.48 ELSE 0.24 END * {_NARROW}))
    THEN {_GY} WHEN {_YO} >= 0.58 AND {_HR} >= 0.32 AND {_GX} <= greatest(18, least(58, 0.18 * {_NARROW})) THEN {_GX} + 5 END END AS rank_gap,
  CASE WHEN {_SIDE} THEN CASE WHEN {_XO} >= 0.62 AND {_WR} >= 0.52 AND {_GY} <= greatest(34, least(240, 20 + CASE WHEN {_XO} >= 0.80 AND {_WR} >= 0.68 AND {_DX} <= greatest(22, 0.11 * {_WIDE}) THEN 0.48 ELSE 0.24 END * {_NARROW}))
    THEN {_DX} / {W_} WHEN {_YO} >= 0.58 AND {_HR} >= 0.32 AND {_GX} <= greatest(18, least(58, 0.18 * {_NARROW})) THEN {_DY} / {H_} END END AS rank_off
FROM img a JOIN img b ON {_ON} AND a.id < b.id JOIN cap c ON c.doc = a.doc AND c.page = a.page AND c.id = 1
WHERE floor((a.x0 - 30) / 200) <= floor(b.x1 / 200) AND floor((a.x1 + 30) / 200) >= floor(b.x0 / 200) AND floor((a.y0 - 60) / 200) <= floor(b.y1 / 200) AND floor((a.y1 + 60) / 200) >= floor(b.y0 / 200)""",
    "caption_columns": """WITH s AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc, CAST(n // 50 + 1 AS INT) AS page, CAST(n % 50 AS INT) AS id, trim(regexp_replace(t, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ' ', 'g')) AS c,
  CASE WHEN doc % 2 = 1 AND n % 50 % 2 = 1 THEN 300 ELSE 40 END AS x0, CASE WHEN doc % 2 = 1 AND n % 50 % 2 = 1 THEN 260 ELSE 0 END + least(70 + least(length(t), 90) * 5, 320) - 30 AS x1 FROM s WHERE trim(t, ' ') <> ''),
p AS (SELECT doc, page, CASE WHEN (x0 + x1) / 2 <= 297.5 - 41.65 THEN 0 WHEN (x0 + x1) / 2 >= 297.5 + 41.65 THEN 1 END AS half, x0, x1 FROM l WHERE length(c) >= 85 AND len(string_split(c, ' ')) >= 12 AND x1 - x0 BETWEEN 119 AND 368.9),
h AS (SELECT doc, page, count(*) FILTER (half = 0) AS n0, count(*) FILTER (half = 1) AS n1, min(x0) FILTER (half = 0) AS a0, max(x1) FILTER (half = 0) AS b0, min(x0) FILTER (half = 1) AS a1, max(x1) FILTER (half = 1) AS b1 FROM p GROUP BY 1, 2),
k AS (SELECT l.*, n0, n1, a0, b0, a1, b1, x1 - x0 >= 309.4 OR NOT coalesce(n0 >= 2 AND n1 >= 2, false) AS whole, (x0 + x1) / 2 < 297.5 AS near FROM l LEFT JOIN h USING (doc, page)
  WHERE regexp_matches(c, '(?is)^((?:fig(?:ure)?\\.?|图|(?:reaction\\s+)?(?:schemes?|sch)\\.?))\\s*((?:[A-Za-z]?[0-9]+[A-Za-z0-9-]*(?:\\.[0-9]+[A-Za-z0-9-]*)*))'))
SELECT doc, page, id, CAST(CASE WHEN whole THEN 34 ELSE greatest(24, CASE WHEN near THEN a0 ELSE a1 END - 8) END AS DOUBLE) AS "left", CAST(CASE WHEN whole THEN 561 ELSE least(571, CASE WHEN near THEN b0 ELSE b1 END + 8) END AS DOUBLE) AS "right" FROM k""",
    "next_page_markers": """WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc, CAST(n // 50 + 1 AS INT) AS page FROM l WHERE trim(t, ' ') <> '' AND n % 50 % 7 = 3""",
}
_PAIRS, _ROWS = (f"SELECT * FROM ({q})" for q in (pages.SQL["caption_above"], pages.SQL["caption_rows"]))
SQL["free_candidates"] = f"""WITH {_FX}, pr AS ({_PAIRS}), rw AS ({_ROWS}),
ow AS (SELECT DISTINCT a.doc, a.page, a.id AS image_id, b.kind, b.number FROM img a JOIN cap b ON {_ON} AND b.y0 - a.y1 BETWEEN -10 AND 72 AND {_XO} >= 0.48)
SELECT pr.* FROM pr JOIN cap c ON c.doc = pr.doc AND c.page = pr.page AND c.id = pr.caption_id
WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.doc = pr.doc AND ow.page = pr.page AND ow.image_id = pr.image_id AND (ow.kind <> c.kind OR ow.number <> c.number))
  AND NOT EXISTS (SELECT 1 FROM rw JOIN cap d ON d.doc = rw.doc AND d.page = rw.page AND d.id = rw.caption_id
    WHERE rw.doc = pr.doc AND rw.page = pr.page AND rw.image_id = pr.image_id AND (d.kind <> c.kind OR d.number <> c.number))"""
