"""Queries of captions, image blocks and text blocks on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixtures
from plateworks.functions import text
from plateworks.operators import matching as m

W_, H_ = fixtures.PAGE_WIDTH, fixtures.PAGE_HEIGHT


def rect_overlaps(spark, sf_dir):
    """Overlapping image blocks."""
    return m.overlaps(fixtures.images(spark, sf_dir))


def region_conflicts(spark, sf_dir):
    """Blocks that show the same region."""
    return m.conflicts(m.overlaps(fixtures.images(spark, sf_dir)))


def caption_owners(spark, sf_dir):
    """The caption that owns an image block."""
    return m.caption_owner(fixtures.images(spark, sf_dir), fixtures.captions(spark, sf_dir))


def block_neighbors(spark, sf_dir):
    """Blocks of one figure."""
    return m.neighbors(*fixtures.pages(spark, sf_dir))


def block_clusters(spark, sf_dir):
    """Connected blocks and their common rectangle."""
    images, captions = fixtures.pages(spark, sf_dir)
    return m.clusters(images, m.neighbors(images, captions))


def caption_above(spark, sf_dir):
    """The image nearest above each caption."""
    return m.caption_above(fixtures.images(spark, sf_dir), fixtures.captions(spark, sf_dir))


def caption_beside(spark, sf_dir):
    """The image beside a caption, unless there is a rival."""
    wide = fixtures.images(spark, sf_dir)
    slim = fixtures.captions(spark, sf_dir).withColumn("x1", F.col("x0") + 90).withColumn("y1", F.col("y0") + 70)
    return m.caption_beside(wide, slim)


def caption_previous_page(spark, sf_dir):
    """The dominant image of the page before a caption."""
    wide = fixtures.images(spark, sf_dir).withColumn("x1", F.col("x1") + 200).withColumn("y1", F.col("y1") + 150)
    return m.previous_page(wide, fixtures.captions(spark, sf_dir), W_, H_)


def caption_rows(spark, sf_dir):
    """Captions side by side matched to images by place."""
    return m.row_match(*fixtures.pages(spark, sf_dir))


def consume_once(spark, sf_dir):
    """R2, F8: captions take images in reading order."""
    return m.consume_once(fixtures.images(spark, sf_dir), fixtures.captions(spark, sf_dir))


def merged_layers(spark, sf_dir):
    """Layers of one picture."""
    return m.merge_layers(fixtures.images(spark, sf_dir)).select("doc", "page", "id", F.size("members").alias("layers"), "x0", "y0", "x1", "y1")


def prose_in_regions(spark, sf_dir):
    """Prose in the upper and the lower half of each page of the documents."""
    lines = fixtures.lines(spark, sf_dir).withColumn("chars", F.length(text.clean_text(F.col("text")))).withColumn("words", text.word_count(F.col("text")))
    low = F.col("id") == 2
    regions = lines.select("doc", "page").distinct().select("doc", "page", F.explode(F.array(F.lit(1), F.lit(2))).alias("id")).select(
        "doc", "page", "id", F.lit(0.0).alias("x0"), F.when(low, 400.0).otherwise(0.0).alias("y0"), F.lit(W_).alias("x1"), F.when(low, H_).otherwise(400.0).alias("y1")
    )
    return m.prose_evidence(regions, lines.select("doc", "page", "id", "chars", "words", "x0", "y0", "x1", "y1"), W_)


def visual_evidence(spark, sf_dir):
    """Images in the corridor above each caption."""
    corridor = fixtures.captions(spark, sf_dir).withColumn("y1", F.col("y0")).withColumn("y0", F.col("y0") - 200).drop("kind")
    return m.visual_evidence(corridor, fixtures.images(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    rect_overlaps, region_conflicts, caption_owners, block_neighbors, block_clusters, caption_above, caption_beside, caption_previous_page,
    caption_rows, consume_once, merged_layers, prose_in_regions, visual_evidence,
)}

_FX = fixtures.SQL
_ON = "a.doc = b.doc AND a.page = b.page"
_I = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_MEET = "least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_AA, _AB = _AREA.format("a"), _AREA.format("b")
_XO = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0))"
_YO = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))"
_PAIRS = f"""pairs AS (
  SELECT a.doc, a.page, a.id AS a_id, b.id AS b_id, {_I} / greatest(1, {_AA} + {_AB} - {_I}) AS iou, {_I} / greatest(1, least({_AA}, {_AB})) AS coverage
  FROM img a JOIN img b ON {_ON} AND a.id < b.id AND {_MEET})"""
_OWNER = f"""owner AS (
  SELECT a.doc, a.page, a.id, arg_min(b.id, {{'g': greatest(0, b.y0 - a.y1), 'o': abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2), 'i': b.id}}) AS owner
  FROM img a JOIN cap b ON {_ON} AND b.y0 - a.y1 BETWEEN -8 AND 80 AND {_XO} >= 0.55 GROUP BY 1, 2, 3)"""
_NEIGHBORS = f"""own AS (SELECT img.*, owner.owner FROM img LEFT JOIN owner USING (doc, page, id)),
g AS (
  SELECT a.doc, a.page, a.id AS a_id, b.id AS b_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
    greatest(0, b.x0 - a.x1, a.x0 - b.x1) AS gx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) AS gy, {_XO} AS xo, {_YO} AS yo,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, {_AA} AS aa, {_AB} AS ab,
    least(a.x1 - a.x0, b.x1 - b.x0) AS w, least(a.y1 - a.y0, b.y1 - b.y0) AS h
  FROM own a JOIN own b ON {_ON} AND a.id < b.id WHERE NOT coalesce(a.owner <> b.owner, false)),
k AS (
  SELECT *, CASE WHEN gx = 0 AND gy = 0 THEN CASE WHEN i / greatest(1, least(aa, ab)) >= 0.90 AND least(aa, ab) / greatest(1, aa, ab) < 0.55 THEN NULL ELSE 'touch' END
    WHEN yo >= 0.55 AND gx <= greatest(10, 0.25 * w) THEN 'row' WHEN xo >= 0.45 AND gy <= greatest(10, 0.20 * h) THEN 'column' END AS kind FROM g),
n AS (
  SELECT doc, page, a_id, b_id FROM k WHERE kind = 'touch'
  UNION ALL SELECT doc, page, a_id, b_id FROM k WHERE kind = 'column' AND NOT EXISTS (
    SELECT 1 FROM cap c WHERE c.doc = k.doc AND c.page = k.page AND CASE WHEN ay0 <= by0 THEN ay1 ELSE by1 END <= greatest(ay0, by0)
      AND c.y0 >= CASE WHEN ay0 <= by0 THEN ay1 ELSE by1 END - 4 AND c.y1 <= greatest(ay0, by0) + 4
      AND greatest(0, least(greatest(ax1, bx1), c.x1) - greatest(least(ax0, bx0), c.x0)) / greatest(1, least(greatest(ax1, bx1) - least(ax0, bx0), c.x1 - c.x0)) >= 0.30)
  UNION ALL SELECT doc, page, a_id, b_id FROM k WHERE kind = 'row' AND NOT (yo >= 0.45 AND greatest(ax0, bx0) >= CASE WHEN ax0 <= bx0 THEN ax1 ELSE bx1 END AND (
    SELECT count(DISTINCT c.kind || c.number) FROM cap c WHERE c.doc = k.doc AND c.page = k.page AND c.y0 - greatest(ay1, by1) BETWEEN -12 AND 105
      AND c.x1 >= least(ax0, bx0) - 24 AND c.x0 <= greatest(ax1, bx1) + 24) >= 2))"""
_ABOVE = f"""near AS (
  SELECT a.doc, a.page, b.id AS caption_id, a.id AS image_id, b.y0 AS cy, b.x0 AS cx, abs(b.y0 - a.y1) AS gap, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS off
  FROM img a JOIN cap b ON {_ON} AND b.y0 - a.y1 BETWEEN -12 AND 55 AND {_XO} >= 0.65
  WHERE (a.x1 - a.x0) / greatest(1, b.x1 - b.x0) >= 0.68 OR ((a.x1 - a.x0) / greatest(1, b.x1 - b.x0) >= 0.45
    AND abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= greatest(18, 0.08 * greatest(1, b.x1 - b.x0))))"""

SQL = {
    "rect_overlaps": f"WITH {_FX}, {_PAIRS} SELECT * FROM pairs",
    "region_conflicts": f"WITH {_FX}, {_PAIRS} SELECT * FROM pairs WHERE iou >= 0.80 OR coverage >= 0.92",
    "caption_owners": f"WITH {_FX}, {_OWNER} SELECT * FROM owner",
    "block_neighbors": f"WITH {_FX}, {_OWNER}, {_NEIGHBORS} SELECT * FROM n",
    "block_clusters": f"""WITH RECURSIVE {_FX}, {_OWNER}, {_NEIGHBORS},
e AS (SELECT doc, page, a_id AS a, b_id AS b FROM n UNION SELECT doc, page, b_id, a_id FROM n),
walk AS (SELECT doc, page, id AS s, id AS t FROM img UNION SELECT w.doc, w.page, w.s, e.b FROM walk w JOIN e ON e.doc = w.doc AND e.page = w.page AND e.a = w.t),
c AS (SELECT doc, page, s AS id, min(t) AS root FROM walk GROUP BY 1, 2, 3)
SELECT doc, page, root AS first, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM img JOIN c USING (doc, page, id) GROUP BY 1, 2, 3""",
    "caption_above": f"""WITH {_FX}, {_ABOVE}
SELECT doc, page, caption_id, arg_min(image_id, {{'g': gap, 'o': off, 'i': image_id}}) AS image_id FROM near GROUP BY 1, 2, 3""",
    "caption_beside": f"""WITH {_FX}, slim AS (SELECT doc, page, id, x0, y0, x0 + 90 AS x1, y0 + 70 AS y1 FROM cap),
s AS (SELECT a.doc, a.page, b.id AS caption_id, a.id AS image_id, abs(a.y0 - b.y0) AS top, -({_YO}) AS level, a.x1 - a.x0 AS w,
  CASE WHEN b.x0 - a.x1 >= -3 AND (a.x0 - b.x1 < -3 OR b.x0 - a.x1 <= a.x0 - b.x1) THEN b.x0 - a.x1 WHEN a.x0 - b.x1 >= -3 THEN a.x0 - b.x1 END AS side
  FROM img a JOIN slim b ON {_ON}),
f AS (SELECT *, row_number() OVER v AS n, lead(side) OVER v AS s2, lead(top) OVER v AS t2, lead(level) OVER v AS l2
  FROM s WHERE w >= 1.5 * 90 AND side <= 24 AND level <= -0.72 AND top <= 18
  WINDOW v AS (PARTITION BY doc, page, caption_id ORDER BY side, top, level, image_id))
SELECT doc, page, caption_id, image_id FROM f WHERE n = 1 AND NOT coalesce(s2 <= side + 6 AND t2 <= top + 12 AND l2 <= level + 0.10, false)""",
    "caption_previous_page": f"""WITH {_FX}, wide AS (SELECT doc, page, id, x0, y0, x1 + 200 AS x1, y1 + 150 AS y1 FROM img),
s AS (SELECT b.doc, b.page, b.id AS caption_id, a.id AS image_id, {_XO} * 6 + a.y1 / {H_} * 6 - b.y0 / {H_} * 6 AS score
  FROM wide a JOIN cap b ON a.doc = b.doc AND a.page + 1 = b.page
  WHERE b.y0 <= 0.28 * {H_} AND a.x1 - a.x0 >= 0.65 * {W_} AND {_AA} >= 0.20 * {W_ * H_} AND a.y1 >= 0.70 * {H_}),
f AS (SELECT *, row_number() OVER v AS n, lead(score) OVER v AS s2 FROM s WINDOW v AS (PARTITION BY doc, page, caption_id ORDER BY score DESC, image_id))
SELECT doc, page, caption_id, image_id FROM f WHERE n = 1 AND (s2 IS NULL OR s2 < score - 1)""",
    "caption_rows": f"""WITH {_FX},
p AS (SELECT b.doc, b.page, b.id AS caption_id, count(*) AS n, count(*) FILTER (a.x0 < b.x0 OR (a.x0 = b.x0 AND a.id < b.id)) AS place
  FROM cap b JOIN cap a ON {_ON} AND abs(a.y0 - b.y0) <= greatest(18, 1.8 * greatest(1, b.y1 - b.y0)) GROUP BY 1, 2, 3 HAVING count(*) > 1),
u AS (SELECT a.doc, a.page, b.id AS caption_id, a.id AS image_id, (a.y0 + a.y1) / 2 AS cy, a.y1 - a.y0 AS h,
  row_number() OVER (PARTITION BY a.doc, a.page, b.id ORDER BY a.x0, a.id) - 1 AS place FROM img a JOIN cap b ON {_ON} AND b.y0 - a.y1 BETWEEN -14 AND 125),
q AS (SELECT doc, page, caption_id, count(*) AS m FROM u GROUP BY 1, 2, 3 HAVING max(cy) - min(cy) <= 0.35 * greatest(1, max(h)))
SELECT doc, page, caption_id, image_id FROM p JOIN q USING (doc, page, caption_id) JOIN u USING (doc, page, caption_id, place) WHERE n = m""",
    "prose_in_regions": """WITH s AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc, CAST(n // 50 + 1 AS INT) AS page, trim(regexp_replace(t, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ' ', 'g')) AS c, n % 50 * 14 + 60 AS y0, least(length(t), 90) * 5 AS w FROM s WHERE trim(t, ' ') <> ''),
r AS (SELECT DISTINCT doc, page, id, CASE id WHEN 1 THEN 0 ELSE 400 END AS a, CASE id WHEN 1 THEN 400 ELSE 842 END AS b FROM l, (VALUES (1), (2)) v(id)),
p AS (SELECT r.doc, r.page, r.id, len(string_split(c, ' ')) AS words, greatest(0, least(b, y0 + 12) - greatest(a, y0)) * least(w, 525) / greatest(1.0::DOUBLE, 12 * w) AS share
  FROM r JOIN l USING (doc, page) WHERE length(c) >= 120 AND len(string_split(c, ' ')) >= 18 AND w >= 107.1),
g AS (SELECT doc, page, id, count(*) AS paragraphs, sum(words * share) AS weighted FROM p WHERE share >= 0.08 GROUP BY 1, 2, 3)
SELECT r.doc, r.page, r.id, coalesce(paragraphs, 0) AS paragraphs, coalesce(weighted, 0) AS weighted FROM r LEFT JOIN g USING (doc, page, id)""",
    "consume_once": f"""WITH RECURSIVE {_FX}, {_ABOVE},
c AS (SELECT doc, page, caption_id, list(image_id ORDER BY gap, off, image_id) AS wants, row_number() OVER (PARTITION BY doc, page ORDER BY any_value(cy), any_value(cx), caption_id) AS k FROM near GROUP BY 1, 2, 3),
walk AS (
  SELECT doc, page, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS taken, CAST(NULL AS INT) AS caption_id, CAST(NULL AS INT) AS image_id FROM (SELECT DISTINCT doc, page FROM c)
  UNION ALL
  SELECT w.doc, w.page, c.k, list_append(w.taken, CAST(list_filter(c.wants, lambda z: NOT list_contains(w.taken, CAST(z AS INT)))[1] AS INT)), CAST(c.caption_id AS INT),
    CAST(list_filter(c.wants, lambda z: NOT list_contains(w.taken, CAST(z AS INT)))[1] AS INT)
  FROM walk w JOIN c ON c.doc = w.doc AND c.page = w.page AND c.k = w.k + 1)
SELECT doc, page, caption_id, image_id FROM walk WHERE image_id IS NOT NULL""",
    "visual_evidence": f"""WITH {_FX}, reg AS (SELECT doc, page, id, x0, y0 - 200 AS y0, x1, y0 AS y1 FROM cap),
h AS (SELECT a.doc, a.page, a.id, count(*) AS n, sum({_I}) AS s FROM reg a JOIN img b ON {_ON} AND {_MEET} AND {_I} / greatest(1, {_AB}) >= 0.5 GROUP BY 1, 2, 3)
SELECT doc, page, id, coalesce(n, 0) AS rasters, coalesce(s, 0) AS raster_area, coalesce(n, 0) >= 2 OR coalesce(s, 0) >= 0.04 * greatest(1, (x1 - x0) * (y1 - y0)) AS visual
FROM reg LEFT JOIN h USING (doc, page, id)""",
}
