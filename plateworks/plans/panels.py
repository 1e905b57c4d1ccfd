"""Queries of glyphs, profiles and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks import fixtures
from plateworks.operators import matching, panels
from plateworks.runtime import Cut, table


def glyph_classes(spark, sf_dir):
    """The nearest of 26 templates for each glyph."""
    g = table(spark, sf_dir, "embeddings").select("vec_id", panels.packed(F.col("embedding")).alias("bits"))
    bank = [(chr(65 + i), r["bits"]) for i, r in enumerate(g.where("vec_id < 26").orderBy("vec_id").collect())]
    return panels.classify(g.where("vec_id >= 26"), "bits", bank).select("vec_id", "letter", "similarity")


def glyph_assignment(spark, sf_dir):
    """Letters A to Z assigned to the glyphs of an image, which is each block of 32 vectors; a number is how well a letter fits."""
    g = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 32).alias("image"), F.col("vec_id").alias("glyph"), F.posexplode(F.slice("embedding", 1, 26)).alias("i", "v")
    )
    return panels.assign_glyphs(g.select("image", F.char(F.lit(65) + F.col("i")).alias("letter"), "glyph", (F.lit(0.55) + F.col("v").cast("double")).alias("score")))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a profile of 64 whole numbers."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", "i", F.floor(F.col("v").cast("double") * 1000).cast("bigint").alias("v")
    )


def rolling_profile(spark, sf_dir):
    """Mean over five places with zeros beyond the ends, summed up by vector in whole numbers."""
    w = W.partitionBy("vec_id").orderBy("i").rowsBetween(-2, 2)
    return _profile(spark, sf_dir).select("vec_id", "i", (F.sum("v").over(w) / 5).alias("smooth"))


def blank_runs(spark, sf_dir):
    """Runs of low values, by gaps and islands."""
    w = W.partitionBy("vec_id").orderBy("i")
    low = _profile(spark, sf_dir).where("v <= 0").withColumn("island", F.col("i") - F.row_number().over(w))
    return low.groupBy("vec_id", "island").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("island")


def label_endpoint(spark, sf_dir):
    """How far the lines of an order go before their running gain falls."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_discount") * 100).cast("int")).alias("q"))
    return panels.sequence_end(rows, ["l_orderkey"], "l_linenumber", F.when(F.col("q") > 0, F.col("q") - 4).otherwise(-2))


def height_quantiles(spark, sf_dir):
    """Exact quantiles of heights by supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.expr("percentile(l_quantity, 0.78)").alias("q78"), F.expr("percentile(l_quantity, 0.18)").alias("q18"), F.expr("percentile(l_quantity, 0.5)").alias("q50")
    )


def row_clusters(spark, sf_dir):
    """The most blocks of a page in a band of 15 percent of its height."""
    w = W.partitionBy("doc", "page").orderBy("y0").rangeBetween(0, 126)
    rows = fixtures.images(spark, sf_dir).select("doc", "page", F.col("y0").cast("int").alias("y0")).select("doc", "page", F.count("*").over(w).alias("n"))
    return rows.groupBy("doc", "page").agg(F.max("n").alias("largest"))


def row_segments(spark, sf_dir):
    """Blocks of a page in reading order, a new row where the next starts below the last."""
    w = W.partitionBy("doc", "page").orderBy("id")
    rows = fixtures.images(spark, sf_dir).withColumn("new", F.coalesce(F.col("y0") > F.lag("y1").over(w), F.lit(True)).cast("int"))
    return rows.groupBy("doc", "page").agg(F.sum("new").alias("rows"), F.count("*").alias("blocks"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "figures").dropDuplicates(["figure_no"])


def _drawn(spark: SparkSession, sf_dir: str, expected: bool = False) -> DataFrame:
    more = [F.col("expected_panel_labels").alias("expected")] if expected else []
    return panels.draw_figures(_figures(spark, sf_dir).select(F.col("figure_no").alias("key"), F.greatest(F.lit(1), F.size("expected_panel_labels")).alias("n"), *more))


def detected_labels(spark, sf_dir):
    """Letters found in the drawn image of each figure; as many as were drawn, all right."""
    drawn = _drawn(spark, sf_dir)
    found = panels.detect_labels(drawn.drop("labels")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("letter")), "").alias("labels"))
    return _figures(spark, sf_dir).select(F.col("figure_no").alias("key")).join(found, "key", "left")


def split_panels(spark, sf_dir):
    """Panels of the drawn image of each figure, by the letters found in it."""
    return panels.split_images(_drawn(spark, sf_dir).drop("labels"))


def split_records(spark, sf_dir):
    """The splitter's record of each figure."""
    return panels.split_record(panels.split_images(_drawn(spark, sf_dir).drop("labels")))


def composite_decisions(spark, sf_dir):
    """Composite or not, the letters held against the caption's; every image is split once."""
    both = Cut(panels.split_images(_drawn(spark, sf_dir, True).drop("labels"), "both"), "split").df
    rows = lambda c: both.select(F.explode(c).alias("r")).select("r.*")
    f = _figures(spark, sf_dir).select(F.col("figure_no").alias("key"), F.col("expected_panel_labels").alias("labels"))
    return panels.composite_decision(rows("panels"), rows("cuts"), f).withColumn("reasons", F.array_join("reasons", ","))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR output as lines: one word per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"),
        F.concat_ws("\t", (F.col("l_partkey") * 37 % 500).cast("string"), (F.col("l_orderkey") * 53 % 700).cast("string"), F.when(F.col("l_linenumber") == 7, "x").otherwise("30"),
                    F.lit("12"), (F.col("l_quantity").cast("int") * 2 - 1).cast("string"), F.when(F.col("l_linenumber") == 6, "--").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))).alias("line"),
    )


_HEADER = ["left", "top", "width", "height", "conf", "text"]


def ocr_words(spark, sf_dir):
    """Words of OCR output, by page."""
    return panels.ocr_words(_lines(spark, sf_dir), _HEADER).groupBy("key").agg(
        F.count("*").alias("words"), F.sum("left").alias("lefts"), F.sum("conf").alias("confidence"), F.min("text").alias("first")
    )


def ocr_penalty(spark, sf_dir):
    """How far a glyph lies in a word, as the greatest share of its area."""
    w = panels.ocr_words(_lines(spark, sf_dir), _HEADER).select(
        F.col("key").alias("doc"), F.lit(1).alias("page"), F.col("left").cast("double").alias("x0"), F.col("top").cast("double").alias("y0"),
        (F.col("left") + 30.0).alias("x1"), (F.col("top") + 12.0).alias("y1"), F.length("text").alias("n"),
    ).distinct()
    glyphs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.sequence(F.lit(0), F.lit(9))).alias("id", "k")
    ).select("doc", "page", "id", (F.col("k") * 50.0).alias("x0"), (F.col("k") * 70.0).alias("y0"), (F.col("k") * 50.0 + 20).alias("x1"), (F.col("k") * 70.0 + 10).alias("y1"))
    from plateworks.functions.rects import Rect, coverage

    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    met = matching.near_pairs(matching.tagged(glyphs, "a"), matching.tagged(w, "b"), coverage(a, b) >= 0.45)
    found = met.groupBy("doc", F.col("a_id").alias("id")).agg(F.max(coverage(a, b)).alias("penalty"))
    return glyphs.select("doc", "id").join(found, ["doc", "id"], "left").select("doc", "id", F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


QUERIES = {f.__name__: f for f in (
    glyph_classes, glyph_assignment, rolling_profile, blank_runs, label_endpoint, height_quantiles, row_clusters, row_segments, detected_labels, split_panels, split_records,
    composite_decisions, ocr_words, ocr_penalty,
)}

_P = "p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"
_OCR = """o AS (SELECT l_suppkey AS key, l_partkey * 37 % 500 AS left_, l_orderkey * 53 % 700 AS top_, CAST(l_quantity AS INT) * 2 - 1 AS conf, l_returnflag || l_linenumber AS text
  FROM lineitem WHERE l_linenumber NOT IN (6, 7) AND (CAST(l_quantity AS INT) * 2 - 1 < 0 OR CAST(l_quantity AS INT) * 2 - 1 >= 20))"""
SQL = {
    "detected_labels": """WITH f AS (SELECT DISTINCT ON (figure_no) * FROM figures)
SELECT figure_no AS key, CASE WHEN len(expected_panel_labels) > 1 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1, len(expected_panel_labels)) END AS labels FROM f""",
    "glyph_classes": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
s AS (SELECT a.vec_id, t.vec_id AS t, 2.0::DOUBLE * list_sum(list_transform(list_zip(a.b, t.b), lambda z: z[1] * z[2])) / greatest(1, list_sum(a.b) + list_sum(t.b)) AS similarity
  FROM g a, g t WHERE a.vec_id >= 26 AND t.vec_id < 26)
SELECT vec_id, chr(CAST(65 + t AS INT)) AS letter, similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, t) = 1""",
    "rolling_profile": f"WITH {_P} SELECT vec_id, i, sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE AS smooth FROM p",
    "blank_runs": f"""WITH {_P}, l AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM p WHERE v <= 0)
SELECT vec_id, min(i) AS start, count(*) AS length FROM l GROUP BY vec_id, island""",
    "label_endpoint": """WITH r AS (SELECT l_orderkey, l_linenumber, max(CAST(trunc(l_discount * 100) AS INT)) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN q > 0 THEN q - 4 ELSE -2 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT l_orderkey, l_linenumber AS endpoint, CAST(run AS BIGINT) AS best FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY run DESC, l_linenumber) = 1""",
    "height_quantiles": "SELECT l_suppkey, quantile_cont(l_quantity, 0.78) AS q78, quantile_cont(l_quantity, 0.18) AS q18, quantile_cont(l_quantity, 0.5) AS q50 FROM lineitem GROUP BY 1",
    "row_clusters": f"""WITH {fixtures.SQL}, c AS (SELECT doc, page, count(*) OVER (PARTITION BY doc, page ORDER BY CAST(y0 AS INT) RANGE BETWEEN CURRENT ROW AND 126 FOLLOWING) AS n FROM img)
SELECT doc, page, max(n) AS largest FROM c GROUP BY 1, 2""",
    "row_segments": f"""WITH {fixtures.SQL}, c AS (SELECT doc, page, CASE WHEN y0 > lag(y1) OVER w OR lag(y1) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM img WINDOW w AS (PARTITION BY doc, page ORDER BY id))
SELECT doc, page, CAST(sum(n) AS BIGINT) AS rows, count(*) AS blocks FROM c GROUP BY 1, 2""",
    "ocr_words": f"WITH {_OCR} SELECT key, count(*) AS words, CAST(sum(left_) AS BIGINT) AS lefts, CAST(sum(conf) AS DOUBLE) AS confidence, min(text) AS first FROM o GROUP BY 1",
    "ocr_penalty": f"""WITH {_OCR}, g AS (SELECT s_suppkey AS doc, CAST(k AS INT) AS id, k * 50 AS x0, k * 70 AS y0 FROM supplier, range(10) t(k)),
m AS (SELECT doc, id, greatest(0, least(x0 + 20, left_ + 30) - greatest(x0, left_)) * greatest(0, least(y0 + 10, top_ + 12) - greatest(y0, top_)) / 200.0::DOUBLE AS c FROM g JOIN o ON key = doc)
SELECT g.doc, g.id, coalesce(max(c) FILTER (c >= 0.45), 0) AS penalty FROM g LEFT JOIN m USING (doc, id) GROUP BY 1, 2""",
}
