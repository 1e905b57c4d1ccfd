"""Page objects derived from the star-schema tables by integer arithmetic, in Spark and as SQL.

The driver's tables hold no PDF pages. lineitem gives blocks in two columns of a page: rows with line
number 1 are caption blocks, the others image blocks. Ids are places in reading order on the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.runtime import cut, table

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, caption, id, x0, y0, x1, y1) of every block."""
    q = F.col("l_quantity").cast("int")
    n = F.col("l_linenumber")
    caption = n == 1
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"),
        (F.col("l_partkey") % 97 + 1).cast("int").alias("page"),
        caption.alias("caption"),
        (F.lit(40) + F.col("l_partkey") % 2 * 260).cast("double").alias("x0"),
        (F.col("l_orderkey") * 53 % 700).cast("double").alias("y0"),
        F.when(caption, q + 190).otherwise(q * 2 + 140).alias("_w"),
        F.when(caption, 14).otherwise(n * 20 + 40).alias("_h"),
    ).distinct()
    rows = rows.select("doc", "page", "caption", "x0", "y0", (F.col("x0") + F.col("_w")).alias("x1"), (F.col("y0") + F.col("_h")).alias("y1"))
    w = W.partitionBy("doc", "page", "caption").orderBy("y0", "x0", "x1", "y1")
    return rows.withColumn("id", F.row_number().over(w))


def images(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return (blocks(spark, sf_dir) if rows is None else rows).where(~F.col("caption")).drop("caption")


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """images() and captions() of blocks that are worked out once."""
    rows = cut(blocks(spark, sf_dir), "blocks")
    return images(spark, sf_dir, rows), captions(spark, sf_dir, rows)


def captions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Caption blocks with a kind and a number; a caption may have two blocks on a page."""
    rows = (blocks(spark, sf_dir) if rows is None else rows).where("caption").drop("caption")
    return rows.withColumn("kind", F.when(F.col("id") % 4 == 0, "scheme").otherwise("figure")).withColumn("number", (F.floor(F.col("id") / 2)).cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of documents: one per line, 14 points apart, 50 to a page; (doc, page, id, text, size, font, x0, y0, x1, y1).

    Every fifth line of a document is printed larger and in another font.
    """
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    each = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where("trim(text) <> ''")
    y = (F.col("n") % 50 * 14 + 60).cast("double")
    return each.select(
        "doc", (F.floor(F.col("n") / 50) + 1).cast("int").alias("page"), (F.col("n") % 50).cast("int").alias("id"), "text",
        F.when(F.col("n") % 5 == 4, 12.0).otherwise(9.0).alias("size"), F.when(F.col("n") % 5 == 4, "ABCDEF+Sans-Bold").otherwise("Serif-Regular").alias("font"),
        F.lit(70.0).alias("x0"), y.alias("y0"), (F.lit(70.0) + F.least(F.length("text"), F.lit(90)) * 5).alias("x1"), (y + 12).alias("y1"),
    )


SQL = """r AS (
  SELECT DISTINCT l_suppkey AS doc, CAST(l_partkey % 97 + 1 AS INT) AS page, l_linenumber = 1 AS caption,
    CAST(40 + l_partkey % 2 * 260 AS DOUBLE) AS x0, CAST(l_orderkey * 53 % 700 AS DOUBLE) AS y0,
    CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) + 190 ELSE CAST(l_quantity AS INT) * 2 + 140 END AS w,
    CASE WHEN l_linenumber = 1 THEN 14 ELSE l_linenumber * 20 + 40 END AS h FROM lineitem),
blocks AS (
  SELECT doc, page, caption, x0, y0, x0 + w AS x1, y0 + h AS y1,
    row_number() OVER (PARTITION BY doc, page, caption ORDER BY y0, x0, x0 + w, y0 + h) AS id FROM r),
img AS (SELECT * EXCLUDE (caption) FROM blocks WHERE NOT caption),
cap AS (SELECT * EXCLUDE (caption), CASE WHEN id % 4 = 0 THEN 'scheme' ELSE 'figure' END AS kind, CAST(id // 2 AS VARCHAR) AS number FROM blocks WHERE caption)"""
