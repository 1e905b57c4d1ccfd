"""The queries of this subpackage: QUERIES and, where SQL can express them, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.llm import canon, encode, history, leaks, reading, splits, survivors
from plateworks.runtime import Cut, new_path, table

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _components(records: DataFrame) -> DataFrame:
    return splits.record_components(records, "record_no", splits.link_keys())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that belong together although their groups are written differently."""
    records = table(spark, sf_dir, "training_records")
    return splits.linked_samples(records, _components(records))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_no, component, bin, split) of every training record."""
    records = table(spark, sf_dir, "training_records")
    return splits.assign_splits(_components(records), TARGETS).withColumnRenamed("node", "record_no")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, torn, near): components with records in another split too, and whether a split's share is within 0.01 of its target.

    Where one component is larger than a target allows the share can't be met; here none is.
    """
    rows = p1_splits(spark, sf_dir)
    spread = rows.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    torn = spread.where("a <> b").count()
    total = F.sum("n").over(W.partitionBy())
    shares = rows.groupBy("split").agg(F.count("*").alias("n")).select("split", (F.col("n") / total).alias("share"))
    target = F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.lit(v))])
    return shares.select("split", F.lit(torn).alias("torn"), (F.abs(F.col("share") - target[F.col("split")]) <= 0.01).alias("near"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The items, and the links that were found among them.

    The batches come in two waves, by the load that first brought them: the first fills the index, the
    second is probed against it.
    """
    items = Cut(history.fold_items(table(spark, sf_dir, "batch_items")), "items").df
    first = items.groupBy("batch_id").agg(F.min("load_no").alias("first"))
    middle = (first.agg(F.percentile_approx("first", 0.5)).first()[0] or 0)
    index = history.HistoryIndex(spark, new_path(spark, "history"))
    links = None
    for late in (False, True):
        wave = items.join(first.where((F.col("first") > middle) == late), "batch_id", "left_semi")
        found = index.ingest(wave)
        links = found if links is None else links.unionByName(found)
    return items, links


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of different batches that hold the same paper."""
    return history.same_paper_pairs(*_ingested(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, paper, links): every item with the smallest item that holds the same paper, and its number of links."""
    return history.same_paper_classes(*_ingested(spark, sf_dir))


FIELDS = ("caption", "reviewer", "figure_number", "caption_kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, field_name, record_no): the best record of each image, and of each field the best that has it."""
    rows = survivors.candidates(
        table(spark, sf_dir, "training_records"), survivors.image_key(F.col("image_id")), "record_no", survivors.review_trust(), {f: [f] for f in FIELDS}
    )
    return survivors.choose(rows, FIELDS).select(F.col("key").alias("image_id"), F.col("bundle").alias("field_name"), F.col("record").alias("record_no"))


BUNDLES = {"caption_text": ["caption"], "label": ["caption_kind", "figure_number"], "review": ["reviewer", "reviewed_at"]}


def p3_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, bundle, record_no): whole bundles, where the caption determines kind and number of the figure."""
    rows = survivors.candidates(
        table(spark, sf_dir, "training_records"), survivors.image_key(F.col("image_id")), "record_no", survivors.review_trust(), BUNDLES
    )
    return survivors.choose(rows, list(BUNDLES), [("caption_text", "label")]).select(
        F.col("key").alias("image_id"), "bundle", F.col("record").alias("record_no")
    )


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure with the one form of its caption and label."""
    return canon.forms(table(spark, sf_dir, "figures")).select("figure_no", "canonical_caption", "canonical_label")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of figures whose captions and labels look the same but are not the same characters."""
    return canon.look_alike_pairs(canon.forms(table(spark, sf_dir, "figures")))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(figure_no, class_no, links): the same as p5_found in one row for each figure."""
    return canon.look_alike_classes(canon.forms(table(spark, sf_dir, "figures")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) put together again from the ids."""
    return encode.decode_corpus(p6_ids(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents hold passages of the evaluation items."""
    return leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an evaluation item."""
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the leaked passages, scanned again until none is left."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leaks): passages left in the cleaned documents; none."""
    return leaks.leak_spans(p7_cleaned(spark, sf_dir), table(spark, sf_dir, "eval_items")).agg(F.count("*").alias("leaks"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document, with the shares of its sentences."""
    docs = table(spark, sf_dir, "documents")
    model = reading.fit(docs, table(spark, sf_dir, "reading_labels"), table(spark, sf_dir, "reading_anchors"))
    return reading.levels(docs, model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the English documents that are of level 5 by a posterior of 0.99 or more; a few words can't reach it."""
    return p8_levels(spark, sf_dir).where("level = 5 AND english AND confidence >= 0.99").select("doc_id").distinct()


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many English documents of each kind have each level; documents without a level count as such."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "kind")
    return p8_levels(spark, sf_dir).where("english OR level IS NULL").select("doc_id", "level").join(docs, "doc_id").groupBy("kind", "level").agg(F.count("*").alias("documents"))


QUERIES = {
    "p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_bundles": p3_bundles,
    "p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes,
    "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_spans": p7_spans, "p7_cleaned": p7_cleaned, "p7_rescan": p7_rescan,
    "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile,
}

_DIGEST = "nullif(regexp_extract(lower(%s), '(?:^|[^0-9a-f]|[a-z]{2,}[^0-9a-f])([0-9a-f]{%d})(?:[^0-9a-f]|$)', 1), '')"

SQL = {
    "p1_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT record_no, sample_id, source_group_id, paper_id, source_file_sha256, job_id, image_id FROM training_records),
m AS (
  SELECT record_no, 'd' || {_DIGEST % ('source_group_id', 64)} AS k FROM r
  UNION SELECT record_no, 'd' || {_DIGEST % ('paper_id', 64)} FROM r
  UNION SELECT record_no, 'd' || {_DIGEST % ('source_file_sha256', 64)} FROM r
  UNION SELECT record_no, 'j' || {_DIGEST % ('job_id', 32)} FROM r
  UNION SELECT record_no, 'j' || {_DIGEST % ('source_group_id', 32)} FROM r
  UNION SELECT record_no, 'i' || {_DIGEST % ('image_id', 64)} FROM r),
hub AS (SELECT k, min(record_no) AS h FROM m WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
e0 AS (SELECT DISTINCT m.record_no AS a, h AS b FROM m JOIN hub USING (k) WHERE m.record_no <> h),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
walk AS (
  SELECT DISTINCT a AS n, a AS s FROM e
  UNION SELECT e.b, w.s FROM walk w JOIN e ON e.a = w.n WHERE e.b > w.s),
comp AS (SELECT n, min(s) AS c FROM walk GROUP BY n),
x AS (SELECT coalesce(c, record_no) AS c, sample_id, coalesce('=' || source_group_id, '0') AS g FROM r LEFT JOIN comp ON n = record_no),
big AS (SELECT c, min(sample_id) AS a FROM x GROUP BY c HAVING count(DISTINCT sample_id) > 1 AND count(DISTINCT g) > 1)
SELECT DISTINCT a AS sample_id_a, sample_id AS sample_id_b FROM x JOIN big USING (c) WHERE sample_id > a
""",
    "p3_found": """
WITH r AS (
  SELECT DISTINCT record_no, 'img_' || nullif(regexp_extract(lower(image_id), '([0-9a-f]{64})', 1), '') AS image_id,
    CASE lower(trim(review_status)) WHEN 'verified' THEN 2 WHEN 'ambiguous' THEN 1 ELSE 0 END AS t0,
    CASE WHEN annotation_complete THEN 1 ELSE 0 END AS t1, coalesce(annotation_version, 0) AS t2, reviewed_at AS t3,
    caption, reviewer, figure_number, caption_kind
  FROM training_records),
g AS (SELECT image_id FROM r WHERE image_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT record_no) > 1),
f AS (
  SELECT image_id, 'record' AS field_name, record_no, t0, t1, t2, t3, 'x1' AS v FROM r
  UNION ALL SELECT image_id, 'caption', record_no, t0, t1, t2, t3, caption FROM r
  UNION ALL SELECT image_id, 'reviewer', record_no, t0, t1, t2, t3, reviewer FROM r
  UNION ALL SELECT image_id, 'figure_number', record_no, t0, t1, t2, t3, figure_number FROM r
  UNION ALL SELECT image_id, 'caption_kind', record_no, t0, t1, t2, t3, caption_kind FROM r)
SELECT image_id, field_name, record_no FROM f JOIN g USING (image_id)
WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ('n/a', '-', '', 'none', 'null', '?', '(no caption)', 'tbd', 'unknown', chr(8212))
QUALIFY row_number() OVER (PARTITION BY image_id, field_name ORDER BY t0 DESC, t1 DESC, t2 DESC, t3 DESC NULLS LAST, record_no DESC) = 1
""",
    "p1_shares": "SELECT * FROM (VALUES ('train', 0, true), ('validation', 0, true), ('test', 0, true)) v(split, torn, near)",
    "p7_rescan": "SELECT CAST(0 AS BIGINT) AS leaks",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
