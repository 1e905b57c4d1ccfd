"""Queries of caption text in documents, upserts and reports of records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks import fixtures
from plateworks.functions.notation import plain
from plateworks.operators import annotations, captions, training
from plateworks.plans.curation import _figures, _records, edits
from plateworks.runtime import table
from plateworks.sources import sinks


def caption_blocks(spark, sf_dir):
    """Captions of the documents with the lines that go on with them."""
    return captions.merge_blocks(fixtures.lines(spark, sf_dir)).select("doc", "page", "id", "blocks", F.length("text").alias("chars"))


def caption_continuations(spark, sf_dir):
    """Captions that go on at the top of the next page."""
    lines = fixtures.lines(spark, sf_dir)
    return captions.continuations(captions.merge_blocks(lines), lines, fixtures.PAGE_HEIGHT, fixtures.PAGE_WIDTH)


def split_captions(spark, sf_dir):
    """Several captions in one line."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select(F.col("doc_id").alias("key"), F.explode(F.split("text", "\n")).alias("text"), F.lit(70.0).alias("x0"), F.lit(520.0).alias("x1"))
    return captions.split_captions(spark, lines).groupBy("key").agg(F.count("*").alias("captions"), F.max("part").alias("most"))


def grown_figures(spark, sf_dir):
    """Figures grown from the image above a caption."""
    g = captions.grow_figures(fixtures.images(spark, sf_dir), fixtures.captions(spark, sf_dir))
    return g.select("doc", "page", "caption_id", F.size("members").alias("members"), "x0", "y0", "x1", "y1")


def reconciled_panels(spark, sf_dir):
    """Panels of the editor against panels that are cut again (every third label is gone)."""
    now = annotations.current_panels(annotations.panel_versions(edits(spark, sf_dir)))
    old = now.select("job", "record", "label", F.col("version").cast("int").alias("current_version"))
    new = now.where("label <> 'B'").select("job", "record", "label").unionByName(now.select("job", "record").distinct().withColumn("label", F.lit("D")))
    return annotations.reconcile(old, new)


def upserted_records(spark, sf_dir):
    """The later half of the records written over the earlier, by sample."""
    r = _records(spark, sf_dir).where("sample_id IS NOT NULL").select("record_no", "sample_id")
    return training.upsert(r.where("record_no % 2 = 0"), r.where("record_no % 2 = 1"), "sample_id")


def stale_samples(spark, sf_dir):
    """K8: published samples that no record has ready."""
    r = _records(spark, sf_dir)
    return training.stale_ready(r.where("sample_id IS NOT NULL").select("sample_id").distinct(), r)


def next_pending(spark, sf_dir):
    """The next record of a job that waits for review, after each record."""
    r = _records(spark, sf_dir).where("record_id IS NOT NULL").select("job_id", "record_id", "record_no", plain(F.col("review_status")).alias("s"))
    w = W.partitionBy("job_id").orderBy("record_id", "record_no").rowsBetween(1, W.unboundedFollowing)
    waits = F.coalesce(F.col("s") == "proposed", F.lit(True))
    return r.select("job_id", "record_id", "record_no", F.first(F.when(waits, F.col("record_id")), True).over(w).alias("next"))


def artifacts(spark, sf_dir):
    """The artifacts of each job, those to review first, then embedded rasters, then caption crops, numbered."""
    f = _figures(spark, sf_dir).where("image_path IS NOT NULL")
    kind = F.when(F.coalesce("needs_review", F.lit(False)), "review").when(F.col("extraction_method") == "embedded_raster", "preview").otherwise("preserved")
    rank = F.when(F.col("category") == "review", 0).when(F.col("category") == "preview", 1).otherwise(2)
    w = W.partitionBy("job_id").orderBy(rank, "figure_no")
    return f.withColumn("category", kind).select("job_id", "figure_no", "category", F.row_number().over(w).alias("ordinal"))


def version_manifests(spark, sf_dir):
    """K7: the versions of each panel as one text."""
    return sinks.version_manifests(annotations.panel_versions(edits(spark, sf_dir))).select("job", "record", "label", F.length("manifest").alias("chars"))


def verified_by_group(spark, sf_dir):
    """Records and verified ones by kind of source group."""
    r = _records(spark, sf_dir)
    kind = F.coalesce(F.regexp_extract(F.lower(F.trim("source_group_id")), "^(paper|source|job)", 1), F.lit("none"))
    return r.groupBy(kind.alias("source")).agg(F.count("*").alias("records"), F.count_if(plain(F.col("review_status")) == "verified").alias("verified"))


QUERIES = {f.__name__: f for f in (
    caption_blocks, caption_continuations, split_captions, grown_figures, reconciled_panels, upserted_records, stale_samples, next_pending, artifacts,
    version_manifests, verified_by_group,
)}

_R = "r AS (SELECT DISTINCT ON (record_no) * FROM training_records)"
_F = "f AS (SELECT DISTINCT ON (figure_no) * FROM figures)"
SQL = {
    "version_manifests": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, 'r00' || CAST(event_id % 2 AS VARCHAR) AS record, event_id AS seq, event_type = 'purchase' AS crop,
  chr(65 + coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) % 3) AS label FROM events WHERE event_type IN ('purchase', 'error')),
v AS (SELECT *, count(*) FILTER (crop) OVER (PARTITION BY job, record, label ORDER BY seq ROWS UNBOUNDED PRECEDING) AS version FROM e)
SELECT job, record, label, length('{"current_version":' || max(version) || ',"versions":[' || string_agg('{"version":' || version || ',"seq":' || seq || ',"active":' || crop || '}', ',' ORDER BY seq) || ']}') AS chars
FROM v GROUP BY 1, 2, 3""",
    "reconciled_panels": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, 'r00' || CAST(event_id % 2 AS VARCHAR) AS record,
  chr(65 + coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) % 3) AS label, event_type FROM events WHERE event_type IN ('purchase', 'error')),
o AS (SELECT job, record, label, CAST(count(*) FILTER (event_type = 'purchase') AS INT) AS v FROM e GROUP BY 1, 2, 3),
n AS (SELECT job, record, label FROM o WHERE label <> 'B' UNION SELECT job, record, 'D' FROM o)
SELECT job, record, label, coalesce(v, 0) AS current_version, CASE WHEN o.v IS NULL THEN 'added' WHEN n.job IS NOT NULL THEN 'kept' WHEN v = 0 THEN 'dropped' ELSE 'restored' END AS state
FROM o FULL JOIN (SELECT *, 1 AS one FROM n) n USING (job, record, label)""",
    "upserted_records": f"""WITH {_R}, s AS (SELECT record_no, sample_id FROM r WHERE sample_id IS NOT NULL)
SELECT * FROM s WHERE record_no % 2 = 1 OR sample_id NOT IN (SELECT sample_id FROM s WHERE record_no % 2 = 1)""",
    "stale_samples": f"WITH {_R} SELECT sample_id FROM r WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (ready_for_training) = 0",
    "next_pending": f"""WITH {_R} SELECT job_id, record_id, record_no, first_value(CASE WHEN coalesce(nullif(lower(trim(review_status)), '') = 'proposed', true) THEN record_id END IGNORE NULLS)
  OVER (PARTITION BY job_id ORDER BY record_id, record_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM r WHERE record_id IS NOT NULL""",
    "artifacts": f"""WITH {_F}, c AS (SELECT job_id, figure_no, CASE WHEN coalesce(needs_review, false) THEN 'review' WHEN extraction_method = 'embedded_raster' THEN 'preview' ELSE 'preserved' END AS category
  FROM f WHERE image_path IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE category WHEN 'review' THEN 0 WHEN 'preview' THEN 1 ELSE 2 END, figure_no) AS ordinal FROM c""",
    "verified_by_group": f"""WITH {_R} SELECT coalesce(regexp_extract(lower(trim(source_group_id)), '^(paper|source|job)', 1), 'none') AS source, count(*) AS records,
  count(*) FILTER (nullif(lower(trim(review_status)), '') = 'verified') AS verified FROM r GROUP BY 1""",
}
