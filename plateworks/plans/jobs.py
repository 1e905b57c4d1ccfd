"""Queries of jobs: checks of inputs, labels of states, metrics, responses, updates, and records of the training collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions import text
from plateworks.functions.notation import hex_id
from plateworks.operators import annotations, jobs, training
from plateworks.operators.queue import latest_items
from plateworks.plans.curation import _figures, _records, panels
from plateworks.runtime import table


def refused_inputs(spark, sf_dir):
    """why items would be refused by an extraction."""
    items = latest_items(table(spark, sf_dir, "batch_items"))
    n = F.coalesce("size_bytes", F.lit(0))
    why = jobs.refused_input(F.col("source_path"), (n % 5).cast("int") * 75, [(n % 7 - 1).cast("double"), (n % 3).cast("double")], (n % 11).cast("int"))
    return items.select("batch_id", "item_id", why.alias("refused")).where("refused IS NOT NULL")


def valid_jobs(spark, sf_dir):
    """ids of jobs that are well formed, and paths inside the root of their batch."""
    items = latest_items(table(spark, sf_dir, "batch_items"))
    return items.select("batch_id", "item_id", jobs.job_id_valid(F.col("job_id")).alias("valid"), jobs.inside("/srv", F.col("source_path")).alias("inside"))


def state_labels(spark, sf_dir):
    """What the interface calls states, counted."""
    items = latest_items(table(spark, sf_dir, "batch_items")).select(jobs.batch_label(F.col("status")).alias("label"))
    r = _records(spark, sf_dir)
    records = r.select(jobs.record_label(F.col("review_status"), F.col("annotation_complete"), F.col("annotation_mode"), F.col("record_no") % 3 == 0, F.col("record_no") % 2, F.col("human_panel_count")).alias("label"))
    return items.unionByName(records).groupBy("label").agg(F.count("*").alias("n"))


def aligned_labels(spark, sf_dir):
    """Expected labels in the case of the alphabet that was found."""
    alphabet = F.when(F.col("figure_no") % 3 == 0, "A").when(F.col("figure_no") % 3 == 1, "a")
    return _figures(spark, sf_dir).select("figure_no", F.array_join(jobs.align_case(F.col("expected_panel_labels"), alphabet), "").alias("labels"))


def size_scores(spark, sf_dir):
    """How near the heights of figures are to 900 pixels."""
    return _figures(spark, sf_dir).where("height_px > 0").select("figure_no", jobs.size_score(F.col("height_px").cast("double"), F.lit(900.0)).alias("score"))


def reviewed_at_text(spark, sf_dir):
    """Instants of reviews as text in UTC."""
    return _records(spark, sf_dir).where("reviewed_at IS NOT NULL").select("record_no", jobs.utc_text(F.col("reviewed_at")).alias("reviewed"))


def note_texts(spark, sf_dir):
    """Texts of documents with line ends of one kind, and whether they may be stored."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    t = text.canonical_newlines(F.concat(F.lit("a\r"), "text", F.lit("\r\nb")))
    return docs.select("doc_id", F.length(t).alias("chars"), ((F.length(t) <= annotations.LONGEST_TEXT) & ~F.contains(t, F.lit("\0"))).alias("fine"))


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of jobs made of figures."""
    f = _figures(spark, sf_dir)
    n = F.size("expected_panel_labels")
    return f.select(
        "job_id", F.format_string("r%06d", "figure_no").alias("record_id"), F.concat(F.lit("doc "), F.coalesce("page_number", F.lit(0)).cast("string")).alias("document_name"), "figure_id",
        F.col("caption_figure_number").alias("figure_number"), "caption_kind", F.coalesce("caption", F.lit("")).alias("caption"), "page_number", F.array_join("expected_panel_labels", "").alias("labels"),
        n.alias("panel_count"), F.when(n > 0, F.lit(1.0) - F.lit(1.0) / (n + 1)).otherwise(0.0).alias("mean_confidence"), (n % 3).alias("low_confidence_panels"),
        F.array_join("expected_panel_labels", "").alias("expected_labels"), "extraction_method", F.coalesce("needs_review", F.lit(False)).alias("extraction_needs_review"),
    )


def job_metrics(spark, sf_dir):
    """The eight metrics of each job."""
    return jobs.job_metrics(job_records(spark, sf_dir))


def document_metrics(spark, sf_dir):
    """Figures, panels and reviews of each document of a job."""
    d = jobs.document_groups(job_records(spark, sf_dir))
    return d.select("job_id", "document_name", "slug", F.array_join("record_ids", ",").alias("records"), "figure_count", "panel_count", "needs_review")


def responses(spark, sf_dir):
    """Records with what their editor says written over."""
    r = job_records(spark, sf_dir)
    editor = r.where(F.substring("record_id", 2, 6).cast("int") % 2 == 0).select(
        "job_id", "record_id", F.when(F.length("labels") > 2, F.concat(F.lit("edited "), "caption")).alias("caption"), F.lit("verified").alias("review_status")
    )
    return jobs.responses(r, editor).select("job_id", "record_id", "document_slug", F.md5("caption").alias("caption_digest"), "panel_count", "review_status")


def updated_items(spark, sf_dir):
    """Some items are set to failed, with a message."""
    items = latest_items(table(spark, sf_dir, "batch_items"))
    changes = items.where(F.substring("job_id", 1, 1).isin("0", "3", "6", "9", "c")).select("batch_id", "item_id", F.lit("failed").alias("status"), F.lit("stopped").alias("error"), F.lit("other").alias("filename"))
    return jobs.updated_items(items, changes).groupBy("batch_id", "status").agg(F.count("*").alias("items"), F.count_if(F.col("error") == "stopped").alias("stopped"), F.count_if(F.col("filename") == "other").alias("renamed"))


def preview_keys(spark, sf_dir):
    """The names of page previews."""
    f = _figures(spark, sf_dir).where("image_path IS NOT NULL AND page_number IS NOT NULL AND width_px > 0")
    return f.select("figure_no", jobs.preview_key(F.col("figure_id"), F.col("width_px"), F.col("figure_no"), F.col("page_number"), F.array("block_index", "dpi"), F.lit(150)).alias("key"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 whole: a training record of each figure, with its panels, image, group and readiness."""
    f = _figures(spark, sf_dir).where("width_px > 0 AND height_px > 0 AND figure_id IS NOT NULL AND image_path IS NOT NULL")
    figures = f.select(
        "job_id", F.col("figure_no").cast("string").alias("record_id"), "figure_id", F.col("caption_figure_number").alias("figure_number"), "caption_kind", "caption",
        F.struct(F.element_at(F.split("image_path", "/"), -1).alias("file_name"), F.col("width_px").alias("width"), F.col("height_px").alias("height")).alias("image"), F.sha2("image_path", 256).alias("image_sha256"),
        F.when(F.col("figure_no") % 2 == 0, "verified").alias("review_status"), F.when(F.col("figure_no") % 5 == 0, "no_split").alias("annotation_mode"),
        (F.col("figure_no") % 3 != 0).alias("annotation_complete"), F.lit(1).alias("annotation_version"), F.lit("rev").alias("reviewer"), F.lit(None).cast("timestamp").alias("reviewed_at"),
    )
    boxes = panels(spark, sf_dir).select(
        F.lit("").alias("job"), F.col("figure_no").cast("string").alias("record"), "label", F.when(F.col("figure_no") % 7 != 0, F.struct("x0", "y0", "x1", "y1")).alias("box"),
        F.lit(1).alias("panel_version"), F.lit("human_manual").alias("annotation_source"), F.when(F.col("figure_no") % 7 == 0, F.concat(F.lit("panel_"), "label", F.lit("_missing_or_invalid_bbox"))).alias("issue"),
    ).drop("job").join(figures.select(F.col("job_id").alias("job"), F.col("record_id").alias("record")), "record")
    items = latest_items(table(spark, sf_dir, "batch_items"))
    sources = items.select("job_id", hex_id(F.col("file_sha256"), 64).alias("file_sha256"), F.lower("source_path").endswith(".pdf").alias("is_pdf"))
    return training.build_records(figures, boxes, sources, F.lit("2026-01-01T00:00:00+00:00"))


def training_records(spark, sf_dir):
    """The training record of each figure."""
    return training_rows(spark, sf_dir).select(
        F.col("provenance.record_id").cast("bigint").alias("figure_no"), "sample_id", "source_group_id", "image.collection_path", F.size("panels").alias("panels"), F.size("issues").alias("issues"), "ready_for_training", "human_panel_count"
    )


QUERIES = {f.__name__: f for f in (
    refused_inputs, valid_jobs, state_labels, aligned_labels, size_scores, reviewed_at_text, note_texts, job_metrics, document_metrics, responses, updated_items, preview_keys, training_records,
)}

_I = """i AS (SELECT * EXCLUDE (status), nullif(lower(trim(status)), '') AS status FROM batch_items
  WHERE batch_id IS NOT NULL AND item_id IS NOT NULL AND changed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, item_id ORDER BY changed_at DESC, load_no DESC) = 1)"""
_F = "f AS (SELECT DISTINCT ON (figure_no) * FROM figures)"
_R = "r AS (SELECT DISTINCT ON (record_no) * FROM training_records)"
_ST = "nullif(lower(trim(review_status)), '')"
_J = f"""{_F}, j AS (SELECT job_id, printf('r%06d', figure_no) AS record_id, 'doc ' || coalesce(page_number, 0) AS document_name, len(expected_panel_labels) AS n, coalesce(needs_review, false) AS again, caption,
  array_to_string(expected_panel_labels, '') AS labels FROM f)"""
_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jobs.BATCH_LABELS.items())
_T = jobs.RECORD_LABELS
SQL = {
    "refused_inputs": f"""WITH {_I}, s AS (SELECT *, coalesce(size_bytes, 0) AS n FROM i), w AS (SELECT batch_id, item_id, CASE WHEN source_path IS NULL OR NOT lower(source_path) LIKE '%.pdf' THEN 'not a PDF'
  WHEN n % 5 <= 0 THEN 'dpi must be positive' WHEN n % 7 - 1 < 0 THEN 'sizes must not be negative' WHEN n % 11 < 1 THEN 'pages count from 1' END AS refused FROM s) SELECT * FROM w WHERE refused IS NOT NULL""",
    "valid_jobs": f"""WITH {_I} SELECT batch_id, item_id, coalesce(regexp_full_match(job_id, '(doc)?[0-9a-f]{{32}}'), false) AS valid,
  coalesce(starts_with(source_path, '/srv/') AND NOT regexp_matches(source_path, '(^|/)\\.\\.(/|$)'), false) AS inside FROM i""",
    "state_labels": f"""WITH {_I}, {_R}, x AS (SELECT CASE coalesce(status, '') {_LABEL} WHEN '' THEN '未知' ELSE status END AS label FROM i UNION ALL
  SELECT CASE WHEN coalesce({_ST} = 'verified' AND annotation_complete, false) AND coalesce(lower(trim(annotation_mode)) = 'no_split', false) THEN '{_T[0]}' WHEN coalesce({_ST} = 'verified' AND annotation_complete, false) THEN '{_T[1]}'
    WHEN {_ST} = 'ambiguous' THEN '{_T[2]}' WHEN record_no % 3 = 0 THEN '{_T[3]}' WHEN record_no % 2 > 0 THEN '{_T[4]}' WHEN coalesce(human_panel_count, 0) > 0 THEN '{_T[5]}' ELSE '{_T[6]}' END FROM r)
SELECT label, count(*) AS n FROM x GROUP BY 1""",
    "aligned_labels": f"WITH {_F} SELECT figure_no, CASE figure_no % 3 WHEN 0 THEN upper(array_to_string(expected_panel_labels, '')) WHEN 1 THEN lower(array_to_string(expected_panel_labels, '')) ELSE array_to_string(expected_panel_labels, '') END AS labels FROM f",
    "size_scores": f"WITH {_F} SELECT figure_no, exp(-0.5::DOUBLE * power(ln(greatest(height_px / 900.0::DOUBLE, 1e-4)) / 0.24::DOUBLE, 2)) AS score FROM f WHERE height_px > 0",
    "reviewed_at_text": f"WITH {_R} SELECT record_no, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS reviewed FROM r WHERE reviewed_at IS NOT NULL",
    "note_texts": """WITH t AS (SELECT doc_id, regexp_replace(chr(97) || chr(13) || text || chr(13) || chr(10) || 'b', '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t) AS chars, length(t) <= 20000 AND NOT contains(t, chr(0)) AS fine FROM t""",
    "job_metrics": f"""WITH {_J} SELECT job_id, count(*) AS figures, count(*) AS processed, CAST(sum(n) AS BIGINT) AS panels, count(*) FILTER (n = 0) AS preserved, avg(CASE WHEN n > 0 THEN 1 - 1.0::DOUBLE / (n + 1) ELSE 0 END) AS mean_confidence,
  CAST(sum(n % 3) AS BIGINT) AS low_confidence, count(*) FILTER (again) AS extraction_review, CAST(sum(n % 3) AS BIGINT) + count(*) FILTER (again) AS needs_review FROM j GROUP BY 1""",
    "document_metrics": f"""WITH {_J} SELECT job_id, document_name, replace(document_name, ' ', '_') AS slug, string_agg(record_id, ',' ORDER BY record_id) AS records, count(*) AS figure_count, CAST(sum(n) AS BIGINT) AS panel_count,
  count(*) FILTER (again OR n % 3 > 0) AS needs_review FROM j GROUP BY 1, 2""",
    "responses": f"""WITH {_J} SELECT job_id, record_id, replace(document_name, ' ', '_') AS document_slug, n AS panel_count,
  md5(CASE WHEN CAST(substr(record_id, 2) AS INT) % 2 = 0 AND length(labels) > 2 THEN 'edited ' ELSE '' END || coalesce(caption, '')) AS caption_digest,
  CASE WHEN CAST(substr(record_id, 2) AS INT) % 2 = 0 THEN 'verified' END AS review_status FROM j""",
    "updated_items": f"""WITH {_I}, u AS (SELECT *, substr(job_id, 1, 1) IN ('0', '3', '6', '9', 'c') AS hit FROM i)
SELECT batch_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, count(*) AS items, count(*) FILTER (hit OR error = 'stopped') AS stopped, count(*) FILTER (filename = 'other') AS renamed FROM u GROUP BY 1, 2""",
    "training_records": f"""WITH {_F}, {_I}, s AS (SELECT job_id, max(nullif(regexp_extract(lower(trim(file_sha256)), '([0-9a-f]{{64}})', 1), '')) AS h FROM i GROUP BY 1),
g AS (SELECT f.*, sha256(image_path) AS image, CASE WHEN h IS NULL THEN 'job_' || f.job_id ELSE 'paper_' || h END AS grp, figure_no % 5 = 0 AS whole, figure_no % 7 = 0 AS bad, len(expected_panel_labels) AS n
  FROM f LEFT JOIN s ON s.job_id = f.job_id WHERE width_px > 0 AND height_px > 0 AND figure_id IS NOT NULL AND image_path IS NOT NULL),
x AS (SELECT *, CASE WHEN whole OR bad THEN 0 ELSE n END AS p, CASE WHEN NOT whole AND bad THEN n ELSE 0 END AS q FROM g),
y AS (SELECT *, figure_no % 2 = 0 AND figure_no % 3 <> 0 AND (whole OR p > 0) AND q = 0 AS fit FROM x)
SELECT figure_no, 'sample_' || substr(sha256(grp || chr(0) || figure_id || chr(0) || 'img_' || image), 1, 24) AS sample_id, grp AS source_group_id,
  'assets/images/img_' || image || lower(regexp_extract(image_path, '(\\.[^./]+)$', 1)) AS collection_path, p AS panels, q AS issues, fit AS ready_for_training, CASE WHEN fit THEN p END AS human_panel_count FROM y""",
    "preview_keys": f"""WITH {_F} SELECT figure_no, substr(sha1('["' || figure_id || '",' || width_px || ',' || figure_no || ',' || page_number || ',[' || block_index || ',' || dpi || '],150]'), 1, 16) AS key
FROM f WHERE image_path IS NOT NULL AND page_number IS NOT NULL AND width_px > 0""",
}
