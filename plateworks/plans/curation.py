"""Queries of annotations, the training collection, captions and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.functions import text
from plateworks.functions.notation import plain
from plateworks.operators import annotations, training
from plateworks.runtime import table


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits made of events: the user is the job; purchase crops, error deletes, view explains, signup and click review."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    op = F.expr("CASE event_type WHEN 'purchase' THEN 'crop' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'understanding' ELSE 'review' END")
    return e.select(
        F.col("user_id").cast("string").alias("job"), F.concat(F.lit("r00"), (n % 2).cast("string")).alias("record"), n.alias("seq"), op.alias("op"),
        F.when(op != "review", F.char(F.lit(65) + k % 3)).alias("label"),
        (k % 50).cast("int").alias("x0"), F.lit(10).alias("y0"), (k % 50 + k % 40 + 4).cast("int").alias("x1"), F.lit(60).alias("y1"),
        F.when(n % 3 != 0, (n % 3).cast("int")).alias("expected"), F.lit("text").alias("text"),
        F.expr("CASE event_type WHEN 'signup' THEN 'verified' WHEN 'click' THEN 'ambiguous' END").alias("status"),
        F.when(n % 4 == 0, "no_split").alias("mode"), F.concat(F.lit("rev-"), (n % 7).cast("string")).alias("reviewer"), (n % 11 != 0).alias("confirmed"),
        F.lit(100).alias("width"), F.lit(80).alias("height"),
    )


def edit_outcomes(spark, sf_dir):
    """Accepted and refused edits with the state of the figure after each."""
    return annotations.fold_edits(edits(spark, sf_dir))


def panel_versions(spark, sf_dir):
    """The versions of each panel if every edit is accepted."""
    return annotations.panel_versions(edits(spark, sf_dir)).drop("is_current")


def current_panels(spark, sf_dir):
    """The latest version of each panel."""
    return annotations.current_panels(annotations.panel_versions(edits(spark, sf_dir)))


def review_state(spark, sf_dir):
    """The review that holds."""
    return annotations.review_state(edits(spark, sf_dir))


def effective_panels(spark, sf_dir):
    """Boxes of active panels, by version or layout, and issues."""
    e = edits(spark, sf_dir)
    versions = annotations.panel_versions(e).join(e.select("job", "record", "label", "seq", "x0", "y0", "x1", "y1"), ["job", "record", "label", "seq"])
    boxes = versions.where("op = 'crop'").select("job", "record", "label", "version", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    # panels that were never cropped by hand are version 0; every fifth version lost its box
    now = annotations.current_panels(versions).select("job", "record", "label", F.col("version").cast("int").alias("current_version"), F.col("active"))
    targets = now.withColumn("active", F.when(F.col("active"), F.lit(None)).otherwise(F.col("current_version") == 0)).withColumn("width", F.lit(70)).withColumn("height", F.lit(80))
    layout = now.select("job", "record", "label", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(40.0).alias("y1"))
    out = annotations.effective_panels(targets, boxes, layout)
    return out.select("job", "record", "label", "panel_version", "box.*", "annotation_source", "issue")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records once each."""
    return table(spark, sf_dir, "training_records").dropDuplicates(["record_no"])


def review_summary(spark, sf_dir):
    """Review progress of each job."""
    rows = _records(spark, sf_dir).withColumn("review_status", plain(F.col("review_status")))
    return annotations.review_summary(rows, "job_id")


def training_summary(spark, sf_dir):
    """The summary of the collection."""
    return training.summary(_records(spark, sf_dir))


def training_manifest(spark, sf_dir):
    """Manifest entries in the order of job and record."""
    return training.manifest(_records(spark, sf_dir)).drop("annotation_complete")


def ready_flags(spark, sf_dir):
    """readiness worked out again, beside the stored flag."""
    r = _records(spark, sf_dir)
    again = training.ready(F.col("review_status"), F.col("annotation_complete"), F.col("annotation_mode"), F.coalesce("human_panel_count", F.lit(0)), F.lit(0))
    return r.select("record_no", again.alias("ready"), F.coalesce("ready_for_training", F.lit(False)).alias("stored"))


def sample_ids(spark, sf_dir):
    """Sample ids from group, figure and image."""
    return _records(spark, sf_dir).where("source_group_id IS NOT NULL AND figure_id IS NOT NULL AND image_id IS NOT NULL").select(
        "record_no", training.sample_id(F.col("source_group_id"), F.col("figure_id"), F.col("image_id")).alias("sample")
    )


def items_with_reviews(spark, sf_dir):
    """Completed items with the review progress of their job."""
    from plateworks.operators.queue import latest_items

    items = latest_items(table(spark, sf_dir, "batch_items")).where("status = 'completed'").select("job_id", "filename")
    return items.join(review_summary(spark, sf_dir), "job_id", "left").select(
        "job_id", "filename", F.coalesce("figure_count", F.lit(0)).alias("figure_count"), F.coalesce("review_state", F.lit("unreviewed")).alias("review_state")
    )


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "figures").dropDuplicates(["figure_no"])


def panels(spark, sf_dir) -> DataFrame:
    """Panels of each figure: upright strips of equal width, one for each expected label."""
    f = _figures(spark, sf_dir).where("width_px > 0 AND height_px > 0")
    n = F.size("expected_panel_labels")
    return f.select("figure_no", "width_px", "height_px", n.alias("n"), F.posexplode("expected_panel_labels").alias("i", "label")).select(
        "figure_no", "width_px", "height_px", "label",
        F.floor(F.col("i") * F.col("width_px") / F.col("n")).cast("double").alias("x0"), F.lit(0.0).alias("y0"),
        F.floor((F.col("i") + 1) * F.col("width_px") / F.col("n")).cast("double").alias("x1"), F.col("height_px").cast("double").alias("y1"),
    )


def yolo_labels(spark, sf_dir):
    """The label text of each figure; empty where it is not divided."""
    boxes = panels(spark, sf_dir).groupBy("figure_no").agg(F.array_sort(F.collect_list(F.struct("label", F.struct("x0", "y0", "x1", "y1").alias("b")))).alias("s"))
    f = _figures(spark, sf_dir).where("width_px > 0 AND height_px > 0").select("figure_no", "width_px", "height_px").join(boxes, "figure_no", "left")
    return f.select("figure_no", training.yolo_text(F.transform("s", lambda x: x["b"]), F.col("width_px"), F.col("height_px")).alias("label_text"))


def figure_counts(spark, sf_dir):
    """Figures of each job by kind, panels, review items."""
    f = _figures(spark, sf_dir)
    again = text.needs_review(F.col("quality_flags"))
    return f.groupBy("job_id").agg(
        F.count("*").alias("figures"), F.count_if(text.caption_kind(F.col("caption_kind")) == "scheme").alias("schemes"),
        F.sum(F.size("expected_panel_labels")).alias("panels"), F.count_if(again).alias("to_review"),
        F.count_if(again | F.coalesce("needs_review", F.lit(False))).alias("any_review"), F.count_if(F.col("caption").isNull()).alias("without_caption"),
    )


def quality_flags(spark, sf_dir):
    """Figures by flag, and whether the flag asks for a review."""
    flags = _figures(spark, sf_dir).select("figure_no", F.explode(F.array_distinct("quality_flags")).alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("figures"), F.max(~F.col("flag").isin(*text.INFORMATIONAL)).alias("asks"))


def figure_ids(spark, sf_dir):
    """Ids of figures, with a suffix where two of a job collide."""
    kind = F.when(text.caption_kind(F.col("caption_kind")) == "scheme", "scheme").otherwise("fig")
    prefix = F.when(F.col("caption").isNull(), "figure").otherwise(F.concat(kind, F.coalesce("caption_figure_number", F.lit(""))))
    base = text.sanitize_name(F.concat(prefix, F.format_string("_p%02d_b%02d", "page_number", "block_index")))
    rows = _figures(spark, sf_dir).withColumn("base", base)
    n = F.row_number().over(W.partitionBy("job_id", "base").orderBy("figure_no"))
    return rows.select("figure_no", "base", n.alias("n")).select("figure_no", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("figure"))


def caption_parts(spark, sf_dir):
    """Kind, number, delimiter and body of the captions."""
    p = text.caption_parts(F.col("caption"))
    return _figures(spark, sf_dir).where("caption IS NOT NULL").select("figure_no", *[c.alias(k) for k, c in p.items() if k != "body"])


def formal_captions(spark, sf_dir):
    """captions that are more than a mention."""
    return _figures(spark, sf_dir).where(text.is_formal_caption(F.col("caption"))).select("figure_no")


def best_captions(spark, sf_dir):
    """The best caption of each kind and number in a job, by rank, span, length and page."""
    p = text.caption_parts(F.col("caption"))
    span = F.col("caption_end_page_number") - F.col("caption_page_number")
    rows = _figures(spark, sf_dir).where(text.is_formal_caption(F.col("caption"))).select(
        "job_id", p["kind"].alias("kind"), p["number"].alias("number"), "figure_no",
        F.struct(
            text.caption_rank(F.col("caption"), F.lit(False), F.lit(0.0), F.coalesce(span, F.lit(0))).alias("score"), (-F.coalesce(span, F.lit(0))).alias("span"),
            F.length("caption").alias("length"), (-F.coalesce("caption_page_number", F.lit(0))).alias("page"), (-F.col("figure_no")).alias("first"),
        ).alias("rank"),
    )
    return rows.groupBy("job_id", "kind", "number").agg(F.max_by("figure_no", "rank").alias("figure_no"))


def expected_labels(spark, sf_dir):
    """Panel labels that the captions name."""
    return text.with_expected_labels(_figures(spark, sf_dir)).select("figure_no", F.array_join("labels", "").alias("labels"))


def label_sets(spark, sf_dir):
    """Labels of caption and figure together."""
    f = annotations.label_sets(text.with_expected_labels(_figures(spark, sf_dir)), F.col("expected_panel_labels"), F.col("labels"), F.array(F.lit("A")))
    return f.select("figure_no", F.array_join("editable", "").alias("editable"), "expected_found")


def headings(spark, sf_dir):
    """lines of the documents that look like headings, by document."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.looks_like_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("headings"))


def safe_names(spark, sf_dir):
    """File names made safe."""
    names = table(spark, sf_dir, "batch_items").where("filename IS NOT NULL").select("filename").distinct()
    c = F.col("filename")
    return names.select("filename", text.sanitize_name(c).alias("sanitized"), text.safe_name(c).alias("safe"), text.document_slug(c).alias("slug"), text.document_job_id(c).alias("job"))


def page_ranges(spark, sf_dir):
    """the pages that a figure's caption spans, widened by one."""
    f = _figures(spark, sf_dir).where("caption_page_number >= 1 AND caption_end_page_number >= caption_page_number")
    pages = text.page_numbers(F.concat_ws("-", F.col("caption_page_number").cast("string"), F.col("caption_end_page_number").cast("string")))
    wide = F.array_sort(F.array_distinct(F.flatten(F.transform(pages, lambda p: F.sequence(F.greatest(p - 1, F.lit(1)), p + 1)))))
    return f.select("figure_no", F.size(pages).alias("pages"), F.array_min(wide).alias("first"), F.array_max(wide).alias("last"))


def job_figures(spark, sf_dir):
    """Records joined to extracted figures by figure id or file name, the first that fits."""
    r = _records(spark, sf_dir).select("record_no", "job_id", F.col("figure_id").alias("f"), F.col("image.file_name").alias("name"))
    f = _figures(spark, sf_dir).select("job_id", "figure_no", "figure_id", F.element_at(F.split("image_path", "/"), -1).alias("name"))
    by_id = r.join(f.select("job_id", F.col("figure_id").alias("f"), "figure_no"), ["job_id", "f"]).select("record_no", "figure_no")
    by_name = r.join(f.select("job_id", "name", "figure_no"), ["job_id", "name"]).select("record_no", "figure_no")
    return by_id.unionByName(by_name).groupBy("record_no").agg(F.min("figure_no").alias("figure_no"))


QUERIES = {f.__name__: f for f in (
    edit_outcomes, panel_versions, current_panels, review_state, effective_panels, review_summary, training_summary, training_manifest, ready_flags, sample_ids,
    items_with_reviews, yolo_labels, figure_counts, quality_flags, figure_ids, caption_parts, formal_captions, best_captions, expected_labels, label_sets, headings,
    safe_names, page_ranges, job_figures,
)}

_E = """e AS (SELECT CAST(user_id AS VARCHAR) AS job, 'r00' || CAST(event_id % 2 AS VARCHAR) AS record, event_id AS seq, event_type,
  coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k,
  CASE event_type WHEN 'purchase' THEN 'crop' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'understanding' ELSE 'review' END AS op FROM events),
v AS (SELECT job, record, chr(65 + k % 3) AS label, seq, op, k, op = 'crop' AS active,
  count(*) FILTER (op = 'crop') OVER (PARTITION BY job, record, chr(65 + k % 3) ORDER BY seq ROWS UNBOUNDED PRECEDING) AS version
  FROM e WHERE op IN ('crop', 'delete'))"""
_R = "r AS (SELECT DISTINCT ON (record_no) * FROM training_records)"
_F = "f AS (SELECT DISTINCT ON (figure_no) * FROM figures)"
_ST = "nullif(lower(trim(review_status)), '')"
_SUMMARY = f"""s AS (SELECT job_id, count(*) AS figure_count, count(*) FILTER ({_ST} = 'verified' AND coalesce(annotation_complete, false)) AS verified_count,
  count(*) FILTER ({_ST} = 'ambiguous') AS ambiguous_count FROM r GROUP BY 1),
t AS (SELECT *, CASE WHEN verified_count = figure_count THEN 'verified' WHEN verified_count > 0 THEN 'partial' WHEN ambiguous_count > 0 THEN 'ambiguous'
  ELSE 'unreviewed' END AS review_state FROM s)"""
_C = "(?is)^((?:fig(?:ure)?\\.?|图|(?:reaction\\s+)?(?:schemes?|sch)\\.?))\\s*((?:[A-Za-z]?[0-9]+[A-Za-z0-9-]*(?:\\.[0-9]+[A-Za-z0-9-]*)*))(\\s*[.:：。|])?\\s*(.*)"
_SP = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+"
_CLEAN = f"trim(regexp_replace(coalesce(%s, ''), '{_SP}', ' ', 'g'))"
_KIND = "CASE WHEN regexp_replace(lower(%s), '[.\\s]+', '', 'g') LIKE '%%scheme%%' OR regexp_replace(lower(%s), '[.\\s]+', '', 'g') LIKE 'sch%%' THEN 'scheme' ELSE 'figure' END"
_G1 = f"regexp_extract(caption, '{_C}', 1)"
_PARTS = f"""p AS (SELECT *, regexp_matches(caption, '{_C}') AS is_caption, {_KIND % (_G1, _G1)} AS kind, upper(regexp_extract(caption, '{_C}', 2)) AS number,
  {_CLEAN % f"regexp_extract(caption, '{_C}', 3)"} AS delimiter, {_CLEAN % f"regexp_extract(caption, '{_C}', 4)"} AS body FROM f WHERE caption IS NOT NULL),
q AS (SELECT *, is_caption AND number <> '' AND body <> '' AND NOT (delimiter = '' AND (regexp_matches(body, '(?i)^(?:shows?|showed|presents?|illustrates?|depicts?|demonstrates?|indicates?|compares?|summarizes?|describes?|reveals?|suggests?)\\b')
  OR NOT regexp_full_match(number, '[0-9]+') OR len(string_split(body, ' ')) < 3)) AS formal FROM p)"""
_STEM = "CASE WHEN regexp_matches({0}, '^.+\\.[^.]*[^.]$') AND NOT regexp_matches({0}, '^\\.+[^.]*$') THEN regexp_replace({0}, '\\.[^.]*$', '') ELSE {0} END"
_SAFE = "substr(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 1, 80)"

SQL = {
    "panel_versions": f"WITH {_E} SELECT job, record, label, seq, op, version, active FROM v",
    "current_panels": f"WITH {_E} SELECT job, record, label, arg_max(version, seq) AS version, arg_max(active, seq) AS active FROM v GROUP BY 1, 2, 3",
    "review_state": f"""WITH {_E}, g AS (SELECT job, record, count(*) AS edits, max(seq) FILTER (op = 'review') AS r, max(seq) FILTER (op IN ('crop', 'delete')) AS c,
  arg_max(CASE event_type WHEN 'signup' THEN 'verified' WHEN 'click' THEN 'ambiguous' END, seq) FILTER (op = 'review') AS s FROM e GROUP BY 1, 2)
SELECT job, record, edits, CASE WHEN r IS NULL OR c > r THEN 'proposed' ELSE s END AS status FROM g""",
    "effective_panels": f"""WITH {_E}, n AS (SELECT job, record, label, arg_max(version, seq) AS ver, arg_max(active, seq) AS act FROM v GROUP BY 1, 2, 3),
b AS (SELECT job, record, label, version, k % 50 AS x0, 10 AS y0, k % 50 + k % 40 + 4 AS x1, 60 AS y1 FROM v WHERE op = 'crop'),
j AS (SELECT n.*, b.x0, b.y0, b.x1, b.y1, coalesce(b.x0 < b.x1 AND b.x1 <= 70 AND b.y1 <= 80, false) AS ok
  FROM n LEFT JOIN b ON n.job = b.job AND n.record = b.record AND n.label = b.label AND n.ver = b.version WHERE act OR ver = 0)
SELECT job, record, label, CAST(ver AS INT) AS panel_version, CAST(CASE WHEN ok THEN x0 WHEN ver = 0 THEN 0 END AS DOUBLE) AS x0, CAST(CASE WHEN ok THEN y0 WHEN ver = 0 THEN 0 END AS DOUBLE) AS y0,
  CAST(CASE WHEN ok THEN x1 WHEN ver = 0 THEN 40 END AS DOUBLE) AS x1, CAST(CASE WHEN ok THEN y1 WHEN ver = 0 THEN 40 END AS DOUBLE) AS y1,
  CASE WHEN ok THEN 'human_manual' WHEN ver = 0 THEN 'rule_proposal' END AS annotation_source,
  CASE WHEN NOT ok AND ver <> 0 THEN 'panel_' || label || '_missing_or_invalid_bbox' END AS issue FROM j""",
    "review_summary": f"WITH {_R}, {_SUMMARY} SELECT * FROM t",
    "training_summary": f"""WITH {_R} SELECT '1.1' AS schema_version, count(*) AS samples, count(DISTINCT image_id) AS unique_images, count(DISTINCT source_group_id) AS source_groups,
  count(*) FILTER ({_ST} = 'proposed') AS proposed, count(*) FILTER ({_ST} = 'verified') AS verified, count(*) FILTER ({_ST} = 'ambiguous') AS ambiguous,
  count(*) FILTER (ready_for_training) AS ready_for_training, count(*) FILTER (ready_for_training AND lower(trim(annotation_mode)) = 'no_split') AS no_split,
  count(*) FILTER (ready_for_training AND lower(trim(annotation_mode)) IS DISTINCT FROM 'no_split') AS panel_box_samples,
  CAST(coalesce(sum(human_panel_count), 0) AS BIGINT) AS candidate_panels, CAST(coalesce(sum(human_panel_count) FILTER (ready_for_training), 0) AS BIGINT) AS verified_panels FROM r""",
    "training_manifest": f"""WITH {_R} SELECT record_no, sample_id, image_id, paper_id, source_group_id, figure_id, review_status, annotation_mode, ready_for_training, annotation_version,
  'assets/images/' || image_id || '.png' AS image_path, 'annotations/' || sample_id || '.json' AS annotation_path,
  CASE WHEN ready_for_training THEN 'ready/images/' || sample_id || '.png' END AS ready_image_path,
  CASE WHEN ready_for_training THEN 'ready/labels/' || sample_id || '.txt' END AS ready_label_path FROM r""",
    "ready_flags": f"""WITH {_R} SELECT record_no, coalesce({_ST} = 'verified' AND annotation_complete AND (lower(trim(annotation_mode)) = 'no_split' OR coalesce(human_panel_count, 0) > 0), false) AS ready,
  coalesce(ready_for_training, false) AS stored FROM r""",
    "sample_ids": f"""WITH {_R} SELECT record_no, 'sample_' || substr(sha256(source_group_id || chr(0) || figure_id || chr(0) || image_id), 1, 24) AS sample FROM r
WHERE source_group_id IS NOT NULL AND figure_id IS NOT NULL AND image_id IS NOT NULL""",
    "items_with_reviews": f"""WITH {_R}, {_SUMMARY}, i AS (SELECT * EXCLUDE (status), nullif(lower(trim(status)), '') AS status FROM batch_items
  WHERE changed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, item_id ORDER BY changed_at DESC, load_no DESC) = 1)
SELECT i.job_id, filename, coalesce(figure_count, 0) AS figure_count, coalesce(review_state, 'unreviewed') AS review_state FROM i LEFT JOIN t USING (job_id) WHERE status = 'completed'""",
    "yolo_labels": f"""WITH {_F}, x AS (SELECT figure_no, width_px AS w, height_px AS h, len(expected_panel_labels) AS n, unnest(expected_panel_labels) AS label,
  generate_subscripts(expected_panel_labels, 1) - 1 AS i FROM f WHERE width_px > 0 AND height_px > 0),
y AS (SELECT figure_no, label, w, h, floor(i * w / n) AS x0, floor((i + 1) * w / n) AS x1 FROM x),
z AS (SELECT figure_no, string_agg(printf('0 %.8f %.8f %.8f %.8f', (x0 + x1) / (2.0::DOUBLE * w), 0.5::DOUBLE, (x1 - x0) / w::DOUBLE, 1.0::DOUBLE) || chr(10), '' ORDER BY label) AS t FROM y GROUP BY 1)
SELECT figure_no, coalesce(t, '') AS label_text FROM f LEFT JOIN z USING (figure_no) WHERE width_px > 0 AND height_px > 0""",
    "figure_counts": f"""WITH {_F}, g AS (SELECT *, len(list_filter(quality_flags, lambda x: x NOT IN ('caption_guided_component_merge', 'native_context_expanded', 'caption_spans_pages', 'cross_page_caption_match', 'compact_scheme_candidate'))) > 0 AS again FROM f)
SELECT job_id, count(*) AS figures, count(*) FILTER (lower(caption_kind) LIKE '%scheme%') AS schemes, CAST(sum(len(expected_panel_labels)) AS BIGINT) AS panels, count(*) FILTER (again) AS to_review,
  count(*) FILTER (coalesce(again, false) OR coalesce(needs_review, false)) AS any_review, count(*) FILTER (caption IS NULL) AS without_caption FROM g GROUP BY 1""",
    "quality_flags": f"""WITH {_F}, g AS (SELECT figure_no, unnest(list_distinct(quality_flags)) AS flag FROM f)
SELECT flag, count(*) AS figures, flag NOT IN ('caption_guided_component_merge', 'native_context_expanded', 'caption_spans_pages', 'cross_page_caption_match', 'compact_scheme_candidate') AS asks FROM g GROUP BY 1""",
    "caption_parts": f"WITH {_F}, {_PARTS} SELECT figure_no, is_caption, kind, number, delimiter FROM p",
    "formal_captions": f"WITH {_F}, {_PARTS} SELECT figure_no FROM q WHERE formal",
    "best_captions": f"""WITH {_F}, {_PARTS}, s AS (SELECT *, coalesce(caption_end_page_number - caption_page_number, 0) AS span FROM q WHERE formal)
SELECT job_id, kind, number, figure_no FROM s QUALIFY row_number() OVER (PARTITION BY job_id, kind, number ORDER BY
  CASE WHEN delimiter <> '' THEN 6.0 ELSE 0 END + CASE WHEN length(body) BETWEEN 8 AND 1600 THEN 2.0 ELSE 0 END - 0.75 * span DESC, span, length(caption) DESC, coalesce(caption_page_number, 0), figure_no) = 1""",
    "headings": f"""WITH l AS (SELECT doc_id, {_CLEAN % 'unnest(string_split(text, chr(10)))'} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS headings FROM l WHERE length(t) <= 90 AND (regexp_matches(t, '^[0-9]+(\\.[0-9]+)* [A-Z]') OR (upper(t) = t AND lower(t) <> t)) GROUP BY 1""",
    "safe_names": f"""WITH n AS (SELECT DISTINCT filename, regexp_extract(filename, '([^/]*)/*$', 1) AS b FROM batch_items WHERE filename IS NOT NULL),
s AS (SELECT *, {_STEM.format('b')} AS stem, {_CLEAN % 'filename'} AS c FROM n),
t AS (SELECT *, coalesce(nullif({_SAFE.format('stem')}, ''), 'upload') AS safe_stem, CASE WHEN stem <> b THEN lower(regexp_extract(b, '(\\.[^.]*)$', 1)) ELSE '' END AS suffix,
  coalesce(nullif({_SAFE.format('b')}, ''), 'upload') AS slug FROM s)
SELECT filename, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(c, ''), 'item'), '[<>:"/\\\\|?*]+', '_', 'g'), ' +', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'item') AS sanitized,
  safe_stem || suffix AS safe, CASE WHEN length(slug) <= 48 THEN slug ELSE regexp_replace(substr(slug, 1, 39), '[ ._-]+$', '') || '_' || substr(sha1(filename), 1, 8) END AS slug,
  'doc' || substr(sha256(filename), 1, 32) AS job FROM t""",
    "page_ranges": f"""WITH {_F} SELECT figure_no, caption_end_page_number - caption_page_number + 1 AS pages, greatest(caption_page_number - 1, 1) AS first, caption_end_page_number + 1 AS last
FROM f WHERE caption_page_number >= 1 AND caption_end_page_number >= caption_page_number""",
    "figure_ids": f"""WITH {_F}, b AS (SELECT figure_no, job_id, regexp_replace(CASE WHEN caption IS NULL THEN 'figure' WHEN lower(caption_kind) LIKE '%scheme%' THEN 'scheme' || coalesce(caption_figure_number, '')
  ELSE 'fig' || coalesce(caption_figure_number, '') END || printf('_p%02d_b%02d', page_number, block_index), '^[ ._]+|[ ._]+$', '', 'g') AS base FROM f)
SELECT figure_no, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS figure FROM (SELECT *, row_number() OVER (PARTITION BY job_id, base ORDER BY figure_no) AS n FROM b)""",
    "job_figures": f"""WITH {_R}, {_F} SELECT record_no, min(figure_no) AS figure_no FROM r JOIN f ON r.job_id = f.job_id AND (r.figure_id = f.figure_id OR r.image.file_name = string_split(f.image_path, '/')[-1]) GROUP BY 1""",
}
