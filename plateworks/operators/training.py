"""The training collection: records, manifests, labels and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.functions.notation import plain

SCHEMA_VERSION = "1.1"


def source_group(file_sha256: Column, is_pdf: Column, job_id: Column) -> Column:
    """paper_, source_ or job_ id of a record's source."""
    return F.when(file_sha256.isNull(), F.concat(F.lit("job_"), job_id)).when(is_pdf, F.concat(F.lit("paper_"), file_sha256)).otherwise(
        F.concat(F.lit("source_"), file_sha256)
    )


def sample_id(group: Column, figure_id: Column, image_id: Column) -> Column:
    return F.concat(F.lit("sample_"), F.substring(F.sha2(F.concat_ws("\0", group, figure_id, image_id), 256), 1, 24))


def mode_of(c: Column) -> Column:
    """panel_boxes unless no_split."""
    return F.when(plain(c) == "no_split", "no_split").otherwise("panel_boxes")


def ready(status: Column, complete: Column, mode: Column, panels: Column, issues: Column) -> Column:
    """Verified, complete, with panels or without need of any, and no issues."""
    split = mode_of(mode) == "no_split"
    return F.coalesce((plain(status) == "verified") & complete & (split | (panels > 0)) & (split | (issues == 0)), F.lit(False))


def yolo_text(boxes: Column, width: Column, height: Column) -> Column:
    """One line `0 xc yc w h` for each box struct(x0, y0, x1, y1), normalised, each with a line end; empty without boxes.

    A box outside the image raises.
    """
    def line(b: Column) -> Column:
        w, h = width.cast("double"), height.cast("double")
        v = [(b["x0"] + b["x1"]) / (w * 2), (b["y0"] + b["y1"]) / (h * 2), (b["x1"] - b["x0"]) / w, (b["y1"] - b["y0"]) / h]
        fine = v[0].between(0, 1) & v[1].between(0, 1) & v[2].between(0, 1) & v[3].between(0, 1)
        return F.when(F.coalesce(fine, F.lit(False)), F.format_string("0 %.8f %.8f %.8f %.8f\n", *v)).otherwise(
            F.raise_error(F.concat(F.lit("invalid normalized box: "), F.to_json(b))).cast("string")
        )

    return F.array_join(F.transform(F.coalesce(boxes, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), line), "")


def build_records(figures: DataFrame, panels: DataFrame, sources: DataFrame, collected_at: Column) -> DataFrame:
    """One training record for each figure, with its panels and issues, image, provenance and whether it is ready.

    figures: job_id, record_id, figure_id, figure_number, caption_kind, caption, image struct, image_sha256, review_status,
    annotation_mode, annotation_complete, annotation_version, reviewer, reviewed_at. panels: as effective_panels() gives
    them (job, record, label, box, annotation_source, panel_version, issue). sources: job_id, file_sha256, is_pdf. A figure that isn't to be split
    has neither panels nor issues; the number of panels is null unless it is ready.
    """
    panel = F.struct("label", F.array(*[F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("bbox_xyxy"), "panel_version", "annotation_source")
    p = panels.groupBy(F.col("job").alias("job_id"), F.col("record").alias("record_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("box").isNotNull(), panel))).alias("_p"), F.array_sort(F.collect_list("issue")).alias("_i")
    )
    s = sources.groupBy("job_id").agg(F.max(F.struct("file_sha256", "is_pdf")).alias("_s"))
    rows = figures.join(p, ["job_id", "record_id"], "left").join(s, "job_id", "left")
    group = source_group(F.col("_s.file_sha256"), F.coalesce("_s.is_pdf", F.lit(False)), F.col("job_id"))
    mode = mode_of(F.col("annotation_mode"))
    whole = mode == "no_split"
    pan = F.when(whole | F.col("_p").isNull(), F.array().cast(p.schema["_p"].dataType)).otherwise(F.col("_p"))
    iss = F.when(whole | F.col("_i").isNull(), F.array().cast("array<string>")).otherwise(F.col("_i"))
    image_id = F.concat(F.lit("img_"), "image_sha256")
    out = rows.withColumn("image_id", image_id).withColumn("source_group_id", group).withColumn("panels", pan).withColumn("issues", iss).withColumn("annotation_mode", mode)
    out = out.withColumn("review_status", F.coalesce("review_status", F.lit("proposed"))).withColumn("annotation_complete", F.coalesce("annotation_complete", F.lit(False)))
    out = out.withColumn("ready_for_training", ready(F.col("review_status"), F.col("annotation_complete"), F.col("annotation_mode"), F.size("panels"), F.size("issues")))
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), sample_id(F.col("source_group_id"), F.col("figure_id"), F.col("image_id")).alias("sample_id"), "image_id",
        F.when(F.coalesce("_s.is_pdf", F.lit(False)), F.concat(F.lit("paper_"), "_s.file_sha256")).alias("paper_id"), "source_group_id", "figure_id", "figure_number", "caption_kind",
        F.coalesce("caption", F.lit("")).alias("caption"),
        F.struct("image.file_name", F.concat(F.lit("assets/images/"), "image_id", F.lower(F.regexp_extract("image.file_name", "(\\.[^./]+)$", 1))).alias("collection_path"), "image.width", "image.height", F.col("image_sha256").alias("file_sha256"), F.lit(300).alias("dpi")).alias("image"),
        F.lit("original_figure_pixels").alias("coordinate_space"), F.lit("xyxy").alias("bbox_format"), F.lit("zero_based_half_open").alias("coordinate_convention"),
        "review_status", "annotation_mode", "annotation_complete", F.coalesce("annotation_version", F.lit(0)).alias("annotation_version"),
        F.when(F.col("ready_for_training"), F.size("panels")).alias("human_panel_count"), "reviewer", "reviewed_at", "ready_for_training", "panels", "issues",
        F.struct("job_id", "record_id", F.col("_s.file_sha256").alias("source_sha256")).alias("provenance"), collected_at.alias("collected_at"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """The manifest entry of each record, with the paths it has in the collection."""
    path = lambda folder, ext, c: F.concat(F.lit(folder), F.col(c), F.lit(ext))
    when_ready = lambda c: F.when(F.coalesce("ready_for_training", F.lit(False)), c)
    return records.select(
        "record_no", "sample_id", "image_id", "paper_id", "source_group_id", "figure_id", "review_status", "annotation_mode", "annotation_complete",
        "ready_for_training", "annotation_version",
        path("assets/images/", ".png", "image_id").alias("image_path"), path("annotations/", ".json", "sample_id").alias("annotation_path"),
        when_ready(path("ready/images/", ".png", "sample_id")).alias("ready_image_path"),
        when_ready(path("ready/labels/", ".txt", "sample_id")).alias("ready_label_path"),
    )


def summary(records: DataFrame) -> DataFrame:
    """The one-row summary; samples are rows, images and groups are distinct."""
    status, mode = plain(F.col("review_status")), mode_of(F.col("annotation_mode"))
    is_ready, panels = F.coalesce("ready_for_training", F.lit(False)), F.coalesce("human_panel_count", F.lit(0))
    return records.agg(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.count("*").alias("samples"), F.count_distinct("image_id").alias("unique_images"), F.count_distinct("source_group_id").alias("source_groups"),
        *[F.count_if(status == s).alias(s) for s in ("proposed", "verified", "ambiguous")],
        F.count_if(is_ready).alias("ready_for_training"), F.count_if(is_ready & (mode == "no_split")).alias("no_split"),
        F.count_if(is_ready & (mode == "panel_boxes")).alias("panel_box_samples"),
        F.coalesce(F.sum(panels), F.lit(0)).alias("candidate_panels"), F.coalesce(F.sum(F.when(is_ready, panels)), F.lit(0)).alias("verified_panels"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those that new has, and the new ones: a rewrite for tables without MERGE."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def stale_ready(ready_ids: DataFrame, records: DataFrame) -> DataFrame:
    """Published samples that are ready no longer, to be removed."""
    return ready_ids.join(records.where("ready_for_training").select("sample_id").distinct(), "sample_id", "left_anti")
