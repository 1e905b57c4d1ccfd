"""Files as tables: folder scans, images, JSON states, tab-separated words, page objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.runtime import numbered

#: Suffixes of image files; limits of an upload.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
MAX_FILES, MAX_BYTES = 2000, 80 * 1024 * 1024

STATE = (
    "job_id string, created_at string, updated_at string, figures map<string, struct<record_id:string, document_name:string, figure_id:string, "
    "figure_number:string, caption_kind:string, caption:string, source_path:string, panel_dir:string, review_status:string, annotation_mode:string, "
    "annotation_complete:boolean, annotation_version:int, reviewer:string, reviewed_at:string, panels:map<string, struct<label:string, "
    "current_version:int, active:boolean, versions:array<struct<version:int, kind:string, created_at:string, path:string, bbox_px:array<double>>>>>>>"
)
MANIFEST = (
    "document_name string, figures array<struct<figure_id:string, whole_path:string, preview_path:string, caption:string, caption_kind:string, "
    "expected_panel_labels:array<string>, needs_review:boolean, panels:array<struct<label:string, path:string, confidence:double>>>>"
)
PAGE_BLOCKS = (
    "pdf string, page_number int, block_index int, kind string, text string, x0 double, y0 double, x1 double, y1 double, font_size_pt double, "
    "font_name string, bold boolean, n_items int"
)


def _listed(spark: SparkSession, root: str, pattern: str, recursive: bool) -> DataFrame:
    """(path, length) of files; the contents are not read, as the column is pruned."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
        .select(F.regexp_replace("path", "^file:", "").alias("path"), "length", F.col("modificationTime").alias("modified"))
    )


def pdf_folder(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """PDF files of a folder in the order of their paths, with item ids i000001 on.

    The numbers come from a range sort of (path, length), part by part.
    """
    rows = numbered(_listed(spark, root, "*.pdf", recursive), ["path"], "n")
    return rows.select(
        F.format_string("i%06d", "n").alias("item_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("source_path"),
        F.col("length").alias("size_bytes"),
    )


def folder_counts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, files): PDF files directly in each folder under the root, in the order of lower-case names."""
    rows = _listed(spark, root, "*.pdf", True).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files")).orderBy(F.lower("folder"))


def upload_check(files: DataFrame) -> DataFrame:
    """files (filename, length) with the reason why an upload is refused, null if it is fine; too many files refuse all."""
    n = files.count()
    return files.withColumn(
        "refused",
        F.when(F.lit(n > MAX_FILES), "too many files").when(~F.lower("filename").endswith(".pdf"), "not a PDF")
        .when(F.coalesce("length", F.lit(0)) <= 0, "empty").when(F.col("length") > MAX_BYTES, "too large"),
    )


def images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, width, height, channels, data) of image files, once each; bytes are blue, green, red.

    Files that no decoder reads come with width -1; EXIF turns are not applied. WebP has no decoder here.
    """
    df = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false").load(root)
    i = F.col("image")
    return df.select(
        F.regexp_replace(i.origin, "^file:/+", "/").alias("path"), i.width.alias("width"), i.height.alias("height"), i.nChannels.alias("channels"), i.data.alias("data")
    ).where(F.lower(F.element_at(F.split("path", "\\."), -1)).isin(*IMAGE_SUFFIXES)).dropDuplicates(["path"])


def json_states(spark: SparkSession, glob: str, schema: str = STATE) -> DataFrame:
    """One row per JSON file, with the name of its folder as `folder`; a corrupt file gives nulls."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(glob)
    return rows.withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2))


def editor_figures(states: DataFrame) -> DataFrame:
    """One row per figure of the editor states, with the defaults of older files filled in."""
    rows = states.select(F.coalesce("job_id", "folder").alias("job"), F.explode("figures").alias("record", "f")).select("job", "record", "f.*")
    mode = F.when(F.col("annotation_mode").isin("panel_boxes", "no_split"), F.col("annotation_mode")).otherwise("panel_boxes")
    return (
        rows.withColumn("review_status", F.coalesce("review_status", F.lit("proposed"))).withColumn("annotation_mode", mode)
        .withColumn("annotation_complete", F.coalesce("annotation_complete", F.lit(False))).withColumn("annotation_version", F.coalesce("annotation_version", F.lit(0)))
    )


def manifest_figures(manifests: DataFrame) -> DataFrame:
    """One row per figure of the document manifests."""
    return manifests.select("document_name", F.posexplode("figures").alias("ordinal", "f")).select(
        "document_name", "ordinal", "f.*", F.size(F.coalesce("f.panels", F.array())).alias("panel_count"),
        F.array_sort(F.array_union(F.coalesce("f.expected_panel_labels", F.array().cast("array<string>")), F.coalesce(F.transform("f.panels", lambda p: p["label"]), F.array().cast("array<string>")))).alias("labels"),
    )


def ocr_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(key, line) of an OCR file in tabs, and its header."""
    text = spark.read.text(path).withColumn("key", F.col("_metadata.file_path")).where(F.trim("value") != "")
    first = text.first()
    header = first["value"].split("\t") if first else []
    return text.where(F.col("value") != (first["value"] if first else "")).select("key", F.col("value").alias("line")), header


def page_objects(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of pages from JSON lines (PAGE_BLOCKS), in reading order when sorted by page, y0, x0."""
    return spark.read.schema(PAGE_BLOCKS).json(path)
