"""Jobs and their records: inputs checked, records of responses, metrics of jobs and documents, changes of items, guards and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions.notation import plain
from plateworks.functions.text import document_slug
from plateworks.operators.ledger import CommitLog, CommitTaken

#: What the interface calls the states of batches.
BATCH_LABELS = {"queued": "排队中", "running": "处理中", "processing": "处理中", "completed": "已完成", "completed_with_errors": "完成（有失败）", "failed": "失败"}
#: What it calls the states of records, the first that fits.
RECORD_LABELS = (
    "已校验完成 · 无需划分", "已校验完成（人工确认）", "人工标记：存在歧义", "整图提取需复核", "切分结果需复核", "自动候选，尚未整图确认", "证据不足，等待人工标注",
)
#: The columns of an item that an update may change.
CHANGEABLE = ("status", "started_at", "completed_at", "message", "error", "metrics_json")
#: What a response takes over from a record.
RESPONSE = (
    "document_name", "figure_id", "figure_number", "caption_kind", "caption", "page_number", "labels", "panel_count", "mean_confidence", "low_confidence_panels",
    "expected_labels", "extraction_method", "extraction_quality_flags", "extraction_needs_review",
)


def refused_input(path: Column, dpi: Column, sides: Sequence[Column], first_page: Column) -> Column:
    """Why the inputs of an extraction are refused, null if they are fine."""
    least = sides[0]
    for s in sides[1:]:
        least = F.least(least, s)
    return (
        F.when(path.isNull() | ~F.lower(path).endswith(".pdf"), "not a PDF").when(F.coalesce(dpi, F.lit(0)) <= 0, "dpi must be positive")
        .when(least < 0, "sizes must not be negative").when(first_page < 1, "pages count from 1")
    )


def inside(root: Column | str, path: Column) -> Column:
    """Whether a path lies under the root, without steps upward."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.coalesce(F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))) & ~path.rlike("(?:^|/)\\.\\.(?:/|$)"), F.lit(False))


def job_id_valid(c: Column) -> Column:
    """32 hex digits, or those behind `doc`."""
    return F.coalesce(c.rlike("^(?:doc)?[0-9a-f]{32}$"), F.lit(False))


def batch_label(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in BATCH_LABELS.items() for x in kv])
    s = F.coalesce(status, F.lit(""))
    return F.coalesce(F.try_element_at(known, s), F.when(s == "", "未知").otherwise(s))


def record_label(status: Column, complete: Column, mode: Column, extraction: Column, low: Column, panels: Column) -> Column:
    t = RECORD_LABELS
    no = lambda c: F.coalesce(c, F.lit(False))
    done = no((plain(status) == "verified") & complete)
    return (
        F.when(done & no(plain(mode) == "no_split"), t[0]).when(done, t[1]).when(no(plain(status) == "ambiguous"), t[2]).when(no(extraction), t[3])
        .when(F.coalesce(low, F.lit(0)) > 0, t[4]).when(F.coalesce(panels, F.lit(0)) > 0, t[5]).otherwise(t[6])
    )


def align_case(expected: Column, alphabet: Column) -> Column:
    """Expected letters in the case of the alphabet found in the image; anything but single letters stays as it is."""
    single = F.forall(expected, lambda x: x.rlike("^[A-Za-z]$"))
    return F.when(single & (alphabet == "A"), F.transform(expected, F.upper)).when(single & (alphabet == "a"), F.transform(expected, F.lower)).otherwise(expected)


def size_score(height: Column, unit: Column, spread: float = 0.24) -> Column:
    """How near a height is to the unit: 1 for the same, falling with the square of the logarithm of their ratio."""
    ratio = F.greatest(height / F.greatest(unit, F.lit(1e-6)), F.lit(1e-4))
    return F.exp(F.pow(F.log(ratio) / spread, F.lit(2.0)) * -0.5)


def utc_text(c: Column) -> Column:
    """An instant as ISO text in UTC, to the microsecond; give current_timestamp() for now, a literal for the same result again."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def responses(records: DataFrame, editor: DataFrame, keys: Sequence[str] = ("job_id", "record_id")) -> DataFrame:
    """Records as a response gives them; where the editor has a column and a value, its value holds."""
    mine = [c for c in editor.columns if c not in keys]
    e = editor.select(*keys, F.struct(*mine).alias("_e"))
    rows = records.join(e, list(keys), "left")
    one = lambda c: (F.coalesce(F.col(f"_e.{c}"), F.col(c)) if c in mine else F.col(c)).alias(c)
    extra = [F.col(f"_e.{c}").alias(c) for c in mine if c not in records.columns]
    return rows.select(*keys, *[one(c) for c in RESPONSE if c in records.columns], document_slug(F.col("document_name")).alias("document_slug"), *extra)


def job_metrics(records: DataFrame, job: str = "job_id") -> DataFrame:
    """The eight metrics of each job, from records with panel_count, mean_confidence, low_confidence_panels (a number) and extraction_needs_review.

    The mean is of the figures' means, a figure without panels counting 0.
    """
    again = F.count_if(F.coalesce("extraction_needs_review", F.lit(False)))
    low = F.coalesce(F.sum("low_confidence_panels"), F.lit(0))
    return records.groupBy(job).agg(
        F.count("*").alias("figures"), F.count("*").alias("processed"), F.coalesce(F.sum("panel_count"), F.lit(0)).alias("panels"),
        F.count_if(F.coalesce("panel_count", F.lit(0)) == 0).alias("preserved"), F.avg(F.coalesce("mean_confidence", F.lit(0.0))).alias("mean_confidence"),
        low.alias("low_confidence"), again.alias("extraction_review"), (again + low).alias("needs_review"),
    )


def document_groups(records: DataFrame, job: str = "job_id") -> DataFrame:
    """Of each document of a job its records in order, and how many need a review: records with either sign count once."""
    either = F.coalesce("extraction_needs_review", F.lit(False)) | (F.coalesce("low_confidence_panels", F.lit(0)) > 0)
    return records.groupBy(job, "document_name").agg(
        F.array_sort(F.collect_list("record_id")).alias("record_ids"), F.count("*").alias("figure_count"), F.coalesce(F.sum("panel_count"), F.lit(0)).alias("panel_count"),
        F.count_if(either).alias("needs_review"), F.min("record_id").alias("_first"),
    ).withColumn("slug", document_slug(F.col("document_name"))).drop("_first")


def updated_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """items with the changes (batch_id, item_id and some of CHANGEABLE) written over; other columns of changes are ignored, null changes nothing.

    Of several changes of an item the greatest holds. An item that isn't there raises.
    """
    key = ["batch_id", "item_id"]
    cols = [c for c in CHANGEABLE if c in changes.columns]
    once = changes.groupBy(*key).agg(F.max(F.struct(*cols)).alias("_c"))
    rows = items.withColumn("_i", F.lit(1)).join(once, key, "full")
    there = F.when(F.col("_i").isNull(), F.raise_error(F.concat(F.lit("no such item: "), "item_id")).cast("string")).otherwise(F.col("item_id"))
    return rows.select(*[
        there.alias("item_id") if c == "item_id" else F.coalesce(F.col(f"_c.{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in items.columns
    ])


def new_batch(files: DataFrame, batch_id: str, kind: str, label: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(batch, items) rows of a new batch of files (item_id, filename, source_path, size_bytes): all queued."""
    items = files.select(
        F.lit(batch_id).alias("batch_id"), "item_id", F.expr("replace(uuid(), '-', '')").alias("job_id"), "filename", "source_path", "size_bytes", F.lit("queued").alias("status"),
        F.lit(created_at).alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("started_at", "completed_at", "metrics_json", "message", "error")],
    )
    batch = files.agg(F.count("*").cast("int").alias("total")).select(
        F.lit(batch_id).alias("batch_id"), F.lit("queued").alias("status"), F.lit(kind).alias("source_kind"), F.lit(label).alias("source_label"), F.lit(created_at).alias("created_at"),
        "total", F.lit(0).alias("completed_count"), F.lit(0).alias("failed_count"), F.lit(0.0).alias("progress"),
    )
    return batch, items


class RunGuard:
    """One run of a batch at a time: a run takes the next number of the batch's log and gives it back when it ends."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def start(self, batch_id: str) -> int | None:
        """The number of the run that may go on; None if one is active."""
        log = CommitLog(self.spark, f"{self.root}/{batch_id}")
        top, entry = log.last()
        if entry and entry["active"]:
            return None
        try:
            log.commit(top + 1, {"active": True})
        except CommitTaken:
            return None
        return top + 1

    def end(self, batch_id: str, number: int) -> None:
        CommitLog(self.spark, f"{self.root}/{batch_id}").commit(number + 1, {"active": False})


def with_hashes(files: DataFrame, cache: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with sha256, new rows of the cache): digests are taken from the cache by (path, length, modified), and only the rest is read.

    files: path, length, modified; cache: these and sha256; contents: path, content.
    """
    key = ["path", "length", "modified"]
    known = files.join(cache.groupBy(*key).agg(F.max("sha256").alias("sha256")), key, "left")
    fresh = known.where("sha256 IS NULL").select(*key).distinct().join(contents.select("path", F.sha2("content", 256).alias("sha256")), "path")
    rows = known.where("sha256 IS NOT NULL").unionByName(known.where("sha256 IS NULL").drop("sha256").join(fresh.select("path", "sha256"), "path", "left").select(*known.columns))
    return rows, fresh.select(*key, "sha256")


def preview_key(path: Column, size: Column, modified_ns: Column, page: Column, box: Column, dpi: Column) -> Column:
    """The name under which a page preview is kept: the first 16 digits of a digest of all that it shows."""
    parts = [F.to_json(F.array(path)).substr(F.lit(2), F.length(F.to_json(F.array(path))) - 2), size.cast("string"), modified_ns.cast("string"), page.cast("string"), F.to_json(box), dpi.cast("string")]
    return F.substring(F.sha1(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))), 1, 16)

