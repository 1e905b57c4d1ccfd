"""The work queue: states of items, counters of batches, paging, groups of sources and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.functions.notation import plain

STATUSES = ("queued", "processing", "completed", "failed")
METRICS = "figures int, processed int, panels int, preserved int, mean_confidence double, low_confidence int, extraction_review int, needs_review int"
UPLOADED, ROOT, ELSEWHERE = "浏览器上传", "根目录", "其他目录"
RECOVERED = "服务重启后自动恢复"


def latest_items(log: DataFrame) -> DataFrame:
    """The current row of every (batch_id, item_id): the latest changed_at, then the latest load.

    A partial aggregate over structs, so an item with many states shuffles one row a partition. Rows without
    batch_id, item_id or changed_at are left out. The status comes in lower case.
    """
    rest = [c for c in log.columns if c not in ("batch_id", "item_id", "changed_at", "load_no")]
    rows = log.where("batch_id IS NOT NULL AND item_id IS NOT NULL AND changed_at IS NOT NULL")
    best = rows.groupBy("batch_id", "item_id").agg(F.max(F.struct("changed_at", "load_no", *rest)).alias("s"))
    out = best.select("batch_id", "item_id", "s.*")
    return out.withColumn("status", plain(F.col("status")))


def batch_counts(items: DataFrame) -> DataFrame:
    """Items by status, zero where there is none, with progress and outcome; progress counts completed and failed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.col("completed") + F.col("failed")
    return (
        items.groupBy("batch_id").agg(*map(n, STATUSES), F.count("*").alias("total"))
        .withColumn("progress", done / F.greatest(F.lit(1), F.col("total")))
        .withColumn("outcome", F.when(done < F.col("total"), "running").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))
    )


def page_of(items: DataFrame, batch_id: str, offset: int, limit: int) -> DataFrame:
    """One page of a batch in the order of item_id; offset is 0 at least, limit 1 to 1000."""
    rows = items.where(F.col("batch_id") == batch_id).orderBy("item_id")
    return rows.offset(max(0, offset)).limit(min(1000, max(1, limit)))


def newest_batches(batches: DataFrame, limit: int = 30) -> DataFrame:
    """The newest batches, 1 to 200 of them, once each; ties by batch_id."""
    return batches.dropDuplicates(["batch_id"]).orderBy(F.col("created_at").desc_nulls_last(), "batch_id").limit(min(200, max(1, limit)))


def decoded(items: DataFrame) -> DataFrame:
    """metrics_json as a struct; unreadable or missing JSON gives one without values."""
    empty = F.from_json(F.lit("{}"), METRICS)
    return items.withColumn("metrics", F.coalesce(F.from_json("metrics_json", METRICS), empty)).drop("metrics_json")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def with_source_group(items: DataFrame, batches: DataFrame) -> DataFrame:
    """source_group and source_relative_path of every item: the folder under the batch's root.

    Uploads form one group; files in the root have the root's name; a path outside the root goes by its
    own folder. Items of an unknown batch count as uploads. The batches, one row each, are the small side.
    """
    kinds = batches.groupBy("batch_id").agg(F.max(F.struct("source_kind", "source_label")).alias("b"))
    rows = items.join(kinds, "batch_id", "left")
    path = F.regexp_replace(F.coalesce("source_path", F.lit("")), "\\\\", "/")
    root = F.regexp_replace(F.coalesce(F.col("b.source_label"), F.lit("")), "/+$", "")
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    relative = F.when(inside, path.substr(F.length(root) + 2, F.length(path)))
    parent = F.element_at(F.split(_folder(path), "/"), -1)
    folder = F.coalesce(F.col("b.source_kind") == "folder", F.lit(False))
    return rows.select(
        *items.columns,
        F.when(~folder, UPLOADED).when(inside, F.when(_folder(relative) == "", ROOT).otherwise(_folder(relative)))
        .otherwise(F.when(parent == "", ELSEWHERE).otherwise(parent)).alias("source_group"),
        F.when(~folder, F.coalesce("filename", F.lit(""))).when(inside, relative).otherwise(F.element_at(F.split(path, "/"), -1)).alias("source_relative_path"),
    )


def recovered(items: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and batches after a restart: of open batches, items in work go back to the queue and say so."""
    open_batches = batches.where(plain(F.col("status")).isin("queued", "running")).select("batch_id").distinct()
    again = F.col("_open").isNotNull() & (F.col("status") == "processing")
    rows = items.join(open_batches.withColumn("_open", F.lit(1)), "batch_id", "left")
    null = lambda c: F.when(~again, F.col(c)).alias(c)
    changed = {
        "status": F.when(again, "queued").otherwise(F.col("status")).alias("status"),
        "started_at": null("started_at"),
        "completed_at": null("completed_at"),
        "error": F.when(again, RECOVERED).otherwise(F.col("error")).alias("error"),
    }
    new_items = rows.select(*[changed.get(c, F.col(c)) for c in items.columns])
    opened = plain(F.col("status")).isin("queued", "running")
    new_batches = batches.withColumn("completed_at", F.when(~opened, F.col("completed_at"))).withColumn(
        "status", F.when(opened, "queued").otherwise(F.col("status"))
    )
    return new_items, new_batches


def status_intervals(log: DataFrame) -> DataFrame:
    """The life of each item: every status with the time until the next one, null for the last."""
    w = W.partitionBy("batch_id", "item_id").orderBy("changed_at", "load_no")
    rows = log.where("changed_at IS NOT NULL").select("batch_id", "item_id", "changed_at", "load_no", plain(F.col("status")).alias("status"))
    started = rows.withColumn("_before", F.lag("status").over(w)).where(~F.col("status").eqNullSafe(F.col("_before")))
    return started.select(
        "batch_id", "item_id", "status", F.unix_micros("changed_at").alias("from_us"), F.unix_micros(F.lead("changed_at").over(w)).alias("to_us")
    )
