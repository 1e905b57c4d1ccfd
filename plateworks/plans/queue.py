"""Queries of the work queue over batches and batch_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions.notation import instant, plain
from plateworks.operators import queue
from plateworks.runtime import table

_ITEMS = """items AS (
  SELECT * EXCLUDE (status), nullif(lower(trim(status)), '') AS status FROM batch_items
  WHERE batch_id IS NOT NULL AND item_id IS NOT NULL AND changed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY batch_id, item_id ORDER BY changed_at DESC, load_no DESC) = 1)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.latest_items(table(spark, sf_dir, "batch_items"))


def latest_items(spark, sf_dir):
    """The current state of every item."""
    return _items(spark, sf_dir).select("batch_id", "item_id", "status", "size_bytes", "load_no")


def batch_progress(spark, sf_dir):
    """Counters of each batch from its items."""
    return queue.batch_counts(_items(spark, sf_dir))


def counter_lag(spark, sf_dir):
    """How far the counters stored in batches lag behind the items."""
    stored = table(spark, sf_dir, "batches").groupBy("batch_id").agg(
        F.max("total").alias("stored_total"), F.max("completed_count").alias("stored_completed"), F.max("failed_count").alias("stored_failed")
    )
    now = queue.batch_counts(_items(spark, sf_dir)).select("batch_id", "total", "completed", "failed")
    return now.join(stored, "batch_id").select(
        "batch_id", (F.col("total") - F.col("stored_total")).alias("d_total"), (F.col("completed") - F.col("stored_completed")).alias("d_completed"),
        (F.col("failed") - F.col("stored_failed")).alias("d_failed"),
    )


def recent_batches(spark, sf_dir):
    """O1: the newest batches, a top-k report."""
    return queue.newest_batches(table(spark, sf_dir, "batches"), 30).select("batch_id", "status", "created_at")


def batch_page(spark, sf_dir):
    """The second page of the largest batch, with its metrics decoded."""
    items = _items(spark, sf_dir)
    largest = items.groupBy("batch_id").count().orderBy(F.desc("count"), "batch_id").limit(1).select("batch_id")
    rows = items.join(largest, "batch_id", "left_semi").orderBy("item_id").offset(200).limit(200)
    return queue.decoded(rows).select("batch_id", "item_id", "filename", "status", F.col("metrics.figures").alias("figures"), F.col("metrics.panels").alias("panels"))


def queued_items(spark, sf_dir):
    """O3: what is queued, with its place in the batch."""
    from pyspark.sql import Window as W

    w = W.partitionBy("batch_id").orderBy("item_id")
    return _items(spark, sf_dir).where("status = 'queued'").select("batch_id", "item_id", F.row_number().over(w).alias("place"))


def recover_queue(spark, sf_dir):
    """The items after a restart."""
    items, _ = queue.recovered(_items(spark, sf_dir), table(spark, sf_dir, "batches"))
    return items.select("batch_id", "item_id", "status", "started_at", "completed_at", "error")


def recover_batches(spark, sf_dir):
    """The batches after a restart, and their items by status."""
    items, batches = queue.recovered(_items(spark, sf_dir), table(spark, sf_dir, "batches"))
    state = batches.groupBy("batch_id").agg(F.max("status").alias("status"))
    return state.join(queue.batch_counts(items).select("batch_id", "queued", "processing", "completed", "failed"), "batch_id")


def source_groups(spark, sf_dir):
    """Items and bytes of each source group."""
    rows = queue.with_source_group(_items(spark, sf_dir), table(spark, sf_dir, "batches"))
    return rows.groupBy("batch_id", "source_group").agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"))


def folder_counts(spark, sf_dir):
    """Files directly in each folder, not below it."""
    path = F.regexp_replace("source_path", "\\\\", "/")
    rows = _items(spark, sf_dir).where("source_path IS NOT NULL").select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"))


def item_metrics(spark, sf_dir):
    """Figures, panels and figures to review of the completed items of each batch."""
    m = F.col("metrics")
    rows = queue.decoded(_items(spark, sf_dir).where("status = 'completed'"))
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("items"), F.sum(m.figures).alias("figures"), F.sum(m.panels).alias("panels"), F.sum(m.needs_review).alias("needs_review"),
        F.count_if(m.panels == 0).alias("preserved"),
    )


def batches_by_day(spark, sf_dir):
    """Batches and items by the day they were created."""
    rows = table(spark, sf_dir, "batches").groupBy("batch_id").agg(F.max("created_at").alias("created_at"), F.max("total").alias("total"))
    day = F.to_date(F.timestamp_micros(instant(F.col("created_at")))).cast("string")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("batches"), F.sum("total").alias("items"))


def key_violations(spark, sf_dir):
    """Items with several job ids, and job ids of several items."""
    rows = table(spark, sf_dir, "batch_items")
    by_item = rows.groupBy("batch_id", "item_id").agg(F.min("job_id").alias("lo"), F.max("job_id").alias("hi")).agg(F.count_if(F.col("lo") < F.col("hi")).alias("n"))
    by_job = rows.where("job_id IS NOT NULL").groupBy("job_id").agg(
        F.min(F.struct("batch_id", "item_id")).alias("lo"), F.max(F.struct("batch_id", "item_id")).alias("hi")
    ).agg(F.count_if(F.col("lo") < F.col("hi")).alias("n"))
    return by_item.select(F.lit("item").alias("key"), "n").unionByName(by_job.select(F.lit("job").alias("key"), "n"))


def status_lives(spark, sf_dir):
    """How often each status was entered and left, and the microseconds spent in it."""
    rows = queue.status_intervals(table(spark, sf_dir, "batch_items"))
    return rows.groupBy("status").agg(F.count("*").alias("entered"), F.count("to_us").alias("left"), F.sum(F.col("to_us") - F.col("from_us")).alias("spent_us"))


QUERIES = {f.__name__: f for f in (
    latest_items, batch_progress, counter_lag, recent_batches, batch_page, queued_items, recover_queue, recover_batches, source_groups, folder_counts,
    item_metrics, batches_by_day, key_violations, status_lives,
)}

_COUNTS = """counts AS (
  SELECT batch_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing,
    count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total
  FROM items GROUP BY batch_id)"""
_RECOVERED = """open AS (SELECT DISTINCT batch_id FROM batches WHERE lower(trim(status)) IN ('queued', 'running')),
rec AS (
  SELECT i.* EXCLUDE (status, started_at, completed_at, error), i.status = 'processing' AND o.batch_id IS NOT NULL AS again,
    CASE WHEN i.status = 'processing' AND o.batch_id IS NOT NULL THEN 'queued' ELSE i.status END AS status,
    CASE WHEN i.status = 'processing' AND o.batch_id IS NOT NULL THEN NULL ELSE started_at END AS started_at,
    CASE WHEN i.status = 'processing' AND o.batch_id IS NOT NULL THEN NULL ELSE completed_at END AS completed_at,
    CASE WHEN i.status = 'processing' AND o.batch_id IS NOT NULL THEN '服务重启后自动恢复' ELSE error END AS error
  FROM items i LEFT JOIN open o USING (batch_id))"""

SQL = {
    "latest_items": f"WITH {_ITEMS} SELECT batch_id, item_id, status, size_bytes, load_no FROM items",
    "batch_progress": f"""WITH {_ITEMS}, {_COUNTS}
SELECT *, (completed + failed)::DOUBLE / greatest(1, total) AS progress,
  CASE WHEN completed + failed < total THEN 'running' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS outcome FROM counts""",
    "counter_lag": f"""WITH {_ITEMS}, {_COUNTS},
stored AS (SELECT batch_id, max(total) AS t, max(completed_count) AS c, max(failed_count) AS f FROM batches GROUP BY 1)
SELECT batch_id, total - t AS d_total, completed - c AS d_completed, failed - f AS d_failed FROM counts JOIN stored USING (batch_id)""",
    "recent_batches": """SELECT batch_id, status, created_at FROM (SELECT DISTINCT ON (batch_id) * FROM batches)
ORDER BY created_at DESC NULLS LAST, batch_id LIMIT 30""",
    "batch_page": f"""WITH {_ITEMS}, big AS (SELECT batch_id FROM items GROUP BY 1 ORDER BY count(*) DESC, batch_id LIMIT 1)
SELECT batch_id, item_id, filename, status, try_cast(json_extract(metrics_json, '$.figures') AS INT) AS figures,
  try_cast(json_extract(metrics_json, '$.panels') AS INT) AS panels
FROM items SEMI JOIN big USING (batch_id) ORDER BY item_id LIMIT 200 OFFSET 200""",
    "queued_items": f"WITH {_ITEMS} SELECT batch_id, item_id, row_number() OVER (PARTITION BY batch_id ORDER BY item_id) AS place FROM items WHERE status = 'queued'",
    "recover_queue": f"WITH {_ITEMS}, {_RECOVERED} SELECT batch_id, item_id, status, started_at, completed_at, error FROM rec",
    "recover_batches": f"""WITH {_ITEMS}, {_RECOVERED},
b AS (SELECT batch_id, max(CASE WHEN lower(trim(status)) IN ('queued', 'running') THEN 'queued' ELSE status END) AS status FROM batches GROUP BY 1)
SELECT batch_id, any_value(b.status) AS status, count(*) FILTER (r.status = 'queued') AS queued, count(*) FILTER (r.status = 'processing') AS processing,
  count(*) FILTER (r.status = 'completed') AS completed, count(*) FILTER (r.status = 'failed') AS failed
FROM rec r JOIN b USING (batch_id) GROUP BY batch_id""",
    "source_groups": f"""WITH {_ITEMS},
k AS (SELECT batch_id, max(source_kind) AS kind, rtrim(max(source_label), '/') AS root FROM batches GROUP BY 1),
p AS (SELECT i.*, kind, root, replace(coalesce(source_path, ''), chr(92), '/') AS path FROM items i LEFT JOIN k USING (batch_id)),
r AS (SELECT *, starts_with(path, root || '/') AS inside, substr(path, length(root) + 2) AS rel,
  nullif(split_part(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', -1), '') AS parent FROM p),
g AS (SELECT *, CASE WHEN kind IS DISTINCT FROM 'folder' THEN '浏览器上传'
  WHEN inside THEN coalesce(nullif(regexp_extract(rel, '^(.*)/[^/]*$', 1), ''), '根目录') ELSE coalesce(parent, '其他目录') END AS source_group FROM r)
SELECT batch_id, source_group, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM g GROUP BY 1, 2""",
    "folder_counts": f"""WITH {_ITEMS}
SELECT regexp_extract(replace(source_path, chr(92), '/'), '^(.*)/[^/]*$', 1) AS folder, count(*) AS files FROM items WHERE source_path IS NOT NULL GROUP BY 1""",
    "item_metrics": f"""WITH {_ITEMS},
m AS (SELECT batch_id, try_cast(json_extract(metrics_json, '$.figures') AS INT) AS f, try_cast(json_extract(metrics_json, '$.panels') AS INT) AS p,
  try_cast(json_extract(metrics_json, '$.needs_review') AS INT) AS n FROM items WHERE status = 'completed')
SELECT batch_id, count(*) AS items, CAST(sum(f) AS BIGINT) AS figures, CAST(sum(p) AS BIGINT) AS panels, CAST(sum(n) AS BIGINT) AS needs_review, count(*) FILTER (p = 0) AS preserved FROM m GROUP BY 1""",
    "batches_by_day": """WITH b AS (SELECT batch_id, max(created_at) AS c, max(total) AS t FROM batches GROUP BY 1)
SELECT strftime(try_cast(c AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS batches, CAST(sum(t) AS BIGINT) AS items FROM b GROUP BY 1""",
    "key_violations": """SELECT 'item' AS key, count(*) FILTER (n > 1) AS n FROM (SELECT count(DISTINCT job_id) AS n FROM batch_items GROUP BY batch_id, item_id)
UNION ALL SELECT 'job', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT (batch_id, item_id)) AS n FROM batch_items WHERE job_id IS NOT NULL GROUP BY job_id)""",
    "status_lives": """WITH r AS (SELECT batch_id, item_id, changed_at, load_no, nullif(lower(trim(status)), '') AS status FROM batch_items WHERE changed_at IS NOT NULL),
s AS (SELECT *, lag(status) OVER w AS before FROM r WINDOW w AS (PARTITION BY batch_id, item_id ORDER BY changed_at, load_no)),
t AS (SELECT *, lead(changed_at) OVER (PARTITION BY batch_id, item_id ORDER BY changed_at, load_no) AS until FROM s WHERE status IS DISTINCT FROM before)
SELECT status, count(*) AS entered, count(until) AS left, CAST(sum(epoch_us(until) - epoch_us(changed_at)) AS BIGINT) AS spent_us FROM t GROUP BY 1""",
}
