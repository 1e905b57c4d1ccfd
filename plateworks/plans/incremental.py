"""Problem 4: runs over batch_items hand on exactly the new and changed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions.notation import instant, plain
from plateworks.operators.ledger import ChangeFeed, changes_by_run, feed_runs
from plateworks.runtime import new_path, table


def item_states(items: DataFrame) -> DataFrame:
    """The columns that make a state, in one notation each."""
    return items.select(
        "batch_id",
        "item_id",
        "load_no",
        "changed_at",
        plain(F.col("status")).alias("status"),
        instant(F.col("started_at")).alias("started"),
        instant(F.col("completed_at")).alias("completed"),
    )


STATE = {"keys": ["batch_id", "item_id"], "sequence": "load_no", "version": ["changed_at", "load_no"], "compare": ["status", "started", "completed"]}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_states(table(spark, sf_dir, "batch_items")).where("batch_id IS NOT NULL AND item_id IS NOT NULL AND changed_at IS NOT NULL AND load_no IS NOT NULL")


def _succeeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "ingest_runs").where(plain(F.col("outcome")) == "succeeded")
    return runs.where("run_no IS NOT NULL AND upto_load IS NOT NULL").groupBy("run_no").agg(F.max("upto_load").alias("upto"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_no, batch_id, item_id) of what each successful run hands on.

    Every successful run subtracts what is done from what it saw, works on the gap and commits. Rows without
    batch_id, item_id, changed_at or load_no name no state and are left out. Of two rows with the same
    changed_at the one of the later load holds, then the greater values.
    """
    runs = [(r["run_no"], r["upto"]) for r in _succeeded(spark, sf_dir).collect()]
    return feed_runs(_log(spark, sf_dir), runs, new_path(spark, "feed"), **STATE)


def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as p4_found, worked out from the whole log in one pass: what a ledger that was lost is checked against."""
    return changes_by_run(_log(spark, sf_dir), _succeeded(spark, sf_dir), **STATE)


def late_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs 1 to 4 over six loads more each, in which every fifth load is committed late, for the run after: it lies in a range that is done."""
    feed = ChangeFeed(spark, new_path(spark, "feed"), **STATE)
    log = _log(spark, sf_dir)
    for run in range(1, 5):
        late = [n for n in range(6 * run - 5, 6 * run + 1) if n % 5 == 0]
        edges = [0, *late, 6 * run + 1]
        feed.run(run, log, [(a + 1, b - 1) for a, b in zip(edges, edges[1:])])
    return feed.handed_on()


P4_FOUND_SQL = """
WITH runs AS (
  SELECT run_no, max(upto_load) AS upto FROM ingest_runs
  WHERE lower(trim(outcome)) = 'succeeded' AND upto_load IS NOT NULL GROUP BY run_no),
steps AS (SELECT run_no, upto, lag(upto) OVER (ORDER BY run_no) AS before FROM runs),
states AS (
  SELECT batch_id, item_id, load_no, changed_at, nullif(lower(trim(status)), '') AS status,
    epoch_us(try_cast(trim(started_at) AS TIMESTAMPTZ)) AS started,
    epoch_us(try_cast(trim(completed_at) AS TIMESTAMPTZ)) AS completed
  FROM batch_items WHERE batch_id IS NOT NULL AND item_id IS NOT NULL AND changed_at IS NOT NULL),
seen AS (
  SELECT r.run_no, batch_id, item_id, status, started, completed
  FROM states s JOIN steps r ON s.load_no <= r.upto
  QUALIFY row_number() OVER (PARTITION BY r.run_no, batch_id, item_id
    ORDER BY changed_at DESC, load_no DESC, status DESC NULLS LAST, started DESC NULLS LAST, completed DESC NULLS LAST) = 1),
chain AS (SELECT run_no, lag(run_no) OVER (ORDER BY run_no) AS prev FROM runs)
SELECT n.run_no, n.batch_id, n.item_id
FROM seen n JOIN chain c ON n.run_no = c.run_no
LEFT JOIN seen o ON o.run_no = c.prev AND o.batch_id = n.batch_id AND o.item_id = n.item_id
WHERE o.run_no IS NULL OR n.status IS DISTINCT FROM o.status
  OR n.started IS DISTINCT FROM o.started OR n.completed IS DISTINCT FROM o.completed
"""

LATE_SQL = P4_FOUND_SQL.replace("runs AS (", "runs AS (SELECT range AS run_no, 6 * range AS upto FROM range(1, 5)), unused AS (", 1).replace(
    "ON s.load_no <= r.upto", "ON s.load_no <= r.upto AND NOT (s.load_no % 5 = 0 AND s.load_no > r.upto - 6)", 1
)

QUERIES = {"p4_found": p4_found, "replayed_runs": replayed_runs, "late_loads": late_loads}
SQL = {"p4_found": P4_FOUND_SQL, "replayed_runs": P4_FOUND_SQL, "late_loads": LATE_SQL}
