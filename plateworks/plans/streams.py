"""Queries that run as streams over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks.operators.annotations import EDIT_SCHEMA
from plateworks.plans.curation import edits
from plateworks.runtime import new_path
from plateworks.streaming import editor


def edit_stream(spark, sf_dir):
    """The edits as a stream; equal to edit_outcomes."""
    landing = new_path(spark, "landing")
    edits(spark, sf_dir).write.parquet(landing)
    stream = spark.readStream.schema(EDIT_SCHEMA).parquet(landing)
    return editor.run_available(editor.edit_outcomes(stream))


def event_windows(spark, sf_dir):
    """Events by hour and type as a stream with a watermark; the last windows close with the stream, so they are added from the rest."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    landing = new_path(spark, "landing")
    source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(landing)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(landing)
    kept = []

    def keep(batch, number):
        path = new_path(spark, "windows")
        batch.write.parquet(path)
        kept.append(path)

    editor.run_available(editor.windowed_counts(stream), keep, "windows", "update")
    rows = spark.read.parquet(*kept)
    last = rows.groupBy("window", "event_type").agg(F.max("n").alias("n"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


QUERIES = {"edit_stream": edit_stream, "event_windows": event_windows}
SQL = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
