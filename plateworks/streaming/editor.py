"""The edit stream: state per figure, the same rules as the batch fold, and windowed counts of events."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators.annotations import OUTCOME_SCHEMA, apply_edit, new_figure, outcome, state_json
from plateworks.runtime import new_path, ship

_NAMES = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]


def _clean(row: dict) -> dict:
    return {k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else int(v) if isinstance(v, float) else v for k, v in row.items()}


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The edits of one figure in a micro-batch, in the order of seq; the figure is kept as JSON."""
    figure = json.loads(state.get[0]) if state.exists else new_figure()
    rows = []
    edits = [_clean(r) for f in frames for r in f.to_dict("records")]
    for e in sorted(edits, key=lambda r: (r["seq"], r["op"], r["label"] or "")):
        rows.append(outcome(figure, e, *apply_edit(figure, e)))
    state.update((state_json(figure),))
    yield pd.DataFrame(rows, columns=_NAMES).astype({"version": "Int32"})


def edit_outcomes(stream: DataFrame) -> DataFrame:
    """The outcome of every edit of a stream. State: one JSON text per figure, partitioned by figure."""
    ship(stream.sparkSession)
    return stream.groupBy("job", "record").applyInPandasWithState(_step, OUTCOME_SCHEMA, "figure string", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type; the watermark bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, name: str = "edits", mode: str = "append") -> DataFrame:
    """Works through all that is there and returns it as a table; a restart goes on from the checkpoint.

    With a sink each micro-batch goes to it (foreachBatch), else to files in the shared folder.
    """
    spark: SparkSession = stream.sparkSession
    out, check = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return spark.createDataFrame([], stream.schema)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_by_figure(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last outcome of each figure in `target`, one folder a micro-batch: writing one again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("job", "record").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("job", "record")]), "seq").alias("s"))
        last.select("job", "record", "s.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
