"""Order-dependent folds over groups, streamed through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: PLC2701

from plateworks.runtime import ship


def fold_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[tuple, Iterator[dict]], Iterator[tuple]], schema: str, rows: int = 20_000
) -> DataFrame:
    """Calls work(key, rows in order) for each group; it yields tuples of the schema.

    One shuffle by the keys and a sort; the rows of a group come as a stream, so what a task holds is what
    `work` keeps. Far cheaper than a frame per group where groups are many and small. Null keys are a group.
    """
    ship(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in arrow]
            b = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)
            out.clear()
            return b

        for key, group in groupby(stream(), key=lambda r: tuple(r[i] for i in at)):
            for x in work(key, (dict(zip(names, r)) for r in group)):
                out.append(x)
                if len(out) >= rows:
                    yield flush()
        if out:
            yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
