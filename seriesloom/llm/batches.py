"""Adding a column computed by Python from a text column, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

BATCH_BYTES = 1 << 21  # text handled at a time
BATCH_ROWS = 1000
ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let the session pass at most BATCH_ROWS rows at a time to Python.

    Spark's 10,000 rows of text take as much memory in the executor as outside it,
    twice for each Python step. A lower setting stays.
    """
    rows = int(spark.conf.get(ROWS_CONF, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(ROWS_CONF, str(BATCH_ROWS))


def add_column(df: DataFrame, source: str, out: str, kind: T.DataType, compute: Callable[[list], pa.Array], drop: bool = False, as_arrow: bool = False) -> DataFrame:
    """``df`` with ``out`` = ``compute`` of the values of ``source``, nulls included, as list or Arrow array.

    A column that has the name ``out`` already is replaced; ``drop`` leaves ``source`` out.
    """
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out and not (drop and c == source)]
    inner = f"{source}__source"
    while inner.lower() in (c.lower() for c in kept):
        inner += "_"
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField(out, kind)])
    names = [*kept, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner):
                column = part.column(len(kept))
                values = compute(column if as_arrow else column.to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], values], names)

    return df.select(*[df[f"`{c}`"] for c in kept], df[f"`{source}`"].alias(inner)).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, name: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of the named column; one row at least."""
    column = batch.column(batch.schema.names.index(name))
    sized = column.type in (pa.string(), pa.binary()) or pa.types.is_list(column.type)
    if len(column) and sized:
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    else:
        sizes = np.full(len(column), most // 1024)
    group = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
