"""Per-instance kernels for what is sequential by nature: one row per instance in, rows out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.shipping import ship


def map_instances(rows: DataFrame, kernel: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """``kernel`` gets a row as a dictionary and returns rows of ``schema``. Batches are small, for memory."""
    ship(rows.sparkSession)
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = [r for row in batch.slice(i, 256).to_pylist() for r in kernel(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, parsed)
