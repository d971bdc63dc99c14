"""Tables in between, and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from graphloom.functions.shipping import ship
from graphloom.functions.written import fresh_path

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Hadoop's local file system starts a process (chmod) for each folder and file that it makes, and doubles the files by
#: checksums of its own. While an executor starts one it counts twice in what memory its processes seem to take. The raw
#: one makes no second file; Parquet's pages have checksums anyway, and these are checked. Other file systems ignore this.
_WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_READ = {"parquet.page.verify-checksum.enabled": "true"}
_RECORD: ContextVar[list[str] | None] = ContextVar("tables written", default=None)


@contextmanager
def recorded(paths: list[str]):
    """Notes in ``paths`` the tables that :func:`materialize` writes within, for who knows when nothing reads them any more."""
    token = _RECORD.set(paths)
    try:
        yield
    finally:
        _RECORD.reset(token)


def materialize(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; its plan starts at that table.

    gather: the rows are few beside the tasks that make them; they go on, by one more shuffle, to as many files as their
    bytes need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (paths := _RECORD.get()) is not None:
        paths.append(path)
    (df.hint("rebalance") if gather else df).write.options(**_WRITE).parquet(path)
    return spark.read.schema(df.schema).options(**_READ).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers.

    Rows are whole texts here: Spark's default of 10,000 rows a batch, if nobody has changed it, is lowered for the session,
    so that a batch of texts stays small in the JVM and in the worker.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, "1000")
    return df.mapInArrow(fn, schema)
