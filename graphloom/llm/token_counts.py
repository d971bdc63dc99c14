"""Tokens of each document, counted from flat token files by a scan for end-of-document identifiers.

A flat file is nothing but ids, one document after another, each ended by the separator; it is kept as fixed-size
blocks, and a document may run over many. Each block is searched on its own, vectorised: it reports its length, the
lengths between its separators and where its first and last ones are. A prefix scan over the blocks of a file
(running sums of lengths and separators, running maximum of the last separator's place) gives every block what was
open before it and how many documents ended there, so that boundaries are stitched without reading any block again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.written import fresh_path
from graphloom.llm.packing import cached
from graphloom.llm.shared import map_arrow

#: Ids of a block.
BLOCK = 1 << 18

#: Documents of an entry of the writer's log.
LOG = 1 << 16

_FILES = "file long, block long, ids binary, docs array<long>"


def _write_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block: int, dtype: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    file = TaskContext.get().partitionId()
    cache = cached(path, plain=True, most=1 << 18)
    cache.fits(dtype, end_id)
    encode = cache.encode
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("docs", pa.list_(pa.int64()))])
    whole = block * np.dtype(dtype).itemsize
    end = np.array([end_id], "<u4").tobytes()
    held: list[bytes] = []
    log: list[int | None] = []
    size = blocks = logs = 0

    def row(number: int, data: bytes | None, docs: list | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], f.type) for x, f in zip((file, number, data, docs), schema, strict=True)], schema=schema)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4").astype(dtype).tobytes()
            held.append(ids)
            size += len(ids)
            log.append(doc)
            if size >= whole:
                data = b"".join(held)
                for i in range(0, len(data) - whole + 1, whole):
                    yield row(blocks, data[i : i + whole], None)
                    blocks += 1
                held = [data[len(data) // whole * whole :]]
                size = len(held[0])
            if len(log) == LOG:
                logs += 1
                yield row(-logs, None, log)
                log = []
    if size:
        yield row(blocks, b"".join(held), None)
    if log:
        yield row(-logs - 1, None, log)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK, dtype: str = "<u2") -> str:
    """Writes the documents' ids, each ended by ``end_id``, into flat files of blocks; returns the table's path.

    Rows with block >= 0 hold the files. Rows with block < 0 are the writer's log: the doc_ids in the order written.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = fresh_path(docs.sparkSession, "token-files")
    map_arrow(thin, lambda it: _write_batches(it, tokenizer, end_id, block, dtype), _FILES).write.option("compression", "zstd").parquet(path)
    return path


_SCANNED = "file long, block long, n long, ended long, last long, lengths array<long>"


def _scan_batches(batches: Iterator[pa.RecordBatch], end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for data in batch.column(2):
            ids = np.frombuffer(data.as_buffer() or b"", dtype)
            at = np.flatnonzero(ids == end_id)
            rows.append((len(ids), len(at), int(at[-1]) + 1 if len(at) else None, np.diff(at, prepend=-1)))
        n, ended, last, lengths = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ended, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64())),
        ], names=["file", "block", "n", "ended", "last", "lengths"])


def separator_scan(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens, complete) for each document of flat files given as ``blocks(file, block, ids)``.

    n_tokens counts a document's ids without its separator. A file that doesn't end with a separator has one more,
    incomplete document. Empty blocks and an empty table are allowed; blocks of a file may be of any sizes.
    """
    found = map_arrow(blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "ids"), lambda it: _scan_batches(it, end_id, dtype), _SCANNED)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    found = found.withColumn("begin", F.coalesce(F.sum("n").over(before), zero)).withColumn("done", F.coalesce(F.sum("ended").over(before), zero))
    # where the document that is open at a block's start began
    found = found.withColumn("opened", F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), zero))
    each = found.select("file", "begin", "done", "opened", F.posexplode("lengths").alias("i", "length"))
    closed = each.select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("length") - 1 + F.when(F.col("i") == 0, F.col("begin") - F.col("opened")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = found.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ended").alias("ordinal"), F.coalesce(F.max(F.col("begin") + F.col("last")), zero).alias("opened"))
    return closed.unionByName(ends.filter("n > opened").select("file", "ordinal", (F.col("n") - F.col("opened")).alias("n_tokens"), F.lit(False).alias("complete")))


def read_flat_files(spark, path: str, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """(file, block, ids) of raw binary files of ids under ``path``; file is a hash of the file's name."""
    width = np.dtype(dtype).itemsize * block
    raw = spark.read.format("binaryFile").load(path)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / width)))
    cut = raw.select(F.xxhash64("path").alias("file"), pieces.alias("block"), "content")
    return cut.select("file", "block", F.expr(f"substring(content, cast(block * {width} + 1 as int), {width})").alias("ids"))


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, by writing flat token files and scanning them.

    The separator isn't counted, and its string inside a text is ordinary text. A null or empty text has 0 tokens; very
    long texts run over many blocks; a vocabulary that doesn't fit ``dtype`` is an error; a null doc_id stays null; repeated rows each have their row; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    table = spark.read.schema(_FILES).parquet(write_token_files(docs, tokenizer, end_id, block, dtype))
    counts = separator_scan(table.filter("block >= 0"), end_id, dtype)
    log = table.filter("block < 0").select("file", "block", F.posexplode("docs").alias("i", "doc_id"))
    log = log.select("file", ((-F.col("block") - 1) * LOG + F.col("i")).alias("ordinal"), "doc_id")
    return log.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
