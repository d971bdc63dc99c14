"""Streams: endless generation that keeps clear of held-out sets, epochs, and metrics over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.written import cut
from graphloom.operators import splits
from graphloom.plans import dataset
from graphloom.sources import registry


def edge_stream(spark: SparkSession, **options) -> DataFrame:
    """The "graphs" source as a stream of (inst, n, edge_idx, u, v)."""
    registry.register(spark)
    return spark.readStream.format("graphs").options(**{k: str(v) for k, v in options.items()}).load()


def instance_offsets(spark: SparkSession, rows_per_second: int = 64) -> DataFrame:
    """A stream of instance numbers at a given rate: the clock of an endless dataset."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("inst"), F.col("timestamp").alias("ts"))


def train(spark: SparkSession, edges: DataFrame, split_hashes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, epochs_of: int | None = None, **options) -> StreamingQuery:
    """Runs a training set over what a source of edges has: every micro-batch of ``edges`` becomes packaged instances with ``is_invalid``, which
    says that a held-out split has them, and goes to ``sink(packaged, batch_id)``.

    split_hashes is read once, as it is when the query starts. With ``epochs_of`` an epoch column counts so many
    batches as one. Offsets are instance numbers and draws depend on them alone, so a restart from the checkpoint
    neither repeats nor skips any.
    """
    held = split_hashes.persist()

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        nodes = batch.groupBy("inst").agg(F.first("n").alias("n"))
        data = dataset.from_edges(nodes, batch.select("inst", "edge_idx", "u", "v"), directed=False, **options)
        marks = splits.marked(data.hashes, held).select("inst", "hash", "is_invalid")
        out = data.packaged.join(marks, "inst", "left")
        if epochs_of:
            out = out.withColumn("epoch", F.lit(number // epochs_of))
        sink(out, number)
        data.close()

    return edges.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def endless(
    spark: SparkSession, graph_type: str, split_hashes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    instances_per_batch: int = 256, partitions: int = 8, epochs_of: int | None = None, **options,
) -> StreamingQuery:
    """An endless training set of any family, until the query is stopped: as :func:`train`, without a source of edges.

    Each micro-batch has the next ``instances_per_batch`` instance numbers, dealt to ``partitions`` tasks; graphs are drawn
    from them there, and again up to max_attempts. Micro-batches follow each other at once; a restart from the checkpoint
    goes on behind the last one.
    """
    held = split_hashes.persist()
    clock = {"rowsPerBatch": instances_per_batch, "numPartitions": partitions, "startTimestamp": 0, "advanceMillisPerBatch": 1000}
    numbers = spark.readStream.format("rate-micro-batch").options(**{k: str(v) for k, v in clock.items()}).load().select(F.col("value").alias("inst"))

    def one(ids: DataFrame, number: int) -> None:
        data = dataset.build_of(ids, graph_type, batch_size=instances_per_batch, **options)
        marks = splits.marked(data.hashes, held).select("inst", "hash", "is_invalid")
        out = data.packaged.join(marks, "inst", "left")
        sink(out.withColumn("epoch", F.lit(number // epochs_of)) if epochs_of else out, number)
        data.close()

    return numbers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def epoch_batches(dataset_size: int, batch_size: int) -> int:
    """Batches of an epoch: one more than fit."""
    return dataset_size // batch_size + 1


def static_set(spark: SparkSession, split: str, size: int, seed: int, graph_type: str = "erdos_renyi", patience: int = 8, **options) -> tuple[DataFrame, DataFrame]:
    """A held-out set of ``size`` different instances: (packaged, split_hashes(split, hash)). Batches are made until there
    are enough; equal instances count once. After ``patience`` batches in a row without a new instance the family has no
    more, and that is an error."""
    step = options.pop("batch_size", 256)
    first, made, found, idle = 0, None, 0, 0
    while found < size:
        data = dataset.build(spark, graph_type, seed=seed, first=first, batch_size=step, **options)
        # written to the checkpoint folder: the plan doesn't grow with the number of batches
        one = cut(data.packaged.drop("batch_id").join(data.hashes, "inst"))
        data.close()
        made = one if made is None else made.unionByName(one)
        first += step
        before, found = found, splits.first_of_each(made.select("inst", "hash"), size).count()
        idle = idle + 1 if found == before else 0
        if idle == patience:
            raise ValueError(f"only {found} different instances in {first}, where {size} are asked for")
    chosen = splits.first_of_each(made.select("inst", "hash"), size)
    return made.join(chosen.select("inst"), "inst", "left_semi"), chosen.select(F.lit(split).alias("split"), "hash")


def as_timestamps(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time that a watermark accepts: times without zone are taken as UTC, the session's zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_metrics(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling windows; on a stream, windows close once the watermark has
    passed them, and events that are later than ``late`` count no more."""
    timed = as_timestamps(events)
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_metrics(events: DataFrame, window: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, n) over sliding windows."""
    timed = as_timestamps(events)
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(user_id, session_start, n): events of a user with no gap as long as ``gap`` between them."""
    timed = as_timestamps(events)
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, however often it is sent within the watermark."""
    timed = as_timestamps(events)
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
