"""Streams make the same rows as batches, keep clear of held-out sets, and go on after a restart."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import splits
from graphloom.sources import registry
from graphloom.streaming import dataset as S

OPTIONS = {"seed": 3, "min_num_nodes": 12, "max_num_nodes": 16}


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_source_is_the_same_in_any_partitioning(spark):
    registry.register(spark)
    read = lambda parts: sorted(map(tuple, spark.read.format("graphs").options(instances="30", partitions=str(parts), seed="3").load().collect()))
    assert read(1) == read(7) and len({r[0] for r in read(2)}) == 30


def test_training_stream_marks_held_out_instances(spark, tmp_path):
    registry.register(spark)
    edges = spark.read.format("graphs").options(instances="24", **{k: str(v) for k, v in OPTIONS.items()}).load()
    from graphloom.plans import dataset

    nodes = edges.groupBy("inst").agg(F.first("n").alias("n"))
    known = dataset.from_edges(nodes, edges.select("inst", "edge_idx", "u", "v"), False, seed=3, max_vocab_nodes=20).hashes.filter("inst in (2, 17)")
    held = known.select(F.lit("test").alias("split"), "hash")
    got = []

    def sink(batch, number):
        got.extend((number, r.inst, r.is_invalid, r.epoch) for r in batch.select("inst", "is_invalid", "epoch").collect())

    stream = S.edge_stream(spark, instances=24, instances_per_batch=8, **OPTIONS)
    drained(S.train(spark, stream, held, sink, str(tmp_path / "c"), epochs_of=2, seed=3, max_vocab_nodes=20))
    seen = len(got)
    assert sorted(i for _, i, *_ in got) == list(range(seen)) and seen >= 8
    assert {i for _, i, bad, _ in got if bad} == {i for i in (2, 17) if i < seen}
    while len(got) < 24:  # each run takes what is there; a restart goes on behind it
        before = len(got)
        drained(S.train(spark, S.edge_stream(spark, instances=24, instances_per_batch=8, **OPTIONS), held, sink, str(tmp_path / "c"), epochs_of=2, seed=3, max_vocab_nodes=20))
        assert len(got) > before
    assert sorted(i for _, i, *_ in got) == list(range(24))


def test_static_set_and_splits(spark):
    packaged, hashes = S.static_set(spark, "valid", 10, 4, batch_size=8, min_num_nodes=12, max_num_nodes=14, max_vocab_nodes=20, min_path_length=2)
    assert hashes.count() == 10 and packaged.count() == 10
    assert splits.split_sizes(hashes).collect()[0].n == 10
    own = packaged.select("inst", "hash")
    marks = splits.marked(own, hashes).collect()
    assert all(r.in_validation and r.is_invalid and not r.in_test for r in marks)
    assert splits.decontaminated(packaged, own, hashes).count() == 0
    assert S.epoch_batches(100, 32) == 4


@pytest.mark.parametrize(("family", "options"), [("balanced", {"min_num_nodes": 30, "max_num_nodes": 34, "max_vocab_nodes": 40}), ("khops", {"max_vocab_nodes": 12, "max_prefix_length": 30})])
def test_endless_streams_of_any_family_go_on_after_a_restart(spark, tmp_path, family, options):
    got = []
    held = spark.createDataFrame([], "split string, hash string")

    def sink(batch, number):
        got.extend((number, r.inst) for r in batch.select("inst").collect())

    for upto in (2, 4):
        query = S.endless(spark, family, held, sink, str(tmp_path / "c"), instances_per_batch=6, partitions=2, seed=3, **options)
        end = time.monotonic() + 150
        while len({n for n, _ in got}) < upto and query.isActive and time.monotonic() < end:
            time.sleep(0.2)
        assert query.exception() is None and query.isActive
        query.stop()
    by_batch = {n: sorted({i for m, i in got if m == n}) for n, _ in got}
    assert sorted(by_batch) == list(range(len(by_batch))) and len(by_batch) >= 4
    # a batch that was stopped half-way is made again, with the same instances
    assert all(ids == list(range(6 * n, 6 * n + 6)) for n, ids in by_batch.items())


def test_a_family_without_more_graphs_is_an_error(spark):
    with pytest.raises(ValueError, match="different instances"):
        S.static_set(spark, "valid", 50, 4, "path_star", patience=1, batch_size=2, min_num_arms=1, max_num_arms=1, min_arm_length=2, max_arm_length=2, shuffle_nodes=False)


def test_windows_on_a_stream_are_the_batch_ones_that_the_watermark_closed(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in S.windowed_metrics(events).select("window_start", "event_type", "n").collect()}
    for mode, name in (("complete", "whole"), ("append", "closed")):
        query = S.windowed_metrics(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        drained(query)
        got = {tuple(r) for r in spark.table(name).select("window_start", "event_type", "n").collect()}
        assert got == want if mode == "complete" else got < want and len(got) > 0.8 * len(want)
    assert S.sliding_metrics(events).count() > 0 and S.sessions(events).count() > 0
    assert S.without_repeats(events.unionByName(events)).count() == events.count()
    twice = S.without_repeats(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "once")).start()
    drained(twice)
    assert spark.table("once").count() == events.count()
