"""Every family of graphs by name, and the families as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from graphloom.config import DIRECTED, BatchArgs, group_of
from graphloom.functions.draws import between
from graphloom.functions.written import cut
from graphloom.sources import random_graphs, shaped_graphs


#: Attempt a of instance i is drawn as the instance of number a * ATTEMPT + i.
ATTEMPT = 1 << 40


def graphs(spark: SparkSession, graph_type: str, seed: int = 0, first: int = 0, **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(instances(inst, n), edges, ends or None) of one batch of a family, under the options of its group.

    Graphs of more than max_edges edges are drawn again, their numbers of nodes too, up to max_attempts times; instances
    without a graph after that are left out. Stars and balanced graphs have no attempts: their size follows from their
    parameters.
    """
    size = group_of(BatchArgs, options).batch_size
    return graphs_of(spark.range(first, first + size).withColumnRenamed("id", "inst"), graph_type, seed, **options)


def graphs_of(ids: DataFrame, graph_type: str, seed: int = 0, **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The same of the instances in ``ids(inst)``, whatever batch they come in."""
    batch = group_of(BatchArgs, options)
    if graph_type in ("path_star", "balanced"):
        nodes, edges, ends = family(ids, graph_type, seed, **options)
        edges = edges.join(_fitting(nodes, edges, batch.max_edges), "inst", "left_semi")
    else:
        nodes, edges, ends = _attempted(ids, lambda some: family(some, graph_type, seed, **options), batch)
    return nodes, random_graphs.shuffled_edges(edges, seed) if batch.shuffle_edges else edges, ends


def family(ids: DataFrame, graph_type: str, seed: int = 0, **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(instances(inst, n), edges, ends or None) of the instances in ``ids(inst)``: draws depend on the seed and their
    numbers alone."""
    if graph_type == "path_star":
        arms, length = (options.get("min_num_arms", 2), options.get("max_num_arms", 5)), (options.get("min_arm_length", 5), options.get("max_arm_length", 10))
        edges, ends = shaped_graphs.stars_of(ids, arms, length, seed)
        return ends.select("inst", (F.col("arms") * (F.col("length") - 1) + 1).cast("int").alias("n")), edges, ends
    nodes = random_graphs.sized(ids, options.get("min_num_nodes", 15), options.get("max_num_nodes", 25), seed)
    ties = {"c_min": options.get("c_min", 75), "c_max": options.get("c_max", 125), "seed": seed}
    if graph_type == "erdos_renyi":
        return nodes, random_graphs.connect_random(nodes, random_graphs.erdos_renyi(nodes, options.get("p", -1.0), seed), **ties), None
    if graph_type in ("euclidean", "euclidian"):
        points = random_graphs.uniform_points(nodes, options.get("dim", 2), seed)
        radius = options.get("radius", -1.0)
        near = random_graphs.euclidean(points.join(nodes, "inst"), random_graphs.default_radius() if radius <= 0 else radius)
        return nodes, random_graphs.connect_nearest(nodes, near, points, **ties), None
    if graph_type == "random_tree":
        return nodes, *shaped_graphs.random_trees(nodes, options.get("max_degree", 3), options.get("max_depth", 7), options.get("bernoulli_p", 0.5), options.get("probs"), seed)
    if graph_type == "balanced":
        ahead = nodes.withColumn("lookahead", between(options.get("min_lookahead", 3), options.get("max_lookahead", 5), seed, F.lit("ahead"), "inst"))
        return nodes, *shaped_graphs.balanced(ahead, options.get("min_noise_reserve", 0), options.get("max_num_parents", 4), options.get("max_noise", -1), seed, options.get("end_on_path", True))
    raise ValueError(f"no such graph type: {graph_type}")


def _fitting(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(inst) of the instances of at most so many edges."""
    size = edges.groupBy("inst").agg(F.count("*").alias("size"))
    return nodes.select("inst").join(size, "inst", "left").filter(F.coalesce("size", F.lit(0)) <= most).select("inst")


def _attempted(ids: DataFrame, make, batch: BatchArgs) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The first attempt of each instance whose graph is small enough.

    Attempts are made in blocks of 1, 2, 4, ... for all instances still without a graph, each block in one plan that is
    written once: so there are as many plans as doublings, and at most twice the attempts that are needed.
    """
    found: list[tuple[DataFrame, ...]] = []
    left, tried = ids, 0
    while tried < batch.max_attempts:
        upto = min(max(1, 2 * tried), batch.max_attempts)
        some = left.select(F.explode(F.transform(F.sequence(F.lit(tried), F.lit(upto - 1)), lambda a: F.col("inst") + a * ATTEMPT)).alias("inst"))
        nodes, edges, ends = make(some)
        edges = cut(edges, "attempts")
        first = _fitting(nodes, edges, batch.max_edges).groupBy((F.col("inst") % ATTEMPT).alias("own")).agg(F.min("inst").alias("inst"))
        first = cut(first, "fitting")
        found.append(tuple(t.join(first, "inst").drop("inst").select(F.col("own").alias("inst"), *(c for c in t.columns if c != "inst")) for t in (nodes, edges, ends) if t is not None))
        tried = upto
        left = left.join(first.select(F.col("own").alias("inst")), "inst", "left_anti")
        if left.isEmpty():
            break
    whole = [reduce(DataFrame.unionByName, parts) for parts in zip(*found, strict=True)]
    return whole[0], whole[1], whole[2] if len(whole) > 2 else None


def is_directed(graph_type: str) -> bool:
    return graph_type in DIRECTED


# ------------------------------------------------------------------------------------------------------ data source
class _Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def _rows(options: dict, begin: int, end: int) -> Iterator[tuple]:
    """Edges of instances begin to end - 1: independent edges, tied together as ``connect_random`` does, from draws by
    (seed, inst) alone; so any partition, retry or restart makes the same rows."""
    from graphloom.functions.draws import host_between, host_uniform
    from graphloom.sources.random_graphs import _grow, _how_many

    seed = int(options.get("seed", 0))
    low, high, p = int(options.get("min_num_nodes", 15)), int(options.get("max_num_nodes", 25)), float(options.get("p", -1))
    for inst in range(begin, end):
        n = host_between(low, high, seed, "n", inst)
        chance = 1 / n if p < 0 else p
        edges = [(u, v) for u in range(n) for v in range(u + 1, n) if host_uniform(seed, "er", inst, u, v) < chance]

        def extra(parts: list[list[int]], turn: int, inst: int = inst, n: int = n) -> list[tuple[int, int]]:
            out = []
            for i, own in enumerate(parts):
                for c in range(_how_many(n, 75, 125, seed, inst, turn, i)):
                    other = parts[host_between(i, len(parts) - 1, seed, "to", inst, turn, i, c)]
                    out.append((own[host_between(0, len(own) - 1, seed, "from", inst, turn, i, c)], other[host_between(0, len(other) - 1, seed, "at", inst, turn, i, c)]))
            return out

        row = {"inst": inst, "n": n, "edges": [{"edge_idx": i, "u": u, "v": v} for i, (u, v) in enumerate(edges)]}
        for e in _grow(row, extra):
            yield inst, n, e["edge_idx"], e["u"], e["v"]


class GraphSource(DataSource):
    """``spark.read.format("graphs")``: rows (inst, n, edge_idx, u, v) of connected random graphs. Options: instances,
    partitions, seed, min_num_nodes, max_num_nodes, p. As a stream, instances_per_batch come with every trigger, and
    the offset is the next instance: a restart goes on where the checkpoint stands."""

    @classmethod
    def name(cls) -> str:
        return "graphs"

    def schema(self) -> str:
        return "inst long, n int, edge_idx int, u int, v int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        n, parts = int(self.options.get("instances", 256)), int(self.options.get("partitions", 8))
        cuts = [n * i // parts for i in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _rows(self.options, partition.begin, partition.end)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"inst": int(self.options.get("first", 0))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = self.options.get("instances")
        end = start["inst"] + int(self.options.get("instances_per_batch", 32))
        end = min(end, int(last)) if last else end
        return iter(list(_rows(self.options, start["inst"], end))), {"inst": max(end, start["inst"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.options, start["inst"], end["inst"])


def register(spark: SparkSession) -> None:
    from graphloom.functions.shipping import ship

    ship(spark)
    spark.dataSource.register(GraphSource)
