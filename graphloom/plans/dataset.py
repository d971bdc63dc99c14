"""From parameters to packaged instances: one lazy plan, everything keyed by inst."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import BfsArgs, KhopsArgs, PathArgs, PosArgs, TokenArgs, group_of
from graphloom.functions.vocab import POSITIONS, Vocab, default_vocab
from graphloom.operators import distances as D
from graphloom.operators import khops, layout, order, paths, search, splits
from graphloom.sources import khops as khop_sources
from graphloom.sources import registry


@dataclass
class Dataset:
    """The tables of a batch; those that a family doesn't have are None."""

    graph_type: str
    task_type: str
    scratchpad_type: str
    vocab: Vocab
    nodes: DataFrame
    edges: DataFrame | None
    dist: DataFrame | None
    packaged_dist: DataFrame | None
    ends: DataFrame | None
    instances: DataFrame
    packaged: DataFrame
    hashes: DataFrame

    def close(self) -> None:
        """Lets go of what the batch keeps in memory."""
        for kept in (self.edges, self.dist, self.ends):
            if kept is not None:
                kept.unpersist()


def _vocab(options: dict, graph_type: str = "") -> Vocab:
    """The vocabulary given, or one with an id for each node of the largest graph."""
    most = options.get("max_num_nodes", 25)
    if graph_type == "path_star":
        most = options.get("max_num_arms", 5) * (options.get("max_arm_length", 10) - 1) + 1
    return options.get("vocab") or default_vocab(options.get("max_vocab_nodes", most), options.get("num_depth_markers", 25))


def build(spark: SparkSession, graph_type: str, task_type: str = "shortest_path", scratchpad_type: str = "none", seed: int = 0, first: int = 0, **options) -> Dataset:
    """One batch of a family with its task, tokens and packaging."""
    ids = spark.range(first, first + options.get("batch_size", 256)).withColumnRenamed("id", "inst")
    return build_of(ids, graph_type, task_type, scratchpad_type, seed, **options)


def build_of(ids: DataFrame, graph_type: str, task_type: str = "shortest_path", scratchpad_type: str = "none", seed: int = 0, **options) -> Dataset:
    """The same of the instances in ``ids(inst)``, whatever batch they come in."""
    if scratchpad_type not in ("none", "bfs", "dfs"):
        raise ValueError(f"no such scratchpad: {scratchpad_type}")
    tok, batch_size = group_of(TokenArgs, options), options.get("batch_size", 256)
    vocab = _vocab(options, graph_type)
    positions = options.get("positions", POSITIONS)
    if graph_type in ("khops", "khops_gen"):
        return _khops(ids, graph_type, seed, options, tok, vocab, positions, batch_size)
    if task_type not in ("shortest_path", "bfs", "none", "None"):
        raise ValueError(f"no such task: {task_type}")
    directed = registry.is_directed(graph_type)
    nodes, edges, ends = registry.graphs_of(ids, graph_type, seed, **options)
    edges = edges.repartition("inst").persist()
    data = _of_graphs(nodes, edges, ends, directed, graph_type, task_type, scratchpad_type, seed, options, tok, vocab, positions, batch_size)
    return data


def from_edges(nodes: DataFrame, edges: DataFrame, directed: bool, task_type: str = "shortest_path", scratchpad_type: str = "none", seed: int = 0, **options) -> Dataset:
    """The same over any graphs: nodes(inst, n) and edges(inst, edge_idx, u, v) with nodes from 0 to n - 1."""
    tok = group_of(TokenArgs, options)
    return _of_graphs(nodes, edges, None, directed, "table", task_type, scratchpad_type, seed, options, tok, _vocab(options), options.get("positions", POSITIONS), options.get("batch_size", 256))


def _of_graphs(nodes, edges, ends, directed, graph_type, task_type, scratchpad_type, seed, options, tok, vocab, positions, batch_size) -> Dataset:
    pos, path_args, bfs = group_of(PosArgs, options), group_of(PathArgs, options), group_of(BfsArgs, options)
    own = nodes.join(edges.select("inst").distinct(), "inst", "left_semi")
    names = order.node_map(own, vocab.min_vocab, vocab.max_vocab, seed, options.get("shuffle_nodes", True))
    tokens = paths.node_tokens(names)
    dist = D.distances(edges, directed, options.get("plan", "tensor"), own).persist()
    packed = D.packaged_distances(dist, names)
    if task_type in ("none", "None"):
        ends, parts = None, own.select("inst").withColumns({c: F.expr(f"cast(array() as {k})") for c, k in (("query", "array<int>"), ("task", "array<int>"), ("targets", "array<array<int>>"))}).withColumn("difficulty", F.lit(0))
        scratch = None
    else:
        known = ends
        ends = paths.start_end(dist, path_args, seed, known.select("inst", "start") if known is not None and graph_type == "random_tree" and path_args.start_at_root else None) if known is None or graph_type == "random_tree" else known.join(dist.select("inst", F.col("src").alias("start"), F.col("dst").alias("end"), "d"), ["inst", "start", "end"]).select("inst", "start", "end", "d")
        ends = ends.persist()
        scratch = None
        if scratchpad_type == "bfs" or task_type == "bfs":
            traces = search.bfs_traces(edges, ends, bfs, directed)
            way = paths.paths_of_trace(traces.filter("found"))
            scratch = search.bfs_tokens(traces, tokens, vocab, bfs)
        elif scratchpad_type == "dfs":
            traces = search.dfs_traces(edges, ends, tokens, True, directed, seed)
            way = paths.paths_of_trace(traces.filter("found"))
            scratch = search.dfs_tokens(traces, tokens, vocab, bfs.unique_depth_markers).select("inst", "scratchpad")
        else:
            way = paths.told_paths(edges, ends, seed, directed)
        # a searched path is the task as it was found: no other labels
        labels = None if scratch is None else way.select("inst", F.posexplode("path").alias("step", "node")).select("inst", "step", "node", F.array("node").alias("labels"))
        parts = paths.path_tokens(way, labels, tokens, vocab)
    graph = layout.graph_tokens(edges, order.node_order(edges), tokens, vocab, positions, tok, pos)
    parts = parts.join(graph, "inst")
    parts = parts.join(scratch, "inst") if scratch is not None else parts.withColumn("scratchpad", F.lit(None).cast("array<int>"))
    counts = edges.groupBy("inst").agg(F.count("*").cast("int").alias("num_edges"))
    parts = parts.join(own.select("inst", F.col("n").alias("num_nodes")), "inst").join(counts, "inst")
    parts = parts.withColumns({"graph_type": F.lit(graph_type), "task_type": F.lit(task_type), "scratchpad_type": F.lit(scratchpad_type)})
    if task_type in ("none", "None"):
        parts = parts.withColumns({"task": F.array(vocab.lit("=")), "targets": F.array(F.array(vocab.lit("=")))})
    whole = layout.instance_tokens(parts, vocab, positions, tok, pos)
    return Dataset(graph_type, task_type, scratchpad_type, vocab, own, edges, dist, packed, ends, whole, layout.packaged(whole, vocab, tok, batch_size), splits.distance_hashes(packed))


def _khops(ids, graph_type, seed, options, tok, vocab, positions, batch_size) -> Dataset:
    args = group_of(KhopsArgs, options)
    drawn = khop_sources.khops_of(ids, args, seed)
    low, high = vocab.min_vocab, vocab.max_vocab - 1
    # these tasks have no graph, and no structure in positions
    pos = PosArgs()
    if graph_type == "khops":
        told = khop_sources.sequences(drawn, low, high, seed, args.max_khops + 1 if args.permutation_version else 0)
        hopped = khops.hops(told, args.max_khops, args.right_side_connect).join(drawn.select("inst", "k"), "inst")
        hopped = hopped.withColumn("hops", F.slice("hops", F.lit(1), F.col("k"))).drop("k")
        parts = khops.khops_tokens(hopped, khops.hop_targets(hopped, args, high - low + 1), vocab)
    else:
        parts = khops.generated_tokens(khop_sources.generated_segments(drawn, low, high, args, seed), vocab)
    empty = {"graph": "array<array<int>>", "graph_pos": "array<array<int>>", "edge_rows": "int", "node_rows": "int", "scratchpad": "array<int>"}
    parts = parts.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()})
    parts = parts.withColumns({"num_nodes": F.lit(0), "num_edges": F.lit(0), "graph_type": F.lit(graph_type), "task_type": F.lit(graph_type), "scratchpad_type": F.lit("none")})
    whole = layout.instance_tokens(parts, vocab, positions, tok, pos)
    return Dataset(graph_type, graph_type, "none", vocab, drawn, None, None, None, None, whole, layout.packaged(whole, vocab, tok, batch_size), splits.token_hashes(whole))


def batches(packaged: DataFrame):
    """Batches to the trainer, one by one and in order, each an Arrow table; only one is on the driver at a time."""
    ids = packaged.select("batch_id").distinct().orderBy("batch_id").toLocalIterator()
    for row in ids:
        yield packaged.filter(F.col("batch_id") == row["batch_id"]).orderBy("inst").toArrow()
