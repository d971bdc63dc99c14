"""Shortest-path tasks: where to start and end, one shortest path, and all labels that would be as good."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import PathArgs
from graphloom.functions.draws import draw, host_draw, host_uniform, uniform
from graphloom.functions.kernels import map_instances
from graphloom.functions.shipping import ship
from graphloom.functions.vocab import Vocab
from graphloom.operators.distances import searched, told_graphs
from graphloom.sources.tables import arcs

#: Lengths drawn before any pair will do.
_DRAWS = 11
#: Cells of a tensor of distances that ends are drawn from.
_CELLS = 1 << 19


def start_end(dist: DataFrame, args: PathArgs, seed: int, starts: DataFrame | None = None) -> DataFrame:
    """(inst, start, end, d): a pair at a drawn distance for each instance.

    Lengths (in nodes) are drawn by weight again and again until one has pairs; after that many misses any pair of
    different nodes will do. With chance ``sample_choice_node`` the pair is the best whose start has two or more
    neighbours: most starts at that length from its end, then most neighbours; else a drawn one. starts (inst, start)
    fixes the starts, and pairs are then only drawn. Instances without any pair have no row.
    """
    # one shuffle: all windows, and the draws of each instance, keep to its partition
    dist = dist.repartition("inst")
    own = Window.partitionBy("inst", "src")
    pairs = dist.withColumn("degree", F.sum(F.when(F.col("d") == 1, 1).otherwise(0)).over(own))
    pairs = pairs.withColumn("same", F.count("*").over(Window.partitionBy("inst", "dst", "d"))).filter("d > 0")
    if starts is not None:
        pairs = pairs.join(starts.select("inst", F.col("start").alias("src")), ["inst", "src"])
    weights = args.weights()
    steps = [sum(weights[: i + 1]) for i in range(len(weights) - 1)]
    marks = F.array(*map(F.lit, steps)) if steps else F.expr("cast(array() as array<double>)")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(_DRAWS - 1)), lambda a: uniform(seed, F.lit("length"), "inst", a) * float(sum(weights)))
    lengths = F.transform(drawn, lambda x: F.lit(args.min_path_length) + F.size(F.filter(marks, lambda m: m <= x)))
    chance = uniform(seed, F.lit("choice"), "inst") < args.sample_choice_node
    pairs = pairs.join(dist.groupBy("inst").agg(F.first("inst").alias("_")).select("inst", lengths.alias("lengths"), chance.alias("by_choice")), "inst")
    turn = F.array_position("lengths", (F.col("d") + 1).cast("int"))
    pairs = pairs.withColumn("turn", F.when(turn > 0, turn).otherwise(_DRAWS + 1))
    pairs = pairs.withColumn("first", F.min("turn").over(Window.partitionBy("inst"))).filter("turn = first")
    best = (F.lit(starts is None) & F.col("by_choice") & (F.col("first") <= _DRAWS)) & (F.col("degree") >= 2)
    rank = F.when(best, F.struct(F.lit(0).alias("o"), (-F.col("same")).alias("s"), (-F.col("degree")).alias("g"))).otherwise(F.struct(F.lit(1).alias("o"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("g")))
    order = Window.partitionBy("inst").orderBy(rank, draw(seed, F.lit("pair"), "inst", "src", "dst"), "src", "dst")
    chosen = pairs.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return chosen.select("inst", F.col("src").alias("start"), F.col("dst").alias("end"), "d")


def told_ends(told: DataFrame, args: PathArgs, seed: int, directed: bool = False) -> DataFrame:
    """What :func:`start_end` draws from the distances of told graphs (inst, us, vs), in one pass over them: no distances
    leave a task."""
    ship(told.sparkSession)
    return told.mapInArrow(lambda it: _end_batches(it, args, seed, directed), "inst long, start int, end int, d int")


def _end_batches(batches: Iterator[pa.RecordBatch], args: PathArgs, seed: int, directed: bool) -> Iterator[pa.RecordBatch]:
    weights = args.weights()
    marks = [float(sum(weights[: i + 1])) for i in range(len(weights) - 1)]
    total = float(sum(weights))
    for batch, some, far in searched(batches, directed, _CELLS):
        inst = batch.column(0).to_numpy()[some]
        n = far.shape[1]
        most = far.max(axis=(1, 2))
        # the drawn length in nodes, by graph, until one has pairs; -1 once any pair will do, 0 where there is none
        there = np.zeros((len(some), int(most.max(initial=0)) + 1), bool)
        for d in range(there.shape[1]):
            there[:, d] = (far == d).any(axis=(1, 2))
        out = []
        for k in range(len(some)):
            if most[k] < 1:
                continue
            key = int(inst[k])
            turn = -1
            for a in range(_DRAWS):
                x = host_uniform(seed, "length", key, a) * total
                d = args.min_path_length + sum(m <= x for m in marks) - 1
                if 0 < d < there.shape[1] and there[k, d]:
                    turn = d
                    break
            own = far[k]
            src, dst = np.nonzero(own == turn if turn > 0 else own > 0)
            if turn > 0 and host_uniform(seed, "choice", key) < args.sample_choice_node:
                degree = (own == 1).sum(axis=1)[src]
                if (degree >= 2).any():
                    same = (own == turn).sum(axis=0)[dst]
                    rank = np.where(degree >= 2, same * (n + 1) + degree, -1)
                    src, dst = src[rank == rank.max()], dst[rank == rank.max()]
            a, b = src.tolist(), dst.tolist()
            i = min(range(len(a)), key=lambda i: (host_draw(seed, "pair", key, a[i], b[i]), a[i], b[i])) if len(a) > 1 else 0
            out.append((key, a[i], b[i], int(own[a[i], b[i]])))
        if out:
            columns = zip(*out, strict=True)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["inst", "start", "end", "d"])


def toward(dist: DataFrame, ends: DataFrame) -> DataFrame:
    """(inst, node, left): each node's distance to its instance's end."""
    return dist.join(ends.select("inst", F.col("end").alias("dst")), ["inst", "dst"]).select("inst", F.col("src").alias("node"), F.col("d").alias("left"))


def shortest_paths(edges: DataFrame, dist: DataFrame, ends: DataFrame, seed: int, directed: bool = False) -> DataFrame:
    """(inst, start, end, path): a shortest path, at each node by a drawn neighbour that is nearer to the end."""
    left = toward(dist, ends)
    steps = arcs(edges, directed).select("inst", F.col("u").alias("node"), F.col("v").alias("to"))
    nearer = steps.join(left, ["inst", "node"]).join(left.select("inst", F.col("node").alias("to"), F.col("left").alias("rest")), ["inst", "to"]).filter("rest = left - 1")
    best = F.min(F.struct(draw(seed, F.lit("step"), "inst", "node", "to").alias("r"), F.col("to"))).alias("b")
    ways = nearer.groupBy("inst", "node").agg(best).groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("node", "b.to"))).alias("next"))
    every = ends.join(ways, "inst", "left")
    path = F.aggregate(
        F.sequence(F.lit(1), F.col("d")), F.array("start"), lambda p, i: F.when(i <= F.col("d"), F.concat(p, F.array(F.element_at("next", F.element_at(p, -1))))).otherwise(p)
    )
    return every.select("inst", "start", "end", F.when(F.col("d") == 0, F.array("start")).otherwise(path).alias("path"))


def label_smoothing(paths: DataFrame, edges: DataFrame, dist: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, step, node, labels): at each step the path's node, then in order all others that a shortest path could go
    to from the node before."""
    ends = paths.select("inst", "end")
    left = toward(dist, ends)
    steps = paths.select("inst", F.size("path").alias("size"), "path", F.posexplode("path").alias("step", "node"))
    steps = steps.select("inst", "step", "node", F.get("path", F.col("step") - 1).alias("before"), (F.col("size") - 1 - F.col("step")).alias("left"))
    near = arcs(edges, directed).select("inst", F.col("u").alias("before"), F.col("v").alias("other")).distinct()
    good = near.join(left.select("inst", F.col("node").alias("other"), "left"), ["inst", "other"])
    other = steps.join(good, ["inst", "before", "left"], "left")
    labels = F.concat(F.array("node"), F.array_sort(F.collect_list(F.when(F.col("other") != F.col("node"), F.col("other")))))
    return other.groupBy("inst", "step", "node").agg(labels.alias("labels"))


def told_paths(edges: DataFrame, ends: DataFrame, seed: int, directed: bool = False) -> DataFrame:
    """(inst, start, end, path, labels): what :func:`shortest_paths` and :func:`label_smoothing` give, in one pass over
    graphs that each fit one row, from edges or told graphs (inst, us, vs). One search back from the end tells how far every node is; no distances are joined."""

    def kernel(row: dict) -> list[dict]:
        out: dict[int, set[int]] = {}
        back: dict[int, set[int]] = {}
        for u, v in zip(row["us"], row["vs"], strict=True):
            for a, b in ((u, v),) if directed else ((u, v), (v, u)):
                out.setdefault(a, set()).add(b)
                back.setdefault(b, set()).add(a)
        inst, start, end = row["inst"], row["start"], row["end"]
        left, front = {end: 0}, [end]
        while front and start not in left:
            front = [x for y in front for x in back.get(y, ()) if x not in left and left.setdefault(x, left[y] + 1)]
        if start not in left:
            return []
        path, labels = [start], [[start]]
        while path[-1] != end:
            at = path[-1]
            good = sorted(x for x in out[at] if left.get(x) == left[at] - 1)
            step = min(good, key=lambda x: (host_draw(seed, "step", inst, at, x), x))
            path.append(step)
            labels.append([step, *(x for x in good if x != step)])
        return [{"inst": inst, "start": start, "end": end, "path": path, "labels": labels}]

    told = edges if "us" in edges.columns else told_graphs(edges)
    rows = told.join(ends.select("inst", "start", "end"), "inst")
    return map_instances(rows, kernel, "inst long, start int, end int, path array<int>, labels array<array<int>>")


def label_rows(told: DataFrame) -> DataFrame:
    """(inst, step, node, labels) of told paths."""
    each = told.select("inst", F.posexplode(F.arrays_zip("path", "labels")).alias("step", "x"))
    return each.select("inst", "step", F.col("x.path").alias("node"), F.col("x.labels").alias("labels"))


def paths_of_trace(traces: DataFrame) -> DataFrame:
    """(inst, start, end, path) of the search that a scratchpad tells, to be the task's path."""
    return traces.select("inst", F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("end"), "path")


def path_tokens(paths: DataFrame, labels: DataFrame | None, tokens: DataFrame, vocab: Vocab) -> DataFrame:
    """(inst, query, task, targets, difficulty): ``/ start end ?`` and ``= path .`` with a list of labels for each task
    token, from tokens(inst, tokens): the id of every node, by node. Without ``labels``, paths have their own."""
    if labels is None:
        rows = paths.withColumn("l", F.transform("labels", lambda x: F.struct(x.alias("labels")))).join(tokens, "inst")
    else:
        by_step = labels.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("step", "labels"))).alias("l"))
        rows = paths.join(by_step, "inst").join(tokens, "inst")
    of = lambda x: F.get("tokens", x)
    query = F.array(vocab.lit("/"), of(F.col("start")), of(F.col("end")), vocab.lit("?"))
    task = F.concat(F.array(vocab.lit("=")), F.transform("path", of), F.array(vocab.lit(".")))
    targets = F.concat(F.array(F.array(vocab.lit("="))), F.transform("l.labels", lambda x: F.transform(x, of)), F.array(F.array(vocab.lit("."))))
    return rows.select("inst", query.alias("query"), task.alias("task"), targets.alias("targets"), F.size("path").alias("difficulty"))


def node_tokens(node_map: DataFrame) -> DataFrame:
    """(inst, tokens): the id of each node as an array by node, from node_map(inst, node, token) of nodes 0 to n - 1."""
    return node_map.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("node", "token"))).alias("m")).select("inst", F.col("m.token").alias("tokens"))
