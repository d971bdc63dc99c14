"""Graphs of a given shape: trees, stars of paths, and balanced look-ahead graphs with a known start and end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.draws import between, host_between, host_draw, host_uniform
from graphloom.functions.kernels import map_instances

_EDGES = "inst long, edge_idx int, u int, v int"


def full_tree_edges(nodes: DataFrame, degree: int, max_depth: int = -1) -> DataFrame:
    """Full trees with ``degree`` children a node, cut off at n nodes or below max_depth: node i > 0 hangs on
    (i - 1) div degree, so that no tree has to be grown."""
    if degree < 2:
        raise ValueError("degree must be at least 2")
    size = F.col("n")
    if max_depth >= 0:
        size = F.least(size, F.lit(min((degree ** (max_depth + 1) - 1) // (degree - 1), 1 << 30)))
    each = nodes.select("inst", F.explode(F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))).alias("v"))
    return each.select("inst", (F.col("v") - 1).cast("int").alias("edge_idx"), F.floor((F.col("v") - 1) / degree).cast("int").alias("u"), F.col("v").cast("int").alias("v"))


def _grow_tree(row: dict, degree: int, max_depth: int, bernoulli_p: float, probs: tuple[float, ...] | None, seed: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Edges in the order of growth, and nodes by level."""
    key = ("tree", row["inst"])
    n = row["n"]
    edges: list[tuple[int, int]] = []
    levels = [[0]]
    total = sum(probs) if probs else 0.0
    while levels[-1] and (max_depth < 0 or len(levels) <= max_depth) and len(edges) + 1 < n:
        level: list[int] = []
        for node in levels[-1]:
            if probs:
                x = host_uniform(seed, *key, node) * total
                children = 1
                for w in probs[:-1]:
                    if x < w:
                        break
                    x -= w
                    children += 1
            elif bernoulli_p > 0:
                children = sum(host_uniform(seed, *key, node, i) < bernoulli_p for i in range(degree))
            else:
                children = degree
            depth = len(levels) - 1
            # no graph without edges, and a choice at the root
            if children == 0 and depth < 3:
                children = 1
            if children == 1 and depth < 1:
                children = 2
            for _ in range(min(children, n - 1 - len(edges))):
                edges.append((node, len(edges) + 1))
                level.append(len(edges))
        levels.append(level)
    return edges, [x for x in levels if x]


def random_trees(nodes: DataFrame, degree: int = 3, max_depth: int = 7, bernoulli_p: float = 0.5, probs: tuple[float, ...] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """edges of random trees, and (inst, start, end): the root and a node at the edge of a drawn level.

    Children are binomial (degree, bernoulli_p), or 1 + a draw by the weights ``probs``, or always ``degree`` if
    bernoulli_p is 0. Growth is breadth-first and stops at n nodes or at max_depth levels (-1: never).
    """
    if degree < 2 or (max_depth != -1 and max_depth < 2):
        raise ValueError("degree and max_depth must be at least 2")

    def kernel(row: dict) -> list[dict]:
        edges, levels = _grow_tree(row, degree, max_depth, bernoulli_p, probs, seed)
        depth = host_between(1, max(1, len(levels) - 1), seed, "depth", row["inst"])
        last = levels[min(depth, len(levels) - 1)]
        end = last[0] if host_draw(seed, "side", row["inst"]) % 2 else last[-1]
        return [{"inst": row["inst"], "edge_idx": i, "u": u, "v": v, "end": end} for i, (u, v) in enumerate(edges)]

    grown = map_instances(nodes.select("inst", "n"), kernel, _EDGES + ", end int")
    ends = grown.groupBy("inst").agg(F.lit(0).alias("start"), F.first("end").alias("end"))
    return grown.drop("end"), ends


def path_stars(spark: SparkSession, batch: int, arms: tuple[int, int], length: tuple[int, int], seed: int = 0, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """A batch of :func:`stars_of`."""
    return stars_of(spark.range(first, first + batch).withColumnRenamed("id", "inst"), arms, length, seed)


def stars_of(ids: DataFrame, arms: tuple[int, int], length: tuple[int, int], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Directed edges of stars, and (inst, start, end, arms, length). Each arm has ``length`` nodes, the common start
    among them; the end is the first arm's last node. In closed form: nothing is grown."""
    if min(arms) < 1 or min(length) < 2:
        raise ValueError("a star needs an arm, and an arm two nodes")
    drawn = ids.select("inst", between(*arms, seed, F.lit("arms"), "inst").alias("arms"), between(*length, seed, F.lit("length"), "inst").alias("length"))
    each = drawn.select("inst", "length", F.explode(F.sequence(F.lit(0), F.col("arms") * (F.col("length") - 1) - 1)).alias("edge_idx"))
    starts = F.col("edge_idx") % (F.col("length") - 1) == 0
    edges = each.select("inst", "edge_idx", F.when(starts, 0).otherwise(F.col("edge_idx")).cast("int").alias("u"), (F.col("edge_idx") + 1).cast("int").alias("v"))
    return edges, drawn.select("inst", F.lit(0).alias("start"), (F.col("length") - 1).cast("int").alias("end"), "arms", "length")


def balanced_fits(n: int, lookahead: int, reserve: int = 0) -> bool:
    """Whether n nodes hold two arms of the look-ahead, the start and the reserve."""
    return n > 0 and n > 2 * lookahead + reserve + 1


def balanced_arms(nodes: DataFrame, reserve: int = 0, seed: int = 0) -> DataFrame:
    """(inst, n, lookahead, arm, begin, length, back): the paths of balanced graphs, from nodes(inst, n, lookahead).

    Arm 0 is the true path of ``lookahead`` edges, arms 1 to a drawn number leave the start too, one edge longer or not,
    as far as nodes last; then one arm may lead into the start (back). begin is an arm's first own node.
    """
    room = F.col("n") - reserve - 1 - F.col("lookahead")
    most = F.floor(room / F.col("lookahead")).cast("int")
    drawn = nodes.filter(F.col("n") > 2 * F.col("lookahead") + reserve + 1)
    drawn = drawn.withColumn("others", F.lit(1) + (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("paths"), F.col("inst").cast("string"))), 1, 8), 16, 10).cast("long") % most).cast("int"))
    wanted = F.transform(F.sequence(F.lit(1), F.col("others")), lambda i: F.col("lookahead") + between(0, 1, seed, F.lit("arm"), "inst", i))
    # each takes what it wants of what is left
    lengths = F.aggregate(
        wanted,
        F.struct(room.cast("int").alias("left"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda s, w: F.struct((s["left"] - F.least(w, s["left"])).alias("left"), F.concat(s["out"], F.array(F.least(w, s["left"]))).alias("out")),
        lambda s: s["out"],
    )
    drawn = drawn.withColumn("lengths", F.concat(F.array(F.col("lookahead")), lengths))
    used = F.aggregate("lengths", F.lit(1), lambda s, x: s + x)
    spare = F.col("n") - used - 1
    # the arm into the start
    back = F.when(spare > 0, between(F.lit(0), F.least(spare, F.col("lookahead")), seed, F.lit("in"), "inst")).otherwise(0)
    drawn = drawn.withColumn("used", used).withColumn("back_length", back.cast("int"))
    arms = drawn.select("inst", "n", "lookahead", "lengths", F.posexplode("lengths").alias("arm", "length"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("arm")), F.lit(1), lambda s, x: s + x)
    out = arms.select("inst", "n", "lookahead", "arm", before.alias("begin"), "length", F.lit(False).alias("back"))
    into = drawn.select("inst", "n", "lookahead", (F.col("others") + 1).alias("arm"), F.col("used").alias("begin"), F.col("back_length").alias("length"), F.lit(True).alias("back"))
    return out.unionByName(into).filter("length > 0")


def arm_edges(arms: DataFrame) -> DataFrame:
    """(inst, u, v) along the arms: from the start outwards, or for the arm into the start towards it."""
    step = arms.select("inst", "begin", "back", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    own = F.col("begin") + F.col("i")
    toward = F.when(F.col("i") == 0, 0).otherwise(own - 1)
    return step.select("inst", F.when(F.col("back"), own).otherwise(toward).cast("int").alias("u"), F.when(F.col("back"), toward).otherwise(own).cast("int").alias("v"))


def _noise(row: dict, max_parents: int, max_noise: int, seed: int) -> list[tuple[int, int]]:
    """Arcs of the nodes left over, each tied to nodes before it; no cycle arises.

    The law: a node draws 0 to ``max_parents`` children with replacement, then as many different parents that it can't
    reach (at least one if it has no child), both with weight 1/2 + the times a node was drawn as a child before. Such a
    weight is a mixture: half a share for each node, a whole one for each earlier draw; so children are drawn from that
    list. Parents are the least of exponential times, whose rates are the weights.
    """
    every = np.array([(e["u"], e["v"]) for e in row["edges"]], np.int64).reshape(-1, 2)
    n, first = row["n"], int(every.max(initial=0)) + 1
    if max_noise == 0 or first >= n - 1 and max_noise < 0:
        return []
    below = _reached(every, n)
    met: list[int] = []
    arcs: dict[tuple[int, int], None] = {}
    draw = lambda *key: host_uniform(seed, "noise", row["inst"], *key)
    for x in range(first, n):
        n_children, n_parents = (host_between(low, max_parents, seed, what, row["inst"], x) for low, what in ((0, "children"), (0, "parents")))
        if not n_children and not n_parents:
            n_parents = host_between(1, max_parents, seed, "parent", row["inst"], x)
        share = np.bincount(np.array(met, np.int64), minlength=x)[:x] + 0.5
        spots = [draw(x, "child", i) * (x / 2 + len(met)) for i in range(n_children)]
        chosen = [int(2 * s) if s < x / 2 else met[int(s - x / 2)] for s in spots]
        met += chosen
        below[x, chosen] = True
        below[x] |= below[chosen].any(axis=0)
        free = np.flatnonzero(~below[x, :x])
        times = [-math.log(1 - draw(x, "parent", int(j))) / share[j] for j in free]
        above = free[np.argsort(times, kind="stable")[:n_parents]]
        arcs |= dict.fromkeys([(x, c) for c in chosen] + [(int(p), x) for p in above])
        # all that leads to a parent, and the parent, now leads to x and on
        sources = below[:, above].any(axis=1)
        sources[above] = True
        below[sources] |= below[x] | (np.arange(n) == x)
    return list(arcs)


def _reached(arcs: np.ndarray, n: int) -> np.ndarray:
    """Which nodes each node leads to: the closure of arcs, squared until it stands."""
    below = np.zeros((n, n), bool)
    below[arcs[:, 0], arcs[:, 1]] = True
    while True:
        more = below | (below.astype(np.float32) @ below > 0)
        if (more == below).all():
            return below
        below = more


def balanced(nodes: DataFrame, reserve: int = 0, max_parents: int = 4, max_noise: int = -1, seed: int = 0, end_on_path: bool = True) -> tuple[DataFrame, DataFrame]:
    """Directed edges of balanced graphs and (inst, start, end), from nodes(inst, n, lookahead).

    The end is the true path's last node, or with ``end_on_path=False`` the one before it. Noise is on unless
    max_noise is 0. Instances too small for their look-ahead are left out.
    """
    arms = balanced_arms(nodes, reserve, seed)
    own = arm_edges(arms).groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))
    rows = nodes.select("inst", "n").join(own, "inst")

    def kernel(row: dict) -> list[dict]:
        every = [(e["u"], e["v"]) for e in row["edges"]] + _noise(row, max_parents, max_noise, seed)
        return [{"inst": row["inst"], "edge_idx": i, "u": u, "v": v} for i, (u, v) in enumerate(every)]

    ends = arms.filter("arm = 0").select("inst", F.lit(0).alias("start"), (F.col("lookahead") - (0 if end_on_path else 1)).cast("int").alias("end"))
    return map_instances(rows, kernel, _EDGES), ends
