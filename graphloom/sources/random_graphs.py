"""Random undirected graphs: independent edges, points in space, and ways to make a graph connected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.draws import between, draw, uniform
from graphloom.functions.kernels import map_instances


def instances(spark: SparkSession, batch: int, low: int, high: int, seed: int, first: int = 0) -> DataFrame:
    """(inst, n): numbers of nodes drawn from low to high."""
    return sized(spark.range(first, first + batch).withColumnRenamed("id", "inst"), low, high, seed)


def sized(ids: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """``ids(inst)`` with numbers of nodes."""
    if not 0 < low <= high:
        raise ValueError("numbers of nodes must be 0 < min <= max")
    return ids.select("inst", between(low, high, seed, F.lit("n"), "inst").alias("n"))


def _pairs(nodes: DataFrame) -> DataFrame:
    """(inst, n, u, v) for all u < v of each instance: rows made in place, nothing is joined."""
    u = nodes.select("inst", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("u")).filter("n >= 2")
    return u.select("inst", "n", "u", F.explode(F.sequence(F.col("u") + 1, F.col("n") - 1)).alias("v"))


def _numbered(raw: DataFrame, order: list) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("inst").orderBy(*order)) - 1
    return raw.select("inst", number.cast("int").alias("edge_idx"), "u", "v")


def erdos_renyi(nodes: DataFrame, p: float = -1.0, seed: int = 0) -> DataFrame:
    """edges of G(n, p), p < 0 meaning 1 / n, in order of (u, v)."""
    if p > 1:
        raise ValueError("p must be at most 1")
    chance = F.lit(p) if p >= 0 else 1 / F.col("n")
    return _numbered(_pairs(nodes).filter(uniform(seed, F.lit("er"), "inst", "u", "v") < chance), ["u", "v"])


def uniform_points(nodes: DataFrame, dim: int = 2, seed: int = 0) -> DataFrame:
    """points uniform in the unit cube."""
    each = nodes.select("inst", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("node"))
    return each.select("inst", "node", F.array(*(uniform(seed, F.lit("point"), "inst", "node", F.lit(i)) for i in range(dim))).alias("pos"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def euclidean(points: DataFrame, radius: float | Column) -> DataFrame:
    """edges between points nearer than radius, in order of (u, v).

    A range join as an equi-join: points meet only in their own and neighbouring cells of a grid whose cells are as
    wide as the radius, in the first two dimensions; the rest is a filter.
    """
    wide = radius if isinstance(radius, Column) else F.lit(float(radius))
    spot = points.withColumn("r", wide).withColumn("x", F.floor(F.get("pos", F.lit(0)) / F.col("r"))).withColumn("y", F.floor(F.coalesce(F.get("pos", F.lit(1)), F.lit(0.0)) / F.col("r")))
    near = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = spot.select("inst", F.col("node").alias("u"), F.col("pos").alias("pu"), "r", "x", "y", F.explode(near).alias("d"))
    left = left.select("inst", "u", "pu", "r", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    right = spot.select("inst", F.col("node").alias("v"), F.col("pos").alias("pv"), "x", "y")
    # partitioned by instance alone, as all later steps want it; the cells are part of the join's sort
    found = left.repartition("inst").join(right.repartition("inst"), ["inst", "x", "y"]).filter("u < v")
    return _numbered(found.filter(_distance("pu", "pv") < F.col("r")), ["u", "v"])


def default_radius(nodes_column: str = "n") -> Column:
    return 1 / F.sqrt(F.col(nodes_column))


def connections(n: Column, c_min: int, c_max: int, seed: int, *key) -> Column:
    """How many edges a component gets: 1 in graphs of fewer than c_min nodes, 2 of more than c_max, else 1 or 2."""
    return F.when(n < c_min, 1).when(n > c_max, 2).otherwise(between(1, 2, seed, F.lit("c"), *key))


_JOINED = "inst long, n int, edges array<struct<edge_idx:int,u:int,v:int>>"


def _host_components(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    groups: dict[int, list[int]] = {}
    for x in range(n):
        groups.setdefault(find(x), []).append(x)
    return list(groups.values())


def _how_many(n: int, c_min: int, c_max: int, seed: int, *key) -> int:
    from graphloom.functions.draws import host_between

    return 1 if n < c_min else 2 if n > c_max else host_between(1, 2, seed, "c", *key)


def _grow(row: dict, extra) -> list[dict]:
    """Adds the edges that ``extra(components, round)`` names until there is one component; one row per edge."""
    pairs = [(e["u"], e["v"]) for e in sorted(row["edges"] or [], key=lambda e: e["edge_idx"])]
    seen = {frozenset(p) for p in pairs}
    turn = 0
    while len(parts := _host_components(row["n"], pairs)) > 1:
        for u, v in extra(parts, turn):
            if u != v and frozenset((u, v)) not in seen:
                seen.add(frozenset((u, v)))
                pairs.append((u, v))
        turn += 1
    return [{"inst": row["inst"], "edge_idx": i, "u": u, "v": v} for i, (u, v) in enumerate(pairs)]


_EDGES = "inst long, edge_idx int, u int, v int"


def _gathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = edges.groupBy("inst").agg(F.collect_list(F.struct("edge_idx", "u", "v")).alias("edges"))
    return nodes.select("inst", "n").join(own, "inst", "left")


def connect_random(nodes: DataFrame, edges: DataFrame, c_min: int = 75, c_max: int = 125, seed: int = 0) -> DataFrame:
    """``edges`` and more until each graph is connected: in rounds, each component in turn is tied once or twice to a
    drawn node of a component at its place or behind it."""
    from graphloom.functions.draws import host_between

    def kernel(row: dict) -> list[dict]:
        def extra(parts: list[list[int]], turn: int) -> list[tuple[int, int]]:
            out = []
            for i, own in enumerate(parts):
                for c in range(_how_many(row["n"], c_min, c_max, seed, row["inst"], turn, i)):
                    key = (row["inst"], turn, i, c)
                    other = parts[host_between(i, len(parts) - 1, seed, "to", *key)]
                    out.append((own[host_between(0, len(own) - 1, seed, "from", *key)], other[host_between(0, len(other) - 1, seed, "at", *key)]))
            return out

        return _grow(row, extra)

    return map_instances(_gathered(nodes, edges), kernel, _EDGES)


def connect_nearest(nodes: DataFrame, edges: DataFrame, points: DataFrame, c_min: int = 75, c_max: int = 125, seed: int = 0) -> DataFrame:
    """``edges`` and more until each graph is connected: in rounds, each component is tied to its one or two nearest
    components, at their closest pair of points."""
    import numpy as np

    def kernel(row: dict) -> list[dict]:
        spots = {p["node"]: p["pos"] for p in row["points"] or []}
        x = np.array([spots[i] for i in range(row["n"])], float).reshape(row["n"], -1)
        far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))

        def extra(parts: list[list[int]], turn: int) -> list[tuple[int, int]]:
            out = []
            for i, own in enumerate(parts):
                near = []
                for j, other in enumerate(parts):
                    if j != i:
                        block = far[np.ix_(own, other)]
                        a, b = divmod(int(block.argmin()), len(other))
                        near.append((float(block[a, b]), j, own[a], other[b]))
                for _, _, u, v in sorted(near)[: _how_many(row["n"], c_min, c_max, seed, row["inst"], turn, i)]:
                    out.append((u, v))
            return out

        return _grow(row, extra)

    spots = points.groupBy("inst").agg(F.collect_list(F.struct("node", "pos")).alias("points"))
    return map_instances(_gathered(nodes, edges).join(spots, "inst", "left"), kernel, _EDGES)


def shuffled_edges(edges: DataFrame, seed: int) -> DataFrame:
    """edges with edge_idx drawn anew: the order in which a graph is told."""
    number = F.row_number().over(Window.partitionBy("inst").orderBy(draw(seed, F.lit("edge"), "inst", "edge_idx"), "edge_idx")) - 1
    return edges.select("inst", number.cast("int").alias("edge_idx"), "u", "v")


def expected_edges(n: int, p: float) -> float:
    """Mean number of edges of G(n, p): for choosing parameters."""
    return math.comb(n, 2) * (1 / n if p < 0 else p)
