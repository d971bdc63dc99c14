"""Connected components of a distributed graph by alternating large-star and small-star rounds.

Each round rewrites edges so that every node points nearer to the smallest node it can reach; the rounds needed grow
with the logarithm of the size. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialize

#: A key with more than this part of all rows is hot: there are at most so many hot keys, few enough to be broadcast.
HOT = 1 << 10
#: Up to so many rows, whatever a table says of their keys is broadcast whole, at some WIDTH bytes a key; of wider keys fewer.
FEW = 1 << 20
WIDTH = 50


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], of: str, total: int, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """``rows`` joined to ``table``, which has each key once and in column ``of`` how many of the ``total`` rows have it.

    The table's hot keys are broadcast, so that their rows stay where they are; the others meet by shuffle. Of few rows
    all keys are broadcast. Keys are without nulls. ``of`` is gone from the result. width: bytes that a key and what the
    table says of it take in a broadcast; FEW * WIDTH bytes are the most that is sent, in keys of any width.
    """
    few = FEW * WIDTH // max(WIDTH, width)
    if total <= few:
        return rows.join(F.broadcast(table.drop(of)), keys, how)
    most = max(16, total // max(1, min(HOT, few)))
    names = [c for c in table.columns if c not in (*keys, of)]
    hot = table.filter(F.col(of) > most).select(*keys, F.struct(F.lit(True).alias("_is"), *names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    own = [c for c in rows.columns if c not in keys]
    out = marked.filter("_hot is not null").select(*keys, *own, *(F.col("_hot").getField(c).alias(c) for c in names))
    rest = marked.filter("_hot is null").drop("_hot").join(table.filter(F.col(of) <= most).drop(of), keys, how)
    return out.unionByName(rest.select(*keys, *own, *names))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("of"))
    return join_by_key(both.filter("b > a"), least, ["a"], "of", total).select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: (x, y) with y <= x; x and all its smaller neighbours join the smallest of them."""
    down = edges.filter("y < x")
    least = down.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("of"))
    moved = join_by_key(down, least, ["x"], "of", total).filter("y > m").select(F.col("y").alias("x"), "m")
    return moved.unionByName(least.select("x", "m")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Edges may be in either direction and repeated; loops and edges with nulls count for nothing. Nodes without edges
    have no row. An empty table gives no rows. The edges of a hub stay where they are: what they need is broadcast.
    """
    edge = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edge = materialize(edge, "edges")
    total, before = edge.count(), None
    while True:
        edge = materialize(_small_star(_large_star(edge, total), total), "edges")
        total, *seen = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (total, *seen) == before:
            break
        before = (total, *seen)
    roots = edge.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return edge.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
