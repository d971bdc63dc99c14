"""Any table as graphs, point sets or sequences: the ordinary way in for data that was not generated here.

Canonical tables: edges(inst, edge_idx, u, v), points(inst, node, pos), sequences(inst, i, token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges_from(table: DataFrame, inst: Column, u: Column, v: Column, order: Column, directed: bool = False) -> DataFrame:
    """edges of one graph per value of ``inst``: loops go, of parallel edges (either way round, if not directed) the
    first by (order, u, v) stays, and edge_idx numbers them in that order from 0. Rows with a null go.

    One shuffle, by inst; everything later that works by instance keeps that partitioning.
    """
    raw = table.select(inst.cast("long").alias("inst"), u.cast("int").alias("u"), v.cast("int").alias("v"), order.alias("o"))
    raw = raw.filter("u <> v and inst is not null").repartition("inst")
    ends = (F.col("u"), F.col("v")) if directed else (F.least("u", "v"), F.greatest("u", "v"))
    kept = raw.groupBy("inst", ends[0].alias("a"), ends[1].alias("b")).agg(F.min(F.struct("o", "u", "v")).alias("e"))
    number = F.row_number().over(Window.partitionBy("inst").orderBy("e.o", "e.u", "e.v")) - 1
    return kept.select("inst", number.cast("int").alias("edge_idx"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))


def arcs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, u, v, edge_idx) in each direction that an edge can be walked."""
    forward = edges.select("inst", "u", "v", "edge_idx")
    return forward if directed else edges.select("inst", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"), "edge_idx").select("inst", "e.u", "e.v", "edge_idx")


def nodes(edges: DataFrame) -> DataFrame:
    """(inst, node) for every node with an edge."""
    return edges.select("inst", F.explode(F.array("u", "v")).alias("node")).distinct()


def points_from(table: DataFrame, inst: Column, order: Column, position: Column) -> DataFrame:
    """points of one set per value of ``inst``, numbered by order from 0."""
    raw = table.select(inst.cast("long").alias("inst"), order.alias("o"), position.alias("pos")).filter("inst is not null and pos is not null")
    number = F.row_number().over(Window.partitionBy("inst").orderBy("o", "pos")) - 1
    return raw.select("inst", number.cast("int").alias("node"), "pos")


def sequences_from(table: DataFrame, inst: Column, order: Column, token: Column) -> DataFrame:
    """sequences of one per value of ``inst`` in order, a token that repeats the one before it left out."""
    raw = table.select(inst.cast("long").alias("inst"), order.alias("o"), token.cast("int").alias("token")).filter("inst is not null and token is not null")
    by = Window.partitionBy("inst").orderBy("o", "token")
    kept = raw.withColumn("before", F.lag("token").over(by)).filter("before is null or before <> token")
    return kept.select("inst", (F.row_number().over(by) - 1).cast("int").alias("i"), "token")
