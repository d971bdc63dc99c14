"""How a graph is told: node names, node order, edges told twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.draws import draw


def node_map(nodes: DataFrame, min_vocab: int, max_vocab: int, seed: int, shuffle: bool = True) -> DataFrame:
    """(inst, node, token) from nodes(inst, n): a drawn injection into the ids from min_vocab on (or node + min_vocab).

    Instances with more nodes than ids raise an error.
    """
    return node_names(nodes, min_vocab, max_vocab, seed, shuffle).select("inst", F.posexplode("tokens").alias("node", "token"))


def node_names(nodes: DataFrame, min_vocab: int, max_vocab: int, seed: int, shuffle: bool = True) -> DataFrame:
    """The same as (inst, tokens): the id of each node as an array by node."""
    size = max_vocab - min_vocab
    if size <= 0:
        raise ValueError("min_vocab must be below max_vocab")
    fits = F.when(F.col("n") <= size, F.col("n")).otherwise(F.raise_error(F.lit(f"a graph has more nodes than the {size} ids")).cast("int"))
    tokens = F.sequence(F.lit(min_vocab), F.lit(max_vocab - 1))
    if shuffle:
        drawn = F.transform(tokens, lambda t: F.struct(draw(seed, F.lit("node"), "inst", t).alias("d"), t.alias("t")))
        tokens = F.transform(F.array_sort(drawn), lambda x: x["t"])
    return nodes.select("inst", F.slice(tokens, F.lit(1), fits).alias("tokens"))


def node_order(edges: DataFrame) -> DataFrame:
    """(inst, node, place): nodes by first appearance in the edge list, an edge's u before its v."""
    seen = edges.select("inst", F.explode(F.array(F.struct(F.col("u").alias("node"), (2 * F.col("edge_idx")).alias("at")), F.struct(F.col("v").alias("node"), (2 * F.col("edge_idx") + 1).alias("at")))).alias("s"))
    first = seen.groupBy("inst", "s.node").agg(F.min("s.at").alias("at"))
    return first.select("inst", "node", (F.row_number().over(Window.partitionBy("inst").orderBy("at")) - 1).cast("int").alias("place"))


def duplicated(edges: DataFrame) -> DataFrame:
    """All edges, then all again the other way round."""
    size = F.count("*").over(Window.partitionBy("inst"))
    whole = edges.withColumn("size", size)
    told = F.array(F.struct("edge_idx", "u", "v"), F.struct((F.col("edge_idx") + F.col("size")).cast("int").alias("edge_idx"), F.col("v").alias("u"), F.col("u").alias("v")))
    return whole.select("inst", F.explode(told).alias("e")).select("inst", "e.edge_idx", "e.u", "e.v")
