"""Measures of graphs: components, neighbours, ranks, histograms, centres, and scores of distance rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.shipping import ship
from graphloom.operators.distances import searched, told_graphs
from graphloom.sources.tables import arcs

#: Cells of a tensor of distances whose rows are compared, and rows of a batch of scores.
_CELLS, _ROWS = 1 << 19, 1 << 16


def components(dist: DataFrame) -> DataFrame:
    """(inst, node, component) of undirected graphs: the smallest node that each reaches."""
    return dist.groupBy("inst", F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def children(edges: DataFrame) -> DataFrame:
    """(inst, node, child) of directed edges."""
    return edges.select("inst", F.col("u").alias("node"), F.col("v").alias("child")).distinct()


def parents(edges: DataFrame) -> DataFrame:
    """(inst, node, parent) of directed edges."""
    return edges.select("inst", F.col("v").alias("node"), F.col("u").alias("parent")).distinct()


def descendants(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(inst, node, descendant): what a walk of one edge or more reaches; the node itself only on a cycle."""
    first = children(edges).withColumnRenamed("child", "src")
    return first.join(dist, ["inst", "src"]).select("inst", "node", F.col("dst").alias("descendant")).distinct()


def node_ranks(dist: DataFrame) -> DataFrame:
    """(inst, node, rank, ties): for each node the nodes at each distance, ascending."""
    return dist.groupBy("inst", F.col("src").alias("node"), F.col("d").alias("rank")).agg(F.array_sort(F.collect_list("dst")).alias("ties"))


def rank_table(ranks: DataFrame) -> DataFrame:
    """(inst, node, ranks): all ties of a node as one array by distance, for the sink."""
    return ranks.groupBy("inst", "node").agg(F.array_sort(F.collect_list(F.struct("rank", "ties"))).alias("r")).select("inst", "node", F.col("r.ties").alias("ranks"))


def path_length_histogram(dist: DataFrame) -> DataFrame:
    """(inst, d, n): ordered pairs at each distance above 0."""
    return dist.filter("d > 0").groupBy("inst", "d").agg(F.count("*").alias("n"))


def mean_histogram(histogram: DataFrame) -> DataFrame:
    """(d, graphs, mean): over the graphs that have pairs at distance d."""
    return histogram.groupBy("d").agg(F.count("*").alias("graphs"), F.avg("n").alias("mean"))


def queries_of(nodes: DataFrame, low: int = 2, high: int = -1, seed: int = 0) -> DataFrame:
    """(inst, node): drawn nodes of each instance to be the query of centre and centroid, low to high of them."""
    from graphloom.functions.draws import between, draw

    size = F.count("*").over(Window.partitionBy("inst"))
    most = size if high < 0 else F.least(size, F.lit(high))
    place = F.row_number().over(Window.partitionBy("inst").orderBy(draw(seed, F.lit("query"), "inst", "node"), "node"))
    chosen = nodes.withColumn("most", most).withColumn("place", place).withColumn("want", between(F.least(F.lit(low), F.col("most")), F.col("most"), seed, F.lit("queries"), "inst"))
    return chosen.filter("place <= want").select("inst", "node")


def center(dist: DataFrame, query: DataFrame, centroid: bool = False) -> DataFrame:
    """(inst, node, score): all nodes whose greatest distance (or sum of distances) to the query nodes is least, among
    those that reach them all."""
    need = query.groupBy("inst").agg(F.count("*").alias("need"))
    met = dist.select("inst", F.col("src").alias("v"), F.col("dst").alias("node"), "d").join(query, ["inst", "node"])
    score = F.sum("d") if centroid else F.max("d")
    own = met.groupBy("inst", "v").agg(score.cast("long").alias("score"), F.count("*").alias("have")).join(need, "inst").filter("have = need")
    best = own.withColumn("r", F.rank().over(Window.partitionBy("inst").orderBy("score"))).filter("r = 1")
    return best.select("inst", F.col("v").alias("node"), "score")


def row_scores(dist: DataFrame) -> DataFrame:
    """(inst, a, b, d, euclidean, manhattan, dot, cosine): the distance rows of two nodes compared, entry by entry over
    the nodes that both reach."""
    x = dist.select("inst", F.col("src").alias("a"), F.col("dst").alias("k"), F.col("d").alias("x"))
    y = dist.select("inst", F.col("src").alias("b"), F.col("dst").alias("k"), F.col("d").alias("y"))
    met = x.join(y, ["inst", "k"]).filter("a < b")
    own = met.groupBy("inst", "a", "b").agg(
        F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("euclidean"), F.sum(F.abs(F.col("x") - F.col("y"))).cast("long").alias("manhattan"),
        F.sum(F.col("x") * F.col("y")).cast("long").alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    cosine = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("dot") / F.sqrt(F.col("xx").cast("double") * F.col("yy")))
    own = own.select("inst", "a", "b", "euclidean", "manhattan", "dot", cosine.alias("cosine"))
    return own.join(dist.select("inst", F.col("src").alias("a"), F.col("dst").alias("b"), "d"), ["inst", "a", "b"])


def told_scores(edges: DataFrame, directed: bool = False) -> DataFrame:
    """What :func:`row_scores` gives for the distances of ``edges``, in one pass over graphs that each fit one row: no
    distances are joined."""
    ship(edges.sparkSession)
    return told_graphs(edges).mapInArrow(lambda it: _score_batches(it, directed), "inst long, a int, b int, d int, euclidean double, manhattan long, dot long, cosine double")


def _score_batches(batches: Iterator[pa.RecordBatch], directed: bool) -> Iterator[pa.RecordBatch]:
    for batch, some, far in searched(batches, directed, _CELLS):
        inst, n = batch.column(0).to_numpy()[some], far.shape[1]
        met = far >= 0
        # sums of n squares below n * n: exact in floats of 24 bits up to 256 nodes, in doubles far beyond
        kind = np.float32 if n <= 256 else np.float64
        x, m = np.where(met, far, 0).astype(kind), met.astype(kind)
        turned, squares = x.transpose(0, 2, 1), x * x
        k, a, b = np.nonzero(met & np.triu(np.ones((n, n), bool), 1))
        dot = (x @ turned)[k, a, b].astype(np.int64)
        of_a, of_b = (squares @ m.transpose(0, 2, 1))[k, a, b].astype(np.int64), (m @ squares.transpose(0, 2, 1))[k, a, b].astype(np.int64)
        manhattan = np.zeros((len(some), n, n), np.int32)
        for c in range(n):
            both = met[:, :, c, None] & met[:, None, :, c]
            manhattan += np.where(both, np.abs(far[:, :, c, None] - far[:, None, :, c]), 0)
        norm = (of_a > 0) & (of_b > 0)
        cosine = dot / np.sqrt(np.where(norm, of_a.astype(np.float64) * of_b, 1.0))
        out = pa.record_batch(
            [pa.array(inst[k]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(far[k, a, b]), pa.array(np.sqrt((of_a + of_b - 2 * dot).astype(np.float64))), pa.array(manhattan[k, a, b].astype(np.int64)), pa.array(dot), pa.array(cosine, mask=~norm)],
            names=["inst", "a", "b", "d", "euclidean", "manhattan", "dot", "cosine"],
        )
        yield from (out.slice(i, _ROWS) for i in range(0, len(out), _ROWS))


def order_violations(scores: DataFrame, measure: str = "euclidean") -> DataFrame:
    """(inst, a, violations): pairs of partners of a whose order by ``measure`` contradicts their order by distance."""
    both = scores.select("inst", "a", "b", "d", F.col(measure).alias("s"))
    two = both.join(both.select("inst", "a", F.col("b").alias("b2"), F.col("d").alias("d2"), F.col("s").alias("s2")), ["inst", "a"])
    return two.filter("d < d2").groupBy("inst", "a").agg(F.sum(F.when(F.col("s") > F.col("s2"), 1).otherwise(0)).alias("violations"))


def degrees(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, node, degree): out-degree if directed."""
    return arcs(edges, directed).groupBy("inst", F.col("u").alias("node")).agg(F.countDistinct("v").alias("degree"))


def profile(instances: DataFrame) -> DataFrame:
    """Numbers of instances, mean nodes and edges by (graph_type, task_type), with subtotals, from
    instances(graph_type, task_type, n, e)."""
    return instances.rollup("graph_type", "task_type").agg(F.count("*").alias("instances"), F.avg("n").alias("nodes"), F.avg("e").alias("edges"))


def profile_cube(instances: DataFrame) -> DataFrame:
    """The same with every subtotal, and with approximate numbers of different sizes for tables too large to count exactly."""
    return instances.cube("graph_type", "task_type").agg(F.count("*").alias("instances"), F.approx_count_distinct("n").alias("sizes"), F.avg("e").alias("edges"))


def left_over(told: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``told`` that ``known`` doesn't account for, each as often as it is left over; null equals null."""
    return told.exceptAll(known.select(told.columns))


def pretty_distances(dense: DataFrame) -> DataFrame:
    """(inst, src, text): each row of a dense distance table (inst, src, dst, d) as text, for reading."""
    row = F.array_sort(F.collect_list(F.struct("dst", "d")))
    return dense.groupBy("inst", "src").agg(F.array_join(F.transform(row, lambda x: F.lpad(x["d"].cast("string"), 4, " ")), "").alias("text"))


def pretty_ranks(ranks: DataFrame) -> DataFrame:
    """(inst, node, text): a node's neighbours by distance, as ``1: 4 7 | 2: 9``."""
    own = F.array_sort(F.collect_list(F.struct("rank", "ties")))
    line = lambda x: F.concat(x["rank"].cast("string"), F.lit(": "), F.array_join(F.transform(x["ties"], lambda t: t.cast("string")), " "))
    return ranks.groupBy("inst", "node").agg(F.array_join(F.transform(own, line), " | ").alias("text"))


def usable(packaged: DataFrame, max_length: int | None = None) -> DataFrame:
    """Instances that a trainer can take: with tokens, with a target, and no longer than ``max_length``."""
    out = packaged.filter((F.size("src_tokens") > 0) & (F.size("prev_output_tokens") > 0))
    return out.filter(F.col("src_lengths") <= max_length) if max_length else out
