"""All-pairs distances of many graphs at once, unit weights. Unreachable pairs have no row.

Three plans for one result. ``tensor`` (the default) gathers each graph into one row and runs all graphs of an Arrow batch
level by level as one boolean tensor; ``array`` does the same search with higher-order functions only, inside the JVM;
``frontier`` joins level by level and never holds a graph in one task, for graphs too large for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.functions.written import cut, delete
from graphloom.sources.tables import arcs, nodes

_SCHEMA = "inst long, src int, dst int, d int"
#: Cells of a tensor; graphs of a batch are taken in parts of so many.
_CELLS = 1 << 22
#: Nodes of a piece of a graph, for the search that joins.
_PIECE = 1 << 10


def distances(edges: DataFrame, directed: bool = False, plan: str = "tensor", every_node: DataFrame | None = None) -> DataFrame:
    """(inst, src, dst, d) for all pairs that a path joins, d = 0 for a node and itself.

    every_node: (inst, n), if graphs have nodes 0 to n - 1 some of which have no edge.
    """
    if plan not in ("tensor", "array", "frontier"):
        raise ValueError(f"no such plan: {plan}")
    own = {"tensor": _tensor, "array": _array, "frontier": _frontier}[plan](edges, directed)
    if every_node is None:
        return own
    loops = every_node.select("inst", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("src"))
    lone = loops.join(nodes(edges).withColumnRenamed("node", "src"), ["inst", "src"], "left_anti")
    return own.unionByName(lone.select("inst", "src", F.col("src").alias("dst"), F.lit(0).alias("d")))


def told_graphs(edges: DataFrame) -> DataFrame:
    """(inst, us, vs): each graph as one row, edges in their order."""
    whole = edges.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("edge_idx", "u", "v"))).alias("e"))
    return whole.select("inst", F.col("e.u").alias("us"), F.col("e.v").alias("vs"))


def _search(adjacent: np.ndarray) -> np.ndarray:
    """Distances by graph, -1 where none, from adjacency by graph."""
    b, n, _ = adjacent.shape
    far = np.full((b, n, n), -1, np.int32)
    front = np.broadcast_to(np.eye(n, dtype=bool), (b, n, n)).copy()
    seen = front.copy()
    step = adjacent.astype(np.float32)
    d = 0
    while front.any():
        far[front] = d
        front = (front.astype(np.float32) @ step > 0) & ~seen
        seen |= front
        d += 1
    return far


def searched(batches: Iterator[pa.RecordBatch], directed: bool, cells: int = _CELLS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, far) for the told graphs (inst, us, vs, ...) of each batch, some at a time: far[k, a, b] is the distance in
    the graph of row rows[k], -1 where no path is or a node has no edge."""
    for batch in batches:
        us, vs = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())]).astype(np.int64)
        size = np.maximum(np.maximum.reduceat(us, at[:-1]), np.maximum.reduceat(vs, at[:-1])).astype(np.int64) + 1 if len(us) else np.zeros(0, np.int64)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * int(size[order[j]]) ** 2 <= cells:
                j += 1
            some = order[i:j]
            n = int(size[some[-1]])
            adjacent = np.zeros((len(some), n, n), bool)
            long = (at[1:] - at[:-1])[some]
            k = np.repeat(np.arange(len(some)), long)
            edge = np.repeat(at[some] - np.cumsum(long) + long, long) + np.arange(len(k))
            u, v = us[edge], vs[edge]
            adjacent[k, u, v] = True
            if not directed:
                adjacent[k, v, u] = True
            present = np.zeros((len(some), n), bool)
            present[k, u] = present[k, v] = True
            far = _search(adjacent)
            far[~present] = -1
            yield batch, some, far
            i = j


def _tensor_batches(batches: Iterator[pa.RecordBatch], directed: bool) -> Iterator[pa.RecordBatch]:
    for batch, some, far in searched(batches, directed):
        k, a, b = np.nonzero(far >= 0)
        yield pa.record_batch([pa.array(batch.column(0).to_numpy()[some[k]]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(far[k, a, b])], names=["inst", "src", "dst", "d"])


def _tensor(edges: DataFrame, directed: bool) -> DataFrame:
    ship(edges.sparkSession)
    return told_graphs(edges).mapInArrow(lambda it: _tensor_batches(it, directed), _SCHEMA)


def _array(edges: DataFrame, directed: bool) -> DataFrame:
    """One row per (inst, src); the state of an ``aggregate`` over levels is what was seen and the front."""
    lists = arcs(edges, directed).groupBy("inst", "u").agg(F.collect_set("v").alias("vs"))
    every = nodes(edges).groupBy("inst").agg(F.collect_list("node").alias("nodes"))
    graphs = lists.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("u", "vs"))).alias("next")).join(every, "inst")
    each = graphs.select("inst", "next", F.size("nodes").alias("n"), F.explode("nodes").alias("src"))
    found = F.expr(
        """
        aggregate(
          sequence(1, n),
          named_struct('seen', array(named_struct('dst', src, 'd', 0)), 'ids', array(src), 'front', array(src)),
          (s, level) -> if(size(s.front) = 0, s,
            aggregate(
              array(array_except(array_distinct(flatten(transform(s.front, x -> coalesce(next[x], cast(array() as array<int>))))), s.ids)), s,
              (t, new) -> named_struct(
                'seen', concat(t.seen, transform(new, x -> named_struct('dst', x, 'd', level))),
                'ids', concat(t.ids, new), 'front', new))),
          s -> s.seen)
        """
    )
    return each.select("inst", "src", F.explode(found).alias("f")).select("inst", "src", "f.dst", "f.d")


def _frontier(edges: DataFrame, directed: bool) -> DataFrame:
    """Level by level, _PIECE nodes and 64 sources a row: a row (inst, piece, block, nodes, seen, front) has a bit for each
    source of the block that has reached a node, up to now and in this level. It meets the arcs that leave its piece, by
    the piece they lead to, and what they carry meets the rows of those pieces."""
    ship(edges.sparkSession)
    spark = edges.sparkSession
    piece = lambda c: F.floor(F.col(c) / _PIECE).cast("int")
    steps = arcs(edges, directed).groupBy("inst", piece("u").alias("piece"), piece("v").alias("to")).agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    steps = cut(steps, "arcs")
    own = nodes(edges).groupBy("inst", piece("node").alias("piece"), F.floor(F.col("node") / 64).cast("int").alias("block")).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    bits = F.transform("nodes", lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x % 64))
    at = cut(own.select("inst", "piece", "block", "nodes", bits.alias("seen"), bits.alias("front")))
    found, d = None, 0
    while True:
        rows = at.filter(F.exists("front", lambda x: x != 0)).select("inst", "block", "nodes", "front")
        level = cut(rows.withColumn("d", F.lit(d)), "level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        front = at.filter(F.exists("front", lambda x: x != 0)).select("inst", "piece", "block", "nodes", "front")
        sent = front.join(steps, ["inst", "piece"]).select("inst", "to", "block", "nodes", "front", "us", "vs").mapInArrow(_carry, "inst long, piece int, block int, nodes array<int>, seen array<long>, front array<long>")
        both = at.select("inst", "piece", "block", "nodes", "seen", F.expr("cast(array() as array<long>)").alias("front")).unionByName(sent)
        met = both.groupBy("inst", "piece", "block").agg(*(F.flatten(F.collect_list(x)).alias(c) for c, x in (
            ("nodes", F.when(F.size("front") == 0, F.col("nodes"))), ("seen", F.when(F.size("front") == 0, F.col("seen"))), ("to", F.when(F.size("front") > 0, F.col("nodes"))), ("front", F.when(F.size("front") > 0, F.col("front"))))))
        new = cut(met.mapInArrow(_merge, at.schema))
        delete(spark, at.inputFiles()[0].rpartition("/")[0])
        at, d = new, d + 1
        spark.sparkContext._jvm.System.gc()  # what was shuffled for levels gone by goes only with its garbage
    return found.mapInArrow(_pairs, _SCHEMA) if found is not None else spark.createDataFrame([], _SCHEMA)


def _flat(batch: pa.RecordBatch, *columns: int) -> tuple[np.ndarray, ...]:
    """The row of each entry of the first of some list columns of equal lengths, and their entries."""
    row = np.repeat(np.arange(len(batch), dtype=np.int64), batch.column(columns[0]).value_lengths().to_numpy())
    return row, *(batch.column(i).flatten().to_numpy() for i in columns)


def _united(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with all its bits."""
    order = np.argsort(key, kind="stable")
    key, bits = key[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits


def _lists(row: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x)) for x in columns]


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, node, front = _flat(batch, 3, 4)
        at, us, vs = _flat(batch, 5, 6)
        # nodes are in order by row
        have, ask = row << 32 | node, at << 32 | us
        i = np.minimum(np.searchsorted(have, ask), max(0, len(have) - 1))
        hit = have[i] == ask if len(have) else np.zeros(len(ask), bool)
        key, bits = _united((at << 32 | vs)[hit], front[i[hit]])
        bits, key = bits[bits != 0], key[bits != 0]
        some, place = np.unique(key >> 32, return_inverse=True)
        lists = _lists(place, len(some), (key & 0xFFFFFFFF).astype(np.int32), bits, bits)
        part = batch.select([0, 1, 2]).take(pa.array(some))
        yield pa.record_batch([*part.columns, *lists], names=["inst", "piece", "block", "nodes", "seen", "front"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, node, seen = _flat(batch, 3, 4)
        at, to, front = _flat(batch, 5, 6)
        key = np.concatenate([row << 32 | node, at << 32 | to])
        none = np.zeros(len(node), np.int64)
        old = _united(key, np.concatenate([seen, np.zeros(len(to), np.int64)]))
        new = _united(key, np.concatenate([none, front]))[1] & ~old[1]
        lists = _lists(old[0] >> 32, len(batch), (old[0] & 0xFFFFFFFF).astype(np.int32), old[1] | new, new)
        yield pa.record_batch([*batch.columns[:3], *lists], names=["inst", "piece", "block", "nodes", "seen", "front"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 1024):
            batch = whole.slice(i, 1024)
            row, node, front = _flat(batch, 2, 3)
            inst, block, d = (batch.column(c).to_numpy() for c in (0, 1, 4))
            k, bit = np.nonzero(np.unpackbits(front.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            r = row[k]
            yield pa.record_batch([pa.array(inst[r]), pa.array((block[r] * 64 + bit).astype(np.int32)), pa.array(node[k]), pa.array(d[r])], names=["inst", "src", "dst", "d"])


def asked_distances(edges: DataFrame, pairs: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, src, dst, d) for those of pairs(inst, src, dst) that a path joins, each once: the rows that
    :func:`distances` has for them, in one pass over told graphs, which may be given instead of edges. Pairs and graphs meet as a row an instance."""
    ship(edges.sparkSession)
    asked = pairs.groupBy("inst").agg(F.collect_set(F.struct("src", "dst")).alias("p"))
    told = edges if "us" in edges.columns else told_graphs(edges)
    rows = told.join(asked.select("inst", F.col("p.src").cast("array<int>").alias("src"), F.col("p.dst").cast("array<int>").alias("dst")), "inst")
    return rows.mapInArrow(lambda it: _asked_batches(it, directed), _SCHEMA)


def _asked_batches(batches: Iterator[pa.RecordBatch], directed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        low = int(min(us.min(initial=0x7FFFFFFF), vs.min(initial=0x7FFFFFFF)))  # ids may begin far above 0
        at = pa.array(np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())]).astype(np.int32))
        told = pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(at, pa.array(x - np.int32(low))) for x in (us, vs))], names=["inst", "us", "vs"])
        for _, some, far in searched(iter([told]), directed):
            part = batch.take(pa.array(some))
            src, dst = (part.column(i).flatten().to_numpy().astype(np.int64) - low for i in (3, 4))
            k = np.repeat(np.arange(len(some)), part.column(3).value_lengths().to_numpy())
            # what is no node of the graph has no distance
            known = (src >= 0) & (dst >= 0) & (src < far.shape[1]) & (dst < far.shape[1])
            k, src, dst = k[known], src[known], dst[known]
            d = far[k, src, dst]
            k, src, dst, d = (x[d >= 0] for x in (k, src, dst, d))
            yield pa.record_batch([pa.array(part.column(0).to_numpy()[k]), pa.array((src + low).astype(np.int32)), pa.array((dst + low).astype(np.int32)), pa.array(d)], names=["inst", "src", "dst", "d"])


def told_neighbours(told: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, near) of told graphs (inst, us, vs): a map from each node that has arcs to its neighbours."""
    ship(told.sparkSession)
    return told.select("inst", "us", "vs").mapInArrow(lambda it: _near_batches(it, directed), "inst long, near map<int,array<int>>")


def _near_batches(batches: Iterator[pa.RecordBatch], directed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        k = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy())
        if not directed:
            k, us, vs = np.concatenate([k, k]), np.concatenate([us, vs]), np.concatenate([vs, us])
        order = np.lexsort((vs, us, k))
        k, us, vs = k[order], us[order], vs[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (us[1:] != us[:-1]) | (vs[1:] != vs[:-1])
        k, us, vs = k[new], us[new], vs[new]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (us[1:] != us[:-1])
        heads = np.flatnonzero(first)
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(k)).astype(np.int32)), pa.array(vs))
        maps = pa.MapArray.from_arrays(pa.array(np.searchsorted(k[heads], np.arange(len(batch) + 1)).astype(np.int32)), pa.array(us[heads]), lists)
        yield pa.record_batch([batch.column(0), maps], names=["inst", "near"])


def densified(dist: DataFrame, every_node: DataFrame, missing: int = -1) -> DataFrame:
    """A row for every pair of nodes(inst, node), ``missing`` where no path is."""
    pairs = every_node.select("inst", F.col("node").alias("src")).join(every_node.select("inst", F.col("node").alias("dst")), "inst")
    return pairs.join(dist, ["inst", "src", "dst"], "left").select("inst", "src", "dst", F.coalesce("d", F.lit(missing)).cast("int").alias("d"))


def causal_ground_truth(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(inst, row_idx, node, d): distances from the first node of edge t when only edges up to t have been told.

    d(t) is the least d for which some path of d edges uses no edge behind t: a minimax program over path lengths, all
    sources and all t at once. Unreachable nodes have no row; neither has an edge's own time before it is told.
    """
    ship(edges.sparkSession)
    return told_graphs(edges).mapInArrow(lambda it: _causal_batches(it, directed), "inst long, row_idx int, node int, d int")


def _causal_batches(batches: Iterator[pa.RecordBatch], directed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for inst, us, vs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            u, v = us.values.to_numpy(), vs.values.to_numpy()
            e, n = len(u), int(max(u.max(), v.max())) + 1
            late = np.full((n, n), e, np.int64)  # the time of an arc, e for none
            for t in range(e - 1, -1, -1):
                late[u[t], v[t]] = min(late[u[t], v[t]], t)
                if not directed:
                    late[v[t], u[t]] = min(late[v[t], u[t]], t)
            best = np.full((n, n), e, np.int64)
            np.fill_diagonal(best, -1)
            when = [best]  # when[d][a, b]: the least greatest time of an edge on a path of up to d edges
            while True:
                new = np.minimum(when[-1], np.maximum(when[-1][:, :, None], late[None, :, :]).min(axis=1))
                if (new == when[-1]).all():
                    break
                when.append(new)
            by_length = np.stack(when)[:, u, :]  # d, t, node
            there = by_length <= np.arange(e)[None, :, None]
            d = there.argmax(axis=0)
            t, node = np.nonzero(there.any(axis=0))
            yield pa.record_batch([pa.array(np.full(len(t), inst, np.int64)), pa.array(t.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(d[t, node].astype(np.int32))], names=["inst", "row_idx", "node", "d"])


def edge_ground_truth(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(inst, row_idx, node, d): for edge t the distances from its first node in the whole graph."""
    first = edges.select("inst", F.col("edge_idx").alias("row_idx"), F.col("u").alias("src"))
    return first.join(dist, ["inst", "src"]).select("inst", "row_idx", F.col("dst").alias("node"), "d")


def node_ground_truth(order: DataFrame, dist: DataFrame, direct: bool = False) -> DataFrame:
    """(inst, row_idx, col_idx, d): rows in node order; columns in node order too if ``direct``, else by node."""
    rows = order.select("inst", F.col("node").alias("src"), F.col("place").alias("row_idx"))
    out = dist.join(rows, ["inst", "src"])
    if not direct:
        return out.select("inst", "row_idx", F.col("dst").alias("col_idx"), "d")
    return out.join(order.select("inst", F.col("node").alias("dst"), F.col("place").alias("col_idx")), ["inst", "dst"]).select("inst", "row_idx", "col_idx", "d")


def gathered_truth(truth: DataFrame, key: str = "row_idx", column: str = "node") -> DataFrame:
    """(inst, key, indices, distances): the reachable entries of each row, in order of column."""
    own = truth.groupBy("inst", key).agg(F.array_sort(F.collect_list(F.struct(column, "d"))).alias("g"))
    return own.select("inst", key, F.col(f"g.{column}").alias("indices"), F.col("g.d").alias("distances"))


def packaged_distances(dist: DataFrame, node_map: DataFrame, cutoff: int = 100_000) -> DataFrame:
    """(inst, src_tok, dst_tok, d): distances by vocabulary id, those from ``cutoff`` on left out as unreachable."""
    src = node_map.select("inst", F.col("node").alias("src"), F.col("token").alias("src_tok"))
    dst = node_map.select("inst", F.col("node").alias("dst"), F.col("token").alias("dst_tok"))
    return dist.filter(F.col("d") < cutoff).join(src, ["inst", "src"]).join(dst, ["inst", "dst"]).select("inst", "src_tok", "dst_tok", "d")


def distance_tensor(packaged: DataFrame, vocab_size: int, pad: int = -1) -> DataFrame:
    """(inst, distances): a dense array of arrays by vocabulary id, for the sink."""
    own = packaged.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct((F.col("src_tok") * vocab_size + F.col("dst_tok")).alias("k"), "d"))).alias("m"))
    ids = F.sequence(F.lit(0), F.lit(vocab_size - 1))
    return own.select("inst", F.transform(ids, lambda a: F.transform(ids, lambda b: F.coalesce(F.try_element_at("m", a * vocab_size + b), F.lit(pad)))).alias("distances"))
