"""Breadth-first and depth-first searches as traces, and traces as tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import BfsArgs
from graphloom.functions.draws import host_draw
from graphloom.functions.kernels import map_instances
from graphloom.functions.vocab import Vocab
from graphloom.operators.distances import told_graphs


def _neighbours(row: dict, directed: bool) -> dict[int, list[int]]:
    """Each node's neighbours in the order in which the edge list first names them."""
    place: dict[int, int] = {}
    near: dict[int, set[int]] = {}
    for u, v in zip(row["us"], row["vs"], strict=True):
        place.setdefault(u, len(place))
        place.setdefault(v, len(place))
        near.setdefault(u, set()).add(v)
        if not directed:
            near.setdefault(v, set()).add(u)
    return {u: sorted(vs, key=place.__getitem__) for u, vs in near.items()}


def bfs_traces(edges: DataFrame, ends: DataFrame, args: BfsArgs, directed: bool = False) -> DataFrame:
    """(inst, found, path, steps): the search from start to end, level by level, in edges or told graphs (inst, us, vs).

    steps: (level, place, node, queue, nbrs) for each node looked at: queue is what of its level is still to be looked
    at, itself first; nbrs its neighbours not met before. The level in which the end is met is the last; it is
    looked at whole, or up to the node that meets the end with ``stop_once_found``. path leads from start to end along
    first meetings. If the end can't be reached (or is the start), found is false and the path empty.
    """

    def kernel(row: dict) -> list[dict]:
        near = _neighbours(row, directed)
        start, end = row["start"], row["end"]
        parent = {start: None}
        level, queue, steps = 0, [start], []
        found = False
        while queue and not found:
            following: list[int] = []
            for place, node in enumerate(queue):
                fresh = [x for x in near.get(node, ()) if x not in parent]
                parent.update(dict.fromkeys(fresh, node))
                following += fresh
                steps.append({"level": level, "place": place, "node": node, "queue": queue[place:], "nbrs": fresh})
                found = found or end in fresh
                if found and args.stop_once_found:
                    break
            level, queue = level + 1, following
        path, at = [], end if found else None
        while at is not None:
            path.append(at)
            at = parent[at]
        return [{"inst": row["inst"], "found": found, "path": path[::-1], "steps": steps}]

    told = edges if "us" in edges.columns else told_graphs(edges)
    rows = told.join(ends.select("inst", "start", "end"), "inst")
    return map_instances(rows, kernel, "inst long, found boolean, path array<int>, steps array<struct<level:int,place:int,node:int,queue:array<int>,nbrs:array<int>>>")


def bfs_tokens(traces: DataFrame, tokens: DataFrame | None, vocab: Vocab, args: BfsArgs) -> DataFrame:
    """(inst, scratchpad): ``# D0 [{ queue }] node [ nbrs ] [{ nbrs again }] ... D1 ...`` of each search that found its
    end. With ``reverse_adjacency`` queue and neighbours are written backwards, and the repeat runs the other way. Without ``tokens``, nodes go by their ids already."""
    lit = vocab.lit
    of = (lambda x: x) if tokens is None else (lambda x: F.get("tokens", x))
    depths = F.array(*(F.lit(i) for i in vocab.depth_ids())) if args.unique_depth_markers else None

    def mark(level: Column) -> Column:
        if depths is None:
            return lit(vocab.depth_symbol)
        return F.coalesce(F.get(depths, level), F.raise_error(F.lit("the vocabulary has too few depth marks")).cast("int"))

    def told(s: Column) -> Column:
        turn = F.reverse if args.reverse_adjacency else lambda x: x
        parts = [F.when(s["place"] == 0, F.array(mark(s["level"]))).otherwise(F.expr("cast(array() as array<int>)"))]
        if args.include_queue:
            parts += [F.array(lit("{")), F.transform(turn(s["queue"]), of), F.array(lit("}"))]
        nbrs = turn(F.transform(s["nbrs"], of))
        parts += [F.array(of(s["node"]), lit("[")), nbrs, F.array(lit("]"))]
        if args.duplicate_adjacency:
            parts += [F.array(lit("{")), F.reverse(nbrs), F.array(lit("}"))]
        return F.concat(*parts)

    rows = traces.filter("found")
    rows = rows if tokens is None else rows.join(tokens, "inst")
    return rows.select("inst", F.concat(F.array(lit("#")), F.flatten(F.transform("steps", told))).alias("scratchpad"))


def bfs_levels(dist: DataFrame, ends: DataFrame) -> DataFrame:
    """(inst, level, node) for all nodes that a whole search from the start meets."""
    return dist.join(ends.select("inst", F.col("start").alias("src")), ["inst", "src"]).select("inst", F.col("d").alias("level"), F.col("dst").alias("node"))


def dfs_traces(edges: DataFrame, ends: DataFrame, tokens: DataFrame, sort_adjacency: bool = False, directed: bool = False, seed: int = 0) -> DataFrame:
    """(inst, found, path, steps): a depth-first search; steps (node, parent, depth, others) in order, others being the
    node and those of its siblings still to come. Neighbours go by token if sorted, else in a drawn order. A node that is
    met again on a way back is stepped into again, as its parent had listed it."""

    def kernel(row: dict) -> list[dict]:
        near = _neighbours(row, directed)
        token = row["tokens"]
        key = (lambda x: token[x]) if sort_adjacency else (lambda x: (host_draw(seed, "dfs", row["inst"], x), x))
        start, end = row["start"], row["end"]
        seen, steps, found = {start}, [], False

        def listed(node: int) -> list[int]:
            return [x for x in sorted(near.get(node, ()), key=key) if x not in seen]

        stack = [(start, listed(start), 0)] if start != end else []
        while stack and not found:
            node, todo, i = stack.pop()
            if i < len(todo):
                stack.append((node, todo, i + 1))
                child = todo[i]
                steps.append({"node": child, "parent": node, "depth": len(stack) - 1, "others": todo[i:]})
                seen.add(child)
                found = child == end
                stack.append((child, listed(child), 0))
        path = [end] if found else []
        for s in reversed(steps if found else []):
            if s["node"] == path[-1]:
                path.append(s["parent"])
        return [{"inst": row["inst"], "found": found, "path": path[::-1], "steps": steps}]

    rows = told_graphs(edges).join(ends.select("inst", "start", "end"), "inst").join(tokens, "inst")
    return map_instances(rows, kernel, "inst long, found boolean, path array<int>, steps array<struct<node:int,parent:int,depth:int,others:array<int>>>")


def dfs_tokens(traces: DataFrame, tokens: DataFrame, vocab: Vocab, unique_depth_markers: bool = True) -> DataFrame:
    """(inst, scratchpad, targets): ``# D0 parent node D1 parent node ...``; the labels of a node are it and its siblings
    still to come."""
    of = lambda x: F.get("tokens", x)
    depths = F.array(*(F.lit(i) for i in vocab.depth_ids()))

    def mark(s: Column) -> Column:
        if not unique_depth_markers:
            return vocab.lit(vocab.depth_symbol)
        return F.coalesce(F.get(depths, s["depth"]), F.raise_error(F.lit("the vocabulary has too few depth marks")).cast("int"))

    rows = traces.filter("found").join(tokens, "inst")
    told = F.flatten(F.transform("steps", lambda s: F.array(mark(s), of(s["parent"]), of(s["node"]))))
    labels = F.flatten(F.transform("steps", lambda s: F.array(F.array(mark(s)), F.array(of(s["parent"])), F.transform(s["others"], of))))
    head = vocab.lit("#")
    return rows.select("inst", F.concat(F.array(head), told).alias("scratchpad"), F.concat(F.array(F.array(head)), labels).alias("targets"))


def depth_spans(generated: DataFrame, vocab: Vocab) -> DataFrame:
    """(inst, depth, begin, end) of generated(inst, tokens): from each expected depth mark to the next one."""
    marks = F.array(*(F.lit(i) for i in vocab.depth_ids()))
    plain = F.lit(vocab.ids.get(vocab.depth_symbol, -1))
    state = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("at"))

    def step(s: Column, i: Column) -> Column:
        t = F.get("tokens", i)
        hit = (t == plain) | (t == F.coalesce(F.get(marks, s["depth"]), F.lit(-1)))
        return F.when(hit, F.struct((s["depth"] + 1).alias("depth"), F.concat(s["at"], F.array(i)).alias("at"))).otherwise(s)

    found = F.aggregate(F.sequence(F.lit(0), F.size("tokens") - 1), state, step, lambda s: s["at"])
    rows = generated.filter(F.size("tokens") > 0).withColumn("at", found)
    each = rows.select("inst", "at", F.size("tokens").alias("n"), F.posexplode("at").alias("depth", "begin"))
    return each.select("inst", "depth", "begin", F.coalesce(F.get("at", F.col("depth") + 1), F.col("n")).alias("end"))
