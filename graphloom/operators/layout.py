"""Graphs and instances as token rows with positions, targets, and the place and length of every part.

Token rows are arrays of equal width: 2 if an edge is one row of both its nodes, else 1. Parts that are narrower repeat
their token over the width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import PosArgs, TokenArgs
from graphloom.functions.vocab import Vocab
from graphloom.operators.order import duplicated

_ROWS = "array<array<int>>"


def _none(kind: str = _ROWS) -> Column:
    return F.expr(f"cast(array() as {kind})")


def graph_tokens(edges: DataFrame, order: DataFrame, tokens: DataFrame, vocab: Vocab, positions: dict[str, int], args: TokenArgs, pos: PosArgs) -> DataFrame:
    """(inst, graph, graph_pos, edge_rows, node_rows): edges as rows (u, v), or as three rows u, v and ``|``; then with
    ``include_nodes`` the nodes in node order. order: (inst, node, place); tokens: (inst, tokens) by node."""
    told = duplicated(edges) if args.duplicate_edges else edges
    own = told.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("edge_idx", "u", "v"))).alias("e")).join(tokens, "inst")
    if args.include_nodes:
        own = own.join(order.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("o")), "inst").withColumn("nodes", F.col("o.node"))
    else:
        own = own.withColumn("nodes", _none("array<int>"))
    of = lambda x: F.get("tokens", x)
    p = {k: F.lit(v) for k, v in positions.items()}
    size = pos.size()
    # with whole edges as rows there is no structure inside an edge
    structure = pos.use_graph_structure and not args.concat_edges
    extra = [p["edge_invariance"]] if pos.use_full_structure else []
    if args.concat_edges:
        edge_tokens = F.transform("e", lambda e: F.array(of(e["u"]), of(e["v"])))
        base = p["edge_invariance"] if pos.use_edges_invariance else p["graph_invariance"] if pos.use_graph_invariance else None
        fill = [p["pad"]] * (size - 1 - len(extra))
        edge_pos = F.transform("e", lambda e, i: F.array(base if base is not None else p["graph_start"] + i, *fill, *extra))
        per_edge = 1
    else:
        edge_tokens = F.flatten(F.transform("e", lambda e: F.array(F.array(of(e["u"])), F.array(of(e["v"])), F.array(vocab.lit("|")))))
        part = lambda i, j: F.array(*([p["graph_start"] + i, p["graph_sub_start"] + j] if structure else [p["graph_start"] + 3 * i + j]), *extra)
        edge_pos = F.flatten(F.transform("e", lambda e, i: F.array(*(part(i, j) for j in range(3)))))
        per_edge = 3
    first = F.size("e") * per_edge
    width = 2 if args.concat_edges else 1
    node_tokens = F.transform("nodes", lambda n: F.array(*[of(n)] * width))
    node_base = p["node_invariance"] if pos.use_node_invariance else p["graph_invariance"] if pos.use_graph_invariance else None
    node_pos = F.transform("nodes", lambda n, i: F.array(node_base if node_base is not None else p["graph_start"] + first + i, *[p["node_invariance"]] * (size - 1)))
    room = positions["graph_end"] - positions["graph_start"] + 1
    rows = own.select("inst", F.concat(edge_tokens, node_tokens).alias("graph"), F.concat(edge_pos, node_pos).cast(_ROWS).alias("graph_pos"), first.alias("edge_rows"), F.size("nodes").alias("node_rows"))
    fits = F.when(F.size("graph") <= room, F.col("graph")).otherwise(F.raise_error(F.lit(f"a graph has more than the {room} rows that have positions")).cast(_ROWS))
    return rows.withColumn("graph", fits)


def _wide(rows: Column, width: int) -> Column:
    """Rows of one token repeated over the width; wider rows as they are."""
    return F.transform(rows, lambda r: F.when(F.size(r) == 1, F.array_repeat(F.get(r, F.lit(0)), width)).otherwise(r))


def _singles(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.array(t))


def instance_tokens(parts: DataFrame, vocab: Vocab, positions: dict[str, int], args: TokenArgs, pos: PosArgs) -> DataFrame:
    """Whole instances: ``<s> [query] graph [query] thinking scratchpad task </s>``.

    parts: (inst, query, task, targets, difficulty, graph, graph_pos, edge_rows, node_rows, scratchpad); graph and
    scratchpad may be null. Gives src_tokens, positions, targets (prev_output_tokens), true_task_targets,
    scratch_pad_targets and the start and length of each part, as the sink names them.
    """
    size = pos.size()
    p = {k: F.lit(v) for k, v in positions.items()}
    thinking_room = positions.get("thinking_end", -1) - positions.get("thinking_start", 0) + 1
    if args.num_thinking_tokens > thinking_room:
        raise ValueError("more thinking tokens than positions for them")
    graph = _none() if args.no_graph else F.coalesce("graph", _none())
    graph_pos = _none() if args.no_graph else F.coalesce("graph_pos", _none())
    pad = F.coalesce("scratchpad", _none("array<int>"))
    rows = parts.withColumns({"_graph": graph, "_graph_pos": graph_pos, "_pad": pad, "_has_pad": F.col("scratchpad").isNotNull()})
    width = 2 if args.concat_edges and not args.no_graph else 1
    flat = lambda x: F.array(*[x] * size)
    marks = [p["query_invariance"]] * (size - 1)
    query_pos = F.transform("query", lambda _, i: F.array(p["query_invariance"] if pos.use_query_invariance else p["query_start"] + i, *marks))
    thinking = F.array_repeat(F.array(*[vocab.lit("!")] * width), args.num_thinking_tokens)
    thinking_pos = F.transform(F.sequence(F.lit(0), F.lit(args.num_thinking_tokens - 1)), lambda i: flat(F.lit(positions.get("thinking_start", 0)) + i)) if args.num_thinking_tokens else _none()
    task_pos = F.transform(F.concat("_pad", "task", F.array(F.lit(0))), lambda _, i: F.array(p["task_start"] + i, *[p["task_invariance"]] * (size - 1)))
    q, t = F.size("query"), F.lit(args.num_thinking_tokens)
    wide_query = _wide(_singles(F.col("query")), width)
    middle = ([F.col("_graph"), wide_query] if args.query_at_end else [wide_query, F.col("_graph")]) + [thinking]
    middle_pos = ([F.col("_graph_pos"), query_pos] if args.query_at_end else [query_pos, F.col("_graph_pos")]) + [thinking_pos]
    end = vocab.lit("</s>")
    src = F.concat(F.array(F.array(*[vocab.lit("<s>")] * width)), *middle, _wide(_singles(F.concat("_pad", "task", F.array(end))), width))
    where = F.concat(F.array(flat(p["misc_start"])), *(x.cast(_ROWS) for x in middle_pos), task_pos.cast(_ROWS))
    g, s = F.size("_graph"), F.size("_pad")
    prefix = F.lit(args.scratchpad_as_prefix)
    body = 1 + g + q + t
    labels = F.array_max(F.transform("targets", F.size))
    padded = lambda rows_, k: F.transform(rows_, lambda r: F.concat(r, F.array_repeat(vocab.lit("<pad>"), (k - F.size(r)).cast("int"))))
    told_pad = F.when(prefix, _none()).otherwise(F.transform("_pad", lambda x: F.array_repeat(x, labels)))
    own_targets = padded(F.col("targets"), labels)
    last = padded(F.array(F.array(end)), labels)
    room = positions["task_end"] - positions["task_start"] + 1
    task_length = F.size("task") + 1 + F.when(prefix, 0).otherwise(s)
    keep = [c for c in parts.columns if c not in ("query", "task", "targets", "graph", "graph_pos", "edge_rows", "node_rows", "scratchpad")]
    starts = {
        "query_start_indices": 1 + (g if args.query_at_end else F.lit(0)), "query_lengths": q, "graph_start_indices": 1 + (F.lit(0) if args.query_at_end else q), "graph_lengths": g,
        "thinking_tokens_start_idx": 1 + g + q, "thinking_tokens_length": t, "scratch_pad_start_indices": F.when(F.col("_has_pad"), body), "scratch_pad_lengths": F.when(F.col("_has_pad"), s + 1),
        "task_start_indices": body + F.when(prefix, s).otherwise(0), "task_lengths": task_length, "true_task_start_indices": body + s, "true_task_lengths": F.size("task") + 1,
    }
    edge_rows, node_rows = (F.lit(0) if args.no_graph else F.coalesce(c, F.lit(0)) for c in ("edge_rows", "node_rows"))
    starts |= {"graph_edge_start_indices": starts["graph_start_indices"], "graph_edge_lengths": edge_rows, "graph_node_start_indices": starts["graph_start_indices"] + edge_rows, "graph_node_lengths": node_rows}
    fits = F.when(task_length - 1 <= room, src).otherwise(F.raise_error(F.lit("a task has more tokens than positions")).cast(_ROWS))
    return rows.select(
        *keep, fits.alias("src_tokens"), F.size(src).alias("src_lengths"), *([where.alias("positions")] if pos.return_pos_ids else []),
        F.concat(told_pad, own_targets, last).alias("prev_output_tokens"), F.concat(own_targets, last).alias("true_task_targets"),
        F.when(F.col("_has_pad") & ~prefix, F.concat(_singles(F.col("_pad")), F.array(F.array(vocab.lit("="))))).alias("scratch_pad_targets"),
        *(c.cast("int").alias(name) for name, c in starts.items()),
    )


#: Columns that move with the tokens when a prefix is padded in front.
_STARTS = ("query_start_indices", "graph_start_indices", "thinking_tokens_start_idx", "scratch_pad_start_indices", "task_start_indices", "true_task_start_indices", "graph_edge_start_indices", "graph_node_start_indices")


def packaged(instances: DataFrame, vocab: Vocab, args: TokenArgs, batch_size: int, pad_position: int = 0) -> DataFrame:
    """instances in batches of ``batch_size`` by inst, all arrays of a batch padded to its maxima; the place of tasks is
    made one within a batch by padding in front with ``align_prefix_front_pad``. src_lengths count that padding too.
    The longest of a batch are found by aggregation and joined back; nothing is gathered but maxima."""
    own = instances.withColumn("batch_id", F.floor(F.col("inst") / batch_size))
    width = lambda c: F.size(F.get(c, F.lit(0)))
    maxima = own.groupBy("batch_id").agg(
        F.max("src_lengths").alias("_l"), F.max("task_start_indices").alias("_prefix"), F.max(F.size("prev_output_tokens")).alias("_t"), F.max(width("prev_output_tokens")).alias("_k"),
        F.max(F.size("true_task_targets")).alias("_tt"), F.max(F.coalesce(F.size("scratch_pad_targets"), F.lit(0))).alias("_sp"), F.max(width("src_tokens")).alias("_s"),
    )
    rows = own.join(maxima, "batch_id")
    offset = (F.col("_prefix") - F.col("task_start_indices")) if args.align_prefix_front_pad else F.lit(0)
    length = (F.col("_prefix") + F.col("_t")) if args.align_prefix_front_pad else F.col("_l")
    rows = rows.withColumn("_offset", offset).withColumn("_length", length)
    pad = vocab.lit("<pad>")

    def grown(column: str, front: Column, total: Column, row: Column) -> Column:
        return F.concat(F.array_repeat(row, front.cast("int")), F.col(column), F.array_repeat(row, F.greatest(F.lit(0), total - front - F.size(column)).cast("int")))

    def widened(column: str, k: Column) -> Column:
        return F.transform(column, lambda r: F.concat(r, F.array_repeat(pad, (k - F.size(r)).cast("int"))))

    none = F.lit(0)
    out = {
        "src_tokens": grown("src_tokens", F.col("_offset"), F.col("_length"), F.array_repeat(pad, F.col("_s"))),
        "src_lengths": F.col("src_lengths") + F.col("_offset"),
    }
    if "positions" in instances.columns:
        blank = F.array_repeat(F.lit(pad_position), width("positions"))
        out["positions"] = grown("positions", F.col("_offset"), F.col("_length"), blank)
    rows = rows.withColumn("prev_output_tokens", widened("prev_output_tokens", F.col("_k"))).withColumn("true_task_targets", widened("true_task_targets", F.col("_k")))
    out["prev_output_tokens"] = grown("prev_output_tokens", none, F.col("_t"), F.array_repeat(pad, F.col("_k")))
    out["true_task_targets"] = grown("true_task_targets", none, F.col("_tt"), F.array_repeat(pad, F.col("_k")))
    out["scratch_pad_targets"] = F.when(F.col("scratch_pad_targets").isNotNull(), grown("scratch_pad_targets", none, F.col("_sp"), F.array(pad)))
    out |= {c: F.col(c) + F.col("_offset") for c in _STARTS}
    return rows.withColumns(out).drop("_l", "_prefix", "_t", "_k", "_tt", "_sp", "_s", "_offset", "_length")


def gather_ids(instances: DataFrame, start: str, length: str, stride: int = 1, offset: int = 0, pad: int = 0) -> DataFrame:
    """(inst, ids, mask) for each instance: start + offset, then every stride-th place inside the part, padded to the
    longest part of its batch (or of all, without batch_id)."""
    by = Window.partitionBy("batch_id") if "batch_id" in instances.columns else Window.partitionBy(F.lit(0))
    rows = instances.filter(F.col(length).isNotNull()).withColumn("_most", F.max(length).over(by))
    places = F.transform(F.sequence(F.lit(0), F.col("_most") - 1), lambda i: F.col(start) + offset + i * stride)
    rows = rows.filter("_most > 0").withColumn("_p", places)
    inside = lambda x: x < F.col(start) + F.col(length)
    return rows.select("inst", F.transform("_p", lambda x: F.when(inside(x), x).otherwise(pad)).alias("ids"), F.transform("_p", inside).alias("mask"))


def task_ids(instances: DataFrame, true_task: bool, pad: int = 0) -> DataFrame:
    name = "true_task" if true_task else "task"
    return gather_ids(instances, f"{name}_start_indices", f"{name}_lengths", pad=pad)


def scratchpad_ids(instances: DataFrame, pad: int = 0) -> DataFrame:
    return gather_ids(instances, "scratch_pad_start_indices", "scratch_pad_lengths", pad=pad)


def query_ids(instances: DataFrame, pad: int = 0) -> DataFrame:
    return gather_ids(instances, "query_start_indices", "query_lengths", pad=pad)


def node_ids(instances: DataFrame, pad: int = 0) -> DataFrame:
    return gather_ids(instances, "graph_node_start_indices", "graph_node_lengths", pad=pad)


def edge_ids(instances: DataFrame, concat_edges: bool, pad: int = 0) -> DataFrame:
    """Places of edges, or of their ``|`` marks where an edge is three rows."""
    if concat_edges:
        return gather_ids(instances, "graph_edge_start_indices", "graph_edge_lengths", pad=pad)
    return gather_ids(instances, "graph_edge_start_indices", "graph_edge_lengths", stride=3, offset=2, pad=pad)


def reconstructed(instances: DataFrame, vocab: Vocab, concat_edges: bool, directed: bool) -> DataFrame:
    """(inst, edges, query, task, targets) in symbols, read back from the tokens: edges (u, v) sorted, the smaller node
    first if not directed. The inverse of the layout, for tests and for people."""
    part = lambda start, length: F.slice("src_tokens", F.col(start) + 1, F.col(length))
    first = lambda rows: F.transform(rows, lambda r: vocab.symbol_of(F.get(r, F.lit(0))))
    rows = part("graph_edge_start_indices", "graph_edge_lengths")
    if concat_edges:
        pairs = F.transform(rows, lambda r: F.struct(vocab.symbol_of(F.get(r, F.lit(0))).cast("int").alias("u"), vocab.symbol_of(F.get(r, F.lit(1))).cast("int").alias("v")))
    else:
        every = F.sequence(F.lit(0), (F.col("graph_edge_lengths") / 3).cast("int") - 1)
        symbol = lambda i: vocab.symbol_of(F.get(F.get(rows, i), F.lit(0))).cast("int")
        pairs = F.transform(every, lambda i: F.struct(symbol(3 * i).alias("u"), symbol(3 * i + 1).alias("v")))
    if not directed:
        pairs = F.transform(pairs, lambda e: F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v")))
    pad = vocab["<pad>"]
    labels = F.transform(F.slice("true_task_targets", F.lit(1), F.col("true_task_lengths")), lambda r: F.transform(F.filter(r, lambda x: x != pad), vocab.symbol_of))
    return instances.select("inst", F.array_sort(pairs).alias("edges"), first(part("query_start_indices", "query_lengths")).alias("query"), first(part("true_task_start_indices", "true_task_lengths")).alias("task"), labels.alias("targets"))


def pretty(instances: DataFrame, vocab: Vocab, width: int = 6) -> DataFrame:
    """(inst, line, text): positions, tokens and targets of each instance as aligned text, for reading."""
    row = lambda rows, j, show: F.array_join(F.transform(rows, lambda r: F.rpad(F.coalesce(show(F.get(r, j)), F.lit("")), width, " ")), "")
    as_text = lambda x: x.cast("string")
    lines = [("Idx", F.array_join(F.transform(F.sequence(F.lit(0), F.size("src_tokens") - 1), lambda i: F.rpad(as_text(i), width, " ")), ""))]
    if "positions" in instances.columns:
        lines.append(("Pos", row(F.col("positions"), F.lit(0), as_text)))
    lines += [("Src", row(F.col("src_tokens"), F.lit(0), vocab.symbol_of)), ("Src2", row(F.col("src_tokens"), F.lit(1), vocab.symbol_of)), ("Tgt", row(F.col("prev_output_tokens"), F.lit(0), vocab.symbol_of))]
    told = F.array(*(F.struct(F.lit(n).alias("line"), F.rtrim(t).alias("text")) for n, t in lines))
    return instances.select("inst", F.explode(told).alias("l")).select("inst", "l.line", "l.text").filter("text <> ''")


def counted_positions(tokens: DataFrame, vocab: Vocab, positions: dict[str, int]) -> DataFrame:
    """(inst, i, part, position) of flat token rows (inst, i, token, part): running numbers within each part's range, the
    older way of numbering. part: misc, query, graph or task."""
    order = Window.partitionBy("inst", "part").orderBy("i")
    start = F.element_at(F.create_map(*(x for k in ("misc", "query", "graph", "task") for x in (F.lit(k), F.lit(positions[f"{k}_start"])))), F.col("part"))
    return tokens.select("inst", "i", "part", (start + F.row_number().over(order) - 1).alias("position"))


def plot_attributes(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(inst, node, role) for drawing: start, end, path or other, from instances(inst, node, start, end) and labels(inst,
    node) of nodes on the path."""
    role = F.when(F.col("node") == F.col("start"), "start").when(F.col("node") == F.col("end"), "end").when(F.col("on"), "path").otherwise("other")
    return instances.join(labels.select("inst", "node").distinct().withColumn("on", F.lit(True)), ["inst", "node"], "left").select("inst", "node", role.alias("role"))
