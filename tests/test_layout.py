"""Tokens, positions and packaging: what is laid out can be read back, and every part is where its column says."""

import pytest
from pyspark.sql import functions as F

from graphloom.config import PosArgs, TokenArgs
from graphloom.functions.vocab import POSITIONS
from graphloom.operators import layout
from graphloom.plans import dataset

OPTIONS = {"batch_size": 12, "min_num_nodes": 15, "max_num_nodes": 20, "max_vocab_nodes": 50, "min_path_length": 3, "max_path_length": 6, "shuffle_edges": True}


@pytest.mark.parametrize(
    "extra",
    [
        {}, {"concat_edges": False}, {"query_at_end": False, "include_nodes": True, "num_thinking_tokens": 3}, {"duplicate_edges": True, "align_prefix_front_pad": True},
        {"scratchpad_type": "bfs"}, {"scratchpad_type": "bfs", "scratchpad_as_prefix": True, "concat_edges": False}, {"scratchpad_type": "dfs"}, {"no_graph": True},
        {"concat_edges": False, "use_graph_structure": True, "use_full_structure": True, "include_nodes": True},
    ],
)
def test_parts_are_where_they_are_said_to_be(spark, extra):
    kind = "path_star" if "query_at_end" in extra or extra.get("scratchpad_type") == "dfs" else "erdos_renyi"
    data = dataset.build(spark, kind, seed=5, **{**OPTIONS, **extra})
    v = data.vocab
    rows = data.packaged.collect()
    assert len(rows) == 12 and len({len(r.src_tokens) for r in rows}) == 1
    for r in rows:
        src = [t[0] for t in r.src_tokens]
        assert len(r.positions) == len(r.src_tokens) and len({len(t) for t in r.src_tokens}) == 1
        assert src[r.query_start_indices] == v["/"] and src[r.query_start_indices + r.query_lengths - 1] == v["?"]
        task = src[r.true_task_start_indices : r.true_task_start_indices + r.true_task_lengths]
        assert task[0] == v["="] and task[-2:] == [v["."], v["</s>"]] and [t[0] for t in r.true_task_targets][: len(task)] == task
        assert src[r.src_lengths - 1] == v["</s>"] and set(src[r.src_lengths :]) <= {v["<pad>"]}
        whole = src[r.task_start_indices : r.task_start_indices + r.task_lengths]
        assert [t[0] for t in r.prev_output_tokens][: len(whole)] == whole
        if extra.get("align_prefix_front_pad"):
            assert len({x.task_start_indices for x in rows}) == 1
        if "scratchpad_type" in extra:
            assert src[r.scratch_pad_start_indices] == v["#"]
        if extra.get("num_thinking_tokens"):
            assert src[r.thinking_tokens_start_idx : r.thinking_tokens_start_idx + 3] == [v["!"]] * 3
        if extra.get("include_nodes"):
            at = r.graph_node_start_indices
            assert len(set(src[at : at + r.graph_node_lengths])) == r.graph_node_lengths == r.num_nodes
    if not extra.get("no_graph"):
        names = {}
        for r in data.packaged.select("inst").join(data.edges, "inst").collect():
            names.setdefault(r.inst, set()).add((r.u, r.v))
        back = layout.reconstructed(data.instances, v, extra.get("concat_edges", True), kind == "path_star").collect()
        for r in back:
            want = len(names[r.inst]) * (2 if extra.get("duplicate_edges") else 1)
            assert len(r.edges) == want and r.query[0] == "/" and r.task[0] == "="


def test_positions(spark):
    data = dataset.build(spark, "erdos_renyi", seed=1, concat_edges=False, use_graph_structure=True, use_full_structure=True, num_thinking_tokens=1, **OPTIONS)
    r = data.instances.first()
    p = [list(x) for x in r.positions]
    assert p[0] == [POSITIONS["misc_start"]] * 3
    assert p[1:5] == [[200, 940, 2], [200, 941, 2], [200, 942, 2], [201, 940, 2]]
    assert p[r.query_start_indices] == [50, 1, 1] and p[r.thinking_tokens_start_idx] == [950] * 3 and p[r.task_start_indices] == [1000, 6, 6]
    assert p[-1] == [1000 + r.task_lengths - 1, 6, 6]


def test_gathers(spark):
    data = dataset.build(spark, "erdos_renyi", seed=1, concat_edges=False, scratchpad_type="bfs", include_nodes=True, **OPTIONS)
    own = {r.inst: r for r in data.packaged.collect()}
    v = data.vocab
    for r in layout.edge_ids(data.packaged, False, pad=-1).collect():
        assert [own[r.inst].src_tokens[i][0] for i, m in zip(r.ids, r.mask, strict=True) if m] == [v["|"]] * own[r.inst].num_edges
        assert all(i == -1 for i, m in zip(r.ids, r.mask, strict=True) if not m)
    for f in (layout.scratchpad_ids, layout.node_ids, layout.query_ids):
        assert f(data.packaged).count() == 12
    assert {len(r.ids) for r in layout.task_ids(data.packaged, True).collect()} == {max(r.true_task_lengths for r in own.values())}


def test_limits_and_readable_text(spark):
    with pytest.raises(ValueError):
        layout.instance_tokens(spark.createDataFrame([], "inst long"), dataset.default_vocab(5), POSITIONS, TokenArgs(num_thinking_tokens=51), PosArgs())
    data = dataset.build(spark, "path_star", seed=1, **OPTIONS)
    text = {r.line: r.text for r in layout.pretty(data.instances, data.vocab).filter("inst = 0").collect()}
    assert text["Src"].startswith("<s>") and text["Tgt"].startswith("=") and {"Idx", "Pos", "Src2"} <= text.keys()
    with pytest.raises(Exception, match="more nodes than"):
        dataset.build(spark, "erdos_renyi", seed=1, **{**OPTIONS, "max_vocab_nodes": 10}).packaged.collect()


def test_no_task_and_khops(spark):
    data = dataset.build(spark, "erdos_renyi", "none", seed=1, **OPTIONS)
    assert data.packaged.count() == 12
    for kind in ("khops", "khops_gen"):
        data = dataset.build(spark, kind, seed=2, batch_size=6, max_khops=4, max_prefix_length=20, min_prefix_length=15, max_vocab_nodes=20)
        rows = data.packaged.collect()
        assert len(rows) == 6 and {r.graph_lengths for r in rows} == {0}
        assert all(r.src_tokens[r.query_start_indices + r.query_lengths - 1][0] == data.vocab["?"] for r in rows)


def test_batches_come_one_by_one(spark):
    data = dataset.build(spark, "path_star", seed=1, **{**OPTIONS, "batch_size": 5})
    got = [t.num_rows for t in dataset.batches(data.packaged)]
    assert got == [5]


def test_counted_positions_and_plot_attributes(spark):
    told = spark.createDataFrame([(0, 0, 5, "misc"), (0, 1, 6, "query"), (0, 2, 7, "query"), (0, 3, 8, "task")], "inst long, i int, token int, part string")
    got = [(r.i, r.position) for r in layout.counted_positions(told, dataset.default_vocab(5), POSITIONS).orderBy("i").collect()]
    assert got == [(0, 11), (1, 50), (2, 51), (3, 1000)]
    nodes = spark.createDataFrame([(0, n, 0, 3) for n in range(5)], "inst long, node int, start int, end int")
    on = spark.createDataFrame([(0, 0), (0, 1), (0, 3)], "inst long, node int")
    assert [r.role for r in layout.plot_attributes(nodes, on).orderBy("node").collect()] == ["start", "path", "other", "end", "other"]
    assert nodes.filter(F.col("node") > 9).count() == 0
