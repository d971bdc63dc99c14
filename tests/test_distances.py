"""Distances of known graphs, by all plans, against a plain search."""

import random

import pytest

from graphloom.operators import distances as D
from graphloom.config import PathArgs
from graphloom.operators import measures, order, paths

#: Two known graphs of 25 nodes, their centres for given queries, and a shortest path in each.
G1 = "6-1 7-0 7-5 8-3 12-1 12-3 13-6 14-0 17-4 18-2 18-9 18-10 19-2 20-3 20-14 20-17 22-5 22-9 22-13 23-8 24-14 2-11 11-21 15-16 10-16"
G3 = "10-0 10-6 11-5 14-4 14-10 15-0 16-3 17-7 19-18 22-12 15-16 1-13 2-5 3-13 11-8 17-22 8-9 9-20 22-21 13-23 19-21 20-21 21-24 6-13 22-9 3-20 19-17"
KNOWN = [
    (G1, range(25), {5, 6, 7, 13, 22}, [19, 2, 18, 10]),
    (G3, [0, 10, 11, 20, 23], {3, 20}, [10, 6, 13, 3, 20, 21, 19, 18]),
]
SCHEMA = "inst long, edge_idx int, u int, v int"


def parsed(text):
    return [tuple(map(int, e.split("-"))) for e in text.split()]


def plain(pairs, directed=False):
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set())
        if not directed:
            near[v].add(u)
    out = {}
    for s in near:
        d, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near[x] if y not in d and not d.update({y: d[x] + 1})]
        out |= {(s, t): n for t, n in d.items()}
    return out


def table(spark, graphs):
    return spark.createDataFrame([(g, i, u, v) for g, pairs in enumerate(graphs) for i, (u, v) in enumerate(pairs)], SCHEMA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.inst, {})[r.src, r.dst] = r.d
    return out


def test_known_graphs(spark):
    edges = table(spark, [parsed(g) for g, *_ in KNOWN])
    dist = D.distances(edges).persist()
    assert found(dist) == {i: plain(parsed(g)) for i, (g, *_) in enumerate(KNOWN)}
    for i, (_, query, want, path) in enumerate(KNOWN):
        asked = spark.createDataFrame([(i, q) for q in query], "inst long, node int")
        assert {r.node for r in measures.center(dist, asked).collect()} == want
        assert found(dist)[i][path[0], path[-1]] == len(path) - 1
    asked = spark.createDataFrame([(1, q) for q in KNOWN[1][1]], "inst long, node int")
    assert {r.node for r in measures.center(dist, asked, centroid=True).collect()} == {3, 13}


def random_graphs(seed, n=12):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        size = draw.choice([2, 5, 12, 30])
        pairs = {(draw.randrange(size), draw.randrange(size)) for _ in range(draw.choice([3, 12, 40]))}
        out.append([p for p in pairs if p[0] != p[1]] or [(0, 1)])
    return out


@pytest.mark.parametrize("plan", ["tensor", "array", "frontier"])
@pytest.mark.parametrize("directed", [False, True])
def test_plans_agree_with_a_plain_search(spark, plan, directed):
    graphs = random_graphs(3)
    assert found(D.distances(table(spark, graphs), directed, plan)) == {i: plain(g, directed) for i, g in enumerate(graphs)}


@pytest.mark.parametrize("directed", [False, True])
def test_causal_truth_is_the_distance_in_every_prefix(spark, directed):
    graphs = random_graphs(4, 8)
    got = {}
    for r in D.causal_ground_truth(table(spark, graphs), directed).collect():
        got[r.inst, r.row_idx, r.node] = r.d
    want = {}
    for g, pairs in enumerate(graphs):
        for t in range(len(pairs)):
            for (s, node), d in plain(pairs[: t + 1], directed).items():
                if s == pairs[t][0]:
                    want[g, t, node] = d
    assert got == want


def test_lone_nodes_unknown_plans_and_dense_forms(spark):
    edges = table(spark, [[(0, 2)]])
    nodes = spark.createDataFrame([(0, 4)], "inst long, n int")
    assert found(D.distances(edges, every_node=nodes))[0] == {(0, 0): 0, (2, 2): 0, (0, 2): 1, (2, 0): 1, (1, 1): 0, (3, 3): 0}
    with pytest.raises(ValueError):
        D.distances(edges, plan="best")
    assert D.distances(edges.limit(0)).count() == 0
    dense = D.densified(D.distances(edges), spark.createDataFrame([(0, n) for n in (0, 1, 2)], "inst long, node int"))
    assert {r.src: r.text.split() for r in measures.pretty_distances(dense).collect()} == {0: ["0", "-1", "1"], 1: ["-1", "-1", "-1"], 2: ["1", "-1", "0"]}
    assert {r.node: r.text for r in measures.pretty_ranks(measures.node_ranks(D.distances(edges))).collect()} == {0: "0: 0 | 1: 2", 2: "0: 2 | 1: 0"}
    names = order.node_map(nodes, 10, 14, 1)
    packed = D.packaged_distances(D.distances(edges), names)
    dense = D.distance_tensor(packed, 15).collect()[0].distances
    to = {r.node: r.token for r in names.collect()}
    assert sorted(to.values()) == [10, 11, 12, 13]
    assert dense[to[0]][to[2]] == 1 and dense[to[0]][to[1]] == -1 and len(dense) == 15


def test_symmetry_and_triangles(spark, sf):
    from graphloom.plans.queries import lineitem_edges

    dist = D.distances(lineitem_edges(spark, sf)).persist()
    back = dist.selectExpr("inst", "dst as src", "src as dst", "d")
    assert dist.exceptAll(back).count() == 0
    far = dist.selectExpr("inst", "src", "dst as mid", "d as a").join(dist.selectExpr("inst", "src as mid", "dst", "d as b"), ["inst", "mid"]).join(dist, ["inst", "src", "dst"])
    assert far.filter("d > a + b").count() == 0
    dist.unpersist()


@pytest.mark.parametrize("directed", [False, True])
def test_told_scores_are_the_scores_of_the_distances(spark, directed):
    edges = table(spark, random_graphs(5))
    rows = [sorted((tuple(r[c] for c in ("inst", "a", "b", "d", "euclidean", "manhattan", "dot", "cosine")) for r in x.collect()), key=str) for x in (measures.told_scores(edges, directed), measures.row_scores(D.distances(edges, directed)))]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert measures.told_scores(edges.limit(0)).count() == 0


@pytest.mark.parametrize("directed", [False, True])
def test_ends_of_told_graphs_are_those_of_their_distances(spark, directed):
    edges = table(spark, random_graphs(7, 60))
    for args in (PathArgs(max_path_length=6, min_path_length=3, sample_choice_node=0.9), PathArgs(max_path_length=4, min_path_length=2, sample_choice_node=0.0), PathArgs(max_path_length=40, min_path_length=30, sample_choice_node=1.0)):
        got, want = paths.told_ends(D.told_graphs(edges), args, 5, directed), paths.start_end(D.distances(edges, directed), args, 5)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 60


@pytest.mark.parametrize("directed", [False, True])
def test_asked_distances_are_those_of_all_pairs(spark, directed):
    graphs = random_graphs(6)
    edges = table(spark, graphs)
    asked = [(i, a, b) for i in range(len(graphs)) for a in (-1, 0, 3, 11, 40) for b in (0, 2, 7, 29, 1000)]
    got = found(D.asked_distances(edges, spark.createDataFrame(asked + asked[:9] + [(99, 0, 0)], "inst long, src int, dst int"), directed))
    want = {i: {p: d for p, d in plain(g, directed).items() if (i, *p) in asked} for i, g in enumerate(graphs)}
    assert got == {i: x for i, x in want.items() if x}


@pytest.mark.parametrize("directed", [False, True])
def test_neighbours_of_told_graphs(spark, directed):
    graphs = random_graphs(8)
    want = {i: {} for i in range(len(graphs))}
    for i, g in enumerate(graphs):
        for (a, b), d in plain(g, directed).items():
            if d == 1:
                want[i].setdefault(a, set()).add(b)
    got = {r.inst: {a: sorted(bs) for a, bs in r.near.items()} for r in D.told_neighbours(D.told_graphs(table(spark, graphs)), directed).collect()}
    assert got == {i: {a: sorted(bs) for a, bs in x.items()} for i, x in want.items()}


@pytest.mark.parametrize("directed", [False, True])
def test_frontier_in_pieces_and_blocks(spark, directed, monkeypatch):
    """Graphs of many pieces and of more than 64 sources; rows are few, whatever the number of pairs."""
    monkeypatch.setattr(D, "_PIECE", 48)
    draw = random.Random(9)
    graphs = [[p for p in ((draw.randrange(n), draw.randrange(n)) for _ in range(2 * n)) if p[0] != p[1]] for n in (150, 70)]
    made, real = [], D.cut
    monkeypatch.setattr(D, "cut", lambda *a: (made.append(real(*a)), made[-1])[1])
    got = found(D.distances(table(spark, graphs), directed, "frontier"))
    assert got == {i: plain(g, directed) for i, g in enumerate(graphs)}
    assert max(x.count() for x in made if x.columns[-1] == "d") <= (4 * 3 + 2 * 2) < sum(map(len, got.values())) / 100
    assert D.distances(table(spark, graphs).limit(0), directed, "frontier").count() == 0
