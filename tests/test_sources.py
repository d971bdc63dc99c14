"""Generated graphs and sequences keep what their families promise."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.config import KhopsArgs
from graphloom.functions import partitions
from graphloom.sources import khops, random_graphs, registry, shaped_graphs


def by_inst(edges):
    out = defaultdict(list)
    for r in edges.orderBy("inst", "edge_idx").collect():
        out[r.inst].append((r.u, r.v))
    return out


def parts(n, pairs):
    return len(random_graphs._host_components(n, pairs))


def simple(pairs, directed=False):
    keys = [p if directed else frozenset(p) for p in pairs]
    return len(set(keys)) == len(keys) and all(u != v for u, v in pairs)


def test_independent_edges_have_their_mean_and_become_connected(spark):
    nodes = random_graphs.instances(spark, 200, 20, 20, 1)
    edges = random_graphs.erdos_renyi(nodes, 0.2, 1)
    mean = edges.count() / 200
    assert abs(mean - random_graphs.expected_edges(20, 0.2)) < 2
    joined = by_inst(random_graphs.connect_random(nodes, random_graphs.erdos_renyi(nodes, seed=1), seed=1))
    assert len(joined) == 200 and all(parts(20, p) == 1 and simple(p) for p in joined.values())
    with pytest.raises(ValueError):
        random_graphs.erdos_renyi(nodes, 1.5)


def test_points_meet_within_the_radius_and_nearest_components_join(spark):
    nodes = random_graphs.instances(spark, 20, 15, 25, 2)
    points = random_graphs.uniform_points(nodes, 2, 2).persist()
    edges = random_graphs.euclidean(points, 0.25)
    spots = {(r.inst, r.node): r.pos for r in points.collect()}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    want = {(i, u, v) for (i, u), p in spots.items() for (j, v), q in spots.items() if i == j and u < v and far(p, q) < 0.25}
    assert {(r.inst, r.u, r.v) for r in edges.collect()} == want
    n = {r.inst: r.n for r in nodes.collect()}
    assert all(parts(n[i], p) == 1 for i, p in by_inst(random_graphs.connect_nearest(nodes, edges, points, seed=2)).items())
    points.unpersist()


def test_connections_by_size(spark):
    got = {r.n: r.c for r in spark.createDataFrame([(10,), (100,), (200,)], "n int").select("n", random_graphs.connections(F.col("n"), 75, 125, 0, "n").alias("c")).collect()}
    assert got[10] == 1 and got[200] == 2 and got[100] in (1, 2)


def test_trees_are_trees(spark):
    nodes = random_graphs.instances(spark, 50, 15, 25, 3)
    for make in ({"bernoulli_p": 0.5}, {"probs": (0.1, 0.4, 0.5)}, {"bernoulli_p": 0.0}):
        edges, ends = shaped_graphs.random_trees(nodes, seed=3, **make)
        last = {r.inst: r.end for r in ends.collect()}
        for i, pairs in by_inst(edges).items():
            assert [v for _, v in pairs] == list(range(1, len(pairs) + 1)) and all(u < v for u, v in pairs)
            assert Counter(u for u, _ in pairs)[0] >= 2 and max(Counter(u for u, _ in pairs).values()) <= 3
            assert 0 < last[i] <= len(pairs)
    full = by_inst(shaped_graphs.full_tree_edges(nodes, 3))
    grown = by_inst(shaped_graphs.random_trees(nodes, 3, -1, 0.0)[0])
    assert full == grown
    with pytest.raises(ValueError):
        shaped_graphs.random_trees(nodes, 1)


def test_stars_and_balanced_graphs(spark):
    edges, ends = shaped_graphs.path_stars(spark, 30, (2, 5), (5, 10), 4)
    shape = {r.inst: r for r in ends.collect()}
    for i, pairs in by_inst(edges).items():
        assert len(pairs) == shape[i].arms * (shape[i].length - 1)
        assert [v for u, v in pairs if u == 0] == [1 + a * (shape[i].length - 1) for a in range(shape[i].arms)]
    nodes = random_graphs.instances(spark, 60, 30, 40, 5).withColumn("lookahead", (F.col("inst") % 3 + 3).cast("int"))
    for noise in (-1, 0):
        edges, ends = shaped_graphs.balanced(nodes, max_noise=noise, seed=5)
        n = {r.inst: r for r in nodes.collect()}
        for i, pairs in by_inst(edges).items():
            ahead = n[i].lookahead
            assert simple(pairs, True) and all((k, k + 1) in pairs for k in range(ahead))
            assert max(map(max, pairs)) < n[i].n
            # no cycles: nodes without arcs in can be taken away until none is left
            left = set(pairs)
            while left:
                heads = {v for _, v in left}
                gone = {(u, v) for u, v in left if u not in heads}
                assert gone
                left -= gone
        assert {r.end - n[r.inst].lookahead for r in ends.collect()} == {0}
    assert shaped_graphs.balanced_fits(12, 5) and not shaped_graphs.balanced_fits(11, 5)


def test_sequences_and_segments(spark):
    args = KhopsArgs(max_khops=5, min_khops=2, max_prefix_length=40, min_prefix_length=20)
    drawn = khops.khops_instances(spark, 40, args, 6)
    told = defaultdict(list)
    for r in khops.sequences(drawn, 3, 9, 6).orderBy("inst", "i").collect():
        told[r.inst].append(r.token)
    length = {r.inst: (r.k, r.length) for r in drawn.collect()}
    assert all(len(t) == length[i][1] and all(3 <= x <= 9 for x in t) and all(a != b for a, b in zip(t, t[1:], strict=False)) for i, t in told.items())
    assert len({x for t in told.values() for x in t}) == 7
    whole = defaultdict(list)
    for r in khops.sequences(drawn, 3, 9, 6, permutations=3).orderBy("inst", "i").collect():
        whole[r.inst].append(r.token)
    assert all(sorted(t[i : i + 7]) == list(range(3, 10)) for t in whole.values() for i in (0, 7, 14))
    for right in (True, False):
        for fresh in (True, False):
            own = KhopsArgs(max_khops=5, min_khops=2, max_prefix_length=40, min_prefix_length=20, right_side_connect=right, no_repeats=fresh)
            for r in khops.generated_segments(drawn, 3, 30, own, 6).groupBy("inst").agg(F.countDistinct("seg").alias("k"), F.count("*").alias("n")).collect():
                assert (r.k, r.n) == (length[r.inst][0], length[r.inst][1] + length[r.inst][0])


def test_partitions():
    known = {(93, 7): 270775, (100, 10): 2977866, (150, 12): 253686437, (200, 9): 290766028}
    assert all(partitions.count(q, n, q) == c for (q, n), c in known.items())
    assert partitions.table(100)[100][10] == 2977866
    for draw in (partitions.uniform_partition, partitions.quick_partition):
        for i in range(50):
            got = draw(200, 9, 1, i)
            assert sum(got) == 200 and len(got) == 9 and min(got) >= 1
    seen = Counter(tuple(sorted(partitions.uniform_partition(10, 3, 1, i))) for i in range(1600))
    assert len(seen) == partitions.count(10, 3, 10) and max(seen.values()) < 1.5 * min(seen.values())
    with pytest.raises(ValueError):
        partitions.uniform_partition(3, 4, 0)


@pytest.mark.parametrize("kind", ["erdos_renyi", "euclidean", "random_tree", "path_star", "balanced"])
def test_registry(spark, kind):
    options = {"batch_size": 12, "min_num_nodes": 30, "max_num_nodes": 34, "shuffle_edges": True, "max_edges": 120}
    nodes, edges, _ = registry.graphs(spark, kind, seed=8, **options)
    got = by_inst(edges)
    assert len(got) == 12 and all(len(p) <= 120 for p in got.values())
    assert [r.edge_idx for r in edges.filter("inst = 3").orderBy("edge_idx").collect()] == list(range(len(got[3])))
    assert got == by_inst(registry.graphs(spark, kind, seed=8, **options)[1].repartition(7))
    with pytest.raises(ValueError):
        registry.graphs(spark, "ring")


def test_graphs_that_are_too_large_are_drawn_again_up_to_max_attempts(spark):
    """Few draws fit: after 7 tries most of the batch would be missing."""
    for family, options in (("erdos_renyi", {"min_num_nodes": 4, "max_num_nodes": 24, "max_edges": 4}), ("random_tree", {"min_num_nodes": 6, "max_num_nodes": 12, "max_edges": 6, "max_depth": -1})):
        nodes, edges, ends = registry.graphs(spark, family, seed=3, batch_size=12, max_attempts=200, **options)
        size = {r.inst: r.n for r in nodes.collect()}
        counts = {r.inst: r["count"] for r in edges.groupBy("inst").count().collect()}
        assert len(counts) == 12 and max(counts.values()) <= options["max_edges"]
        assert all(max(r.u, r.v) < size[r.inst] for r in edges.collect())
        assert ends is None or {r.inst for r in ends.collect()} == set(counts)


def test_attempts_end_at_max_attempts(spark):
    """Trees of 12 nodes never fit into 3 edges: all attempts are made, then every instance is left out."""
    options = {"min_num_nodes": 12, "max_num_nodes": 12, "max_edges": 3, "max_depth": -1, "bernoulli_p": 0.0, "batch_size": 2}
    nodes, edges, ends = registry.graphs(spark, "random_tree", max_attempts=5, **options)
    assert nodes.isEmpty() and edges.isEmpty() and ends.isEmpty()
    # of attempts that fit the first is taken
    options |= {"min_num_nodes": 3, "batch_size": 8}
    few, many = (sorted(map(tuple, registry.graphs(spark, "random_tree", max_attempts=m, **options)[0].collect())) for m in (3, 40))
    assert set(few) <= set(many) and len(many) == 8
