"""Paths, searches and k-hop chains against plain versions, and verifiers against what was told and what was spoilt."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.config import BfsArgs, KhopsArgs, PathArgs
from graphloom.functions.vocab import default_vocab
from graphloom.operators import distances as D
from graphloom.operators import khops, order, paths, search, verify
from graphloom.sources import khops as khop_sources
from graphloom.sources import random_graphs

VOCAB = default_vocab(40, 30)


@pytest.fixture(scope="module")
def batch(spark):
    nodes = random_graphs.instances(spark, 60, 15, 25, 1)
    edges = random_graphs.shuffled_edges(random_graphs.connect_random(nodes, random_graphs.erdos_renyi(nodes, 0.12, 1), seed=1), 1).persist()
    dist = D.distances(edges).persist()
    names = order.node_map(nodes, VOCAB.min_vocab, VOCAB.max_vocab, 1).persist()
    ends = paths.start_end(dist, PathArgs(max_path_length=6, min_path_length=3), 1).persist()
    return nodes, edges, dist, names, paths.node_tokens(names).persist(), ends


def graphs(edges):
    near, told = defaultdict(lambda: defaultdict(set)), defaultdict(list)
    for r in edges.orderBy("inst", "edge_idx").collect():
        near[r.inst][r.u].add(r.v)
        near[r.inst][r.v].add(r.u)
        told[r.inst].append((r.u, r.v))
    return near, told


def far(dist):
    return {(r.inst, r.src, r.dst): r.d for r in dist.collect()}


def test_starts_and_ends(spark, batch):
    _, edges, dist, *_, ends = batch
    near, _ = graphs(edges)
    d = far(dist)
    lengths = [3, 4, 5, 6]
    for r in ends.collect():
        assert d[r.inst, r.start, r.end] == r.d and r.d + 1 in lengths
    sure = PathArgs(max_path_length=4, min_path_length=4, sample_choice_node=1.0)
    for r in paths.start_end(dist, sure, 2).collect():
        same = lambda b, i=r.inst: sum(v == 3 for (g, _, t), v in d.items() if g == i and t == b)
        choices = [(same(b), len(near[r.inst][a])) for (g, a, b), v in d.items() if g == r.inst and v == 3 and len(near[g][a]) >= 2]
        if choices:
            assert (same(r.end), len(near[r.inst][r.start])) == max(choices)
    fixed = paths.start_end(dist, PathArgs(), 3, spark.createDataFrame([(i, 0) for i in range(60)], "inst long, start int")).collect()
    assert {r.start for r in fixed} == {0}
    weighed = paths.start_end(dist, PathArgs(max_path_length=5, min_path_length=3, task_sample_dist=(0.0, 0.0, 1.0)), 4).collect()
    assert {r.d for r in weighed} <= {4}


def test_paths_and_labels(batch):
    _, edges, dist, _, tokens, ends = batch
    near, _ = graphs(edges)
    d = far(dist)
    way = paths.shortest_paths(edges, dist, ends, 1)
    rows = {r.inst: r.path for r in way.collect()}
    length = {r.inst: r.d for r in ends.collect()}
    for i, p in rows.items():
        assert len(p) == length[i] + 1 and all(b in near[i][a] for a, b in zip(p, p[1:], strict=False))
    for r in paths.label_smoothing(way, edges, dist).collect():
        p = rows[r.inst]
        if r.step:
            others = [j for j in near[r.inst][p[r.step - 1]] if d.get((r.inst, j, p[-1])) == len(p) - 1 - r.step]
            assert r.labels == [p[r.step], *sorted(j for j in others if j != p[r.step])]
        else:
            assert r.labels == [p[0]]
    told = paths.told_paths(edges, ends, 1)
    assert {r.inst: r.path for r in told.collect()} == rows
    assert sorted(map(tuple, paths.label_rows(told).collect())) == sorted(map(tuple, paths.label_smoothing(way, edges, dist).select("inst", "step", "node", "labels").collect()))
    assert sorted(map(str, paths.path_tokens(told, None, tokens, VOCAB).collect())) == sorted(map(str, paths.path_tokens(way, paths.label_smoothing(way, edges, dist), tokens, VOCAB).collect()))
    of = {r.inst: r.tokens for r in tokens.collect()}
    for r in paths.path_tokens(way, paths.label_smoothing(way, edges, dist), tokens, VOCAB).collect():
        p = [of[r.inst][x] for x in rows[r.inst]]
        assert r.query == [VOCAB["/"], p[0], p[-1], VOCAB["?"]] and r.task == [VOCAB["="], *p, VOCAB["."]]
        assert [t[0] for t in r.targets] == r.task and r.difficulty == len(p)


def plain_bfs(told, start, end, stop):
    place, near = {}, defaultdict(set)
    for u, v in told:
        for x in (u, v):
            place.setdefault(x, len(place))
        near[u].add(v)
        near[v].add(u)
    seen, level, out, who = {start}, [start], [], {}
    while level:
        follow, done = [], False
        for k, x in enumerate(level):
            fresh = [y for y in sorted(near[x], key=place.get) if y not in seen]
            seen.update(fresh)
            who.update(dict.fromkeys(fresh, x))
            out.append((len(out), level[k:], x, fresh))
            follow += fresh
            if end in fresh:
                done = True
                if stop:
                    break
        if done:
            break
        level = follow
    path = [end]
    while path[-1] != start:
        path.append(who[path[-1]])
    return out, path[::-1]


@pytest.mark.parametrize("stop", [True, False])
def test_searches_equal_a_plain_one(batch, stop):
    _, edges, dist, *_, ends = batch
    _, told = graphs(edges)
    asked = {r.inst: (r.start, r.end) for r in ends.collect()}
    for r in search.bfs_traces(edges, ends, BfsArgs(stop_once_found=stop)).collect():
        steps, path = plain_bfs(told[r.inst], *asked[r.inst], stop)
        assert r.found and r.path == path
        assert [(s.queue, s.node, s.nbrs) for s in r.steps] == [x[1:] for x in steps]


def test_a_search_without_end(spark):
    edges = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 2, 3)], "inst long, edge_idx int, u int, v int")
    ends = spark.createDataFrame([(0, 0, 3)], "inst long, start int, end int")
    row = search.bfs_traces(edges, ends, BfsArgs()).collect()[0]
    assert not row.found and row.path == []


FLAGS = [{}, {"include_queue": True}, {"duplicate_adjacency": True}, {"reverse_adjacency": True, "include_queue": True, "duplicate_adjacency": True}, {"unique_depth_markers": False}, {"stop_once_found": False}]


@pytest.mark.parametrize("flags", FLAGS)
def test_told_searches_verify_and_spoilt_ones_do_not(spark, batch, flags):
    _, edges, dist, names, tokens, ends = batch
    args = BfsArgs(**flags)
    traces = search.bfs_traces(edges, ends, args).persist()
    told = search.bfs_tokens(traces, tokens, VOCAB, args)
    of = {r.inst: r.tokens for r in tokens.collect()}
    asked = {r.inst: (of[r.inst][r.start], of[r.inst][r.end]) for r in ends.collect()}
    text = {r.inst: r.scratchpad for r in told.collect()}
    first = VOCAB["D0"] if args.unique_depth_markers else VOCAB["D"]
    assert all(t[0] == VOCAB["#"] and t[1] == first for t in text.values())
    packed = D.packaged_distances(dist, names).selectExpr("inst", "src_tok as src", "dst_tok as dst", "d").persist()
    schema = "inst long, start int, end int, tokens array<int>"

    def codes(change):
        rows = [(i, *asked[i], change(list(t[1:]))) for i, t in text.items()]
        out = verify.verify_bfs(spark.createDataFrame(rows, schema), packed, VOCAB, len(VOCAB.ids), args.include_queue, args.duplicate_adjacency)
        return {r.inst: r.code for r in out.collect()}

    assert set(codes(lambda t: t).values()) == {1}
    assert set(codes(lambda t: t[1:]).values()) == {-1}
    assert set(codes(lambda t: [x for x in t if x != VOCAB["]"]]).values()) <= {-44, -4, -1}
    assert all(c < 1 for c in codes(lambda t: t[:-2]).values())
    draw = random.Random(1)

    def spoilt(t):
        at = draw.randrange(len(t) - 1)
        t[at] = t[at + 1]
        return t

    # what stands in a queue or a repeated list is not looked at, so not every spoilt token shows
    assert sum(c < 1 for c in codes(spoilt).values()) > 0.5 * len(text)
    traces.unpersist()


def test_searches_by_ids_and_their_verdicts_from_neighbours(spark, batch):
    """Told graphs by id give the same text, and neighbours with the ends' distances the same verdicts, as all distances."""
    _, edges, dist, names, tokens, ends = batch
    args = BfsArgs(include_queue=True, duplicate_adjacency=True)
    at = lambda c: F.get("tokens", F.col(c)).alias(c)
    named = ends.join(tokens, "inst").select("inst", at("start"), at("end"))
    of = lambda c: F.transform(c, lambda x: F.get("tokens", x)).alias(c)
    graphs = D.told_graphs(edges).join(tokens, "inst").select("inst", of("us"), of("vs"))
    told = search.bfs_tokens(search.bfs_traces(graphs, named, args), None, VOCAB, args)
    assert sorted(told.collect()) == sorted(search.bfs_tokens(search.bfs_traces(edges, ends, args), tokens, VOCAB, args).collect())
    said = told.select("inst", F.slice("scratchpad", F.lit(2), F.size("scratchpad") - F.col("inst") % 3).cast("array<int>").alias("tokens")).join(named, "inst")
    packed = D.packaged_distances(dist, names).selectExpr("inst", "src_tok as src", "dst_tok as dst", "d")
    few = D.asked_distances(graphs, named.selectExpr("inst", "start as src", "end as dst"))
    got = verify.verify_bfs(said, few, VOCAB, len(VOCAB.ids), True, True, D.told_neighbours(graphs))
    assert sorted(got.collect()) == sorted(verify.verify_bfs(said, packed, VOCAB, len(VOCAB.ids), True, True).collect())
    assert {r.code for r in got.collect()} > {1}


def test_every_code_of_the_search_verifier(spark):
    v = VOCAB
    say = lambda text: [v[s] if s in v.ids and not s.isdigit() else int(s) for s in text.split()]
    dist = spark.createDataFrame([(0, x, y, abs(x - y)) for x in (23, 24, 25) for y in (23, 24, 25)], "inst long, src int, dst int, d int")
    near = spark.createDataFrame([(0, x, y, abs(x - y) if {x, y} != {23, 25} else 1) for x in (23, 24, 25) for y in (23, 24, 25)], "inst long, src int, dst int, d int")

    def code(text, q=False, t=False, start=23, end=25, of=dist):
        rows = spark.createDataFrame([(0, start, end, None if text is None else say(text))], "inst long, start int, end int, tokens array<int>")
        return verify.verify_bfs(rows, of, v, len(v.ids), q, t).first().code

    assert code("D0 23 [ 24 ] D1 24 [ 25 ]") == code("D 23 [ 24 ] D 24 [ 25 ]") == 1
    assert code("D0 23 [ 24 25 ] D1 24 [ 25 ]") == code("D0 23 [ 25 24 ] D1 24 [ 25 ]") == 0
    assert code("23 [ 24 ]") == -1
    assert code("D0 23 [ 24 ]", q=True) == -2 and code("D0 { 23 [ 24 ]", q=True) == -22 and code("D0 { 23 }", q=True) == -3
    assert code("D0 23 24 ]") == code("D0 23") == -4 and code("D0 23 [ 24") == -44
    assert code("D0 23 [ 24 ]", t=True) == -444 and code("D0 23 [ 24 ] { 24", t=True) == -4444
    assert code("D0 23 [ 999 ]") == -5 and code("D0 23 [ 25 ] { 999 }", t=True) == -6
    assert code("D0 23 [ 25 999 ] D1 24 [ 25 ]") == -7  # wrong before it is outside, and no real hop
    assert code("D0 23 [ 24 ] D1 24 [ ]") == -7 and code("D0 24 [ 25 ]") == code("") == code(None) == -8
    assert code("D0 23 [ 24 ] D1 24 [ 25 ]", of=near) == -10
    assert code("D0 23 [ 25 ] { 24 } D1 24 [ 25 ] { 25 }", t=True) == 1
    # the first fault of the text decides
    assert code("D0 23 [ 999 ] D1 24") == -5 and code("D0 23 [ D1 24 [ 999 ]") == -44
    assert code("D0 { 23 } 23 [ 24 ] D1 { 24 } 24 [ 25 ]", q=True) == 1
    assert set(verify.BFS_CODES) >= {1, 0, -9}


def test_depth_first(batch):
    _, edges, dist, _, tokens, ends = batch
    near, _ = graphs(edges)
    traces = search.dfs_traces(edges, ends, tokens, sort_adjacency=True)
    asked = {r.inst: (r.start, r.end) for r in ends.collect()}
    for r in traces.collect():
        assert r.found and (r.path[0], r.path[-1]) == asked[r.inst]
        assert all(b in near[r.inst][a] for a, b in zip(r.path, r.path[1:], strict=False))
        assert all(s.others[0] == s.node for s in r.steps)
    for r in search.dfs_tokens(traces, tokens, VOCAB).collect():
        assert r.scratchpad[:2] == [VOCAB["#"], VOCAB["D0"]] and (len(r.scratchpad) - 1) % 3 == 0 and len(r.targets) == len(r.scratchpad)


def test_depth_spans(spark):
    text = [VOCAB["D0"], 30, VOCAB["D2"], VOCAB["D1"], 31, 32, VOCAB["D2"]]
    got = search.depth_spans(spark.createDataFrame([(0, text), (1, [])], "inst long, tokens array<int>"), VOCAB).collect()
    assert sorted((r.depth, r.begin, r.end) for r in got) == [(0, 0, 3), (1, 3, 6), (2, 6, 7)]


def test_path_codes(spark):
    dist = spark.createDataFrame([(0, a, b, abs(a - b)) for a in range(1, 5) for b in range(1, 5)] + [(0, 9, 9, 0)], "inst long, src int, dst int, d int")
    cases = {(1, 3): [([1, 2, 3], 1), ([1, 2, 3, 2, 3], 0), ([1, 3], -5), ([1, 2], -1), ([], -1), ([1, 99, 3], -4), (None, -1)], (1, 9): [([1, 9], -3)], (1, 60): [([1, 60], -2)], (2, 2): [([2], 1)]}
    rows = [(0, s, e, t) for (s, e), own in cases.items() for t, _ in own]
    for (s, e), own in cases.items():
        for t, code in own:
            told = spark.createDataFrame([(0, s, e, t)], "inst long, start int, end int, tokens array<int>")
            assert verify.verify_paths(told, dist, 50).collect()[0].code == code, (s, e, t)
    assert len(rows) == 10
    told = spark.createDataFrame([(0, 1, 4, [1, 3, 4])], "inst long, start int, end int, tokens array<int>")
    assert verify.verify_paths(told, dist, 50, compat=True).collect()[0].code == 1
    # the pairs that the verdict looks at are enough
    told = spark.createDataFrame([(0, *r[1:]) for r in rows], "inst long, start int, end int, tokens array<int>").withColumn("inst", F.monotonically_increasing_id())
    each = told.select("inst").join(dist.drop("inst"))
    few = each.join(verify.hops_and_ends(told).distinct(), ["inst", "src", "dst"])
    assert few.count() < each.count() / 4
    assert sorted(verify.verify_paths(told, few, 50).collect()) == sorted(verify.verify_paths(told, each, 50).collect())
    alone = spark.createDataFrame([(0, [1, 2, 3])], "inst long, tokens array<int>")
    assert verify.verify_path(alone, dist, 50).collect()[0].code == 1


def plain_hops(seq, k, right):
    back = [None] * len(seq)
    for i, x in enumerate(seq):
        for j in range(i - 1, -1, -1):
            if seq[j] == x:
                p = j + (1 if right else -1)
                back[i] = p if p >= 0 else None
                break
    at, out = list(range(len(seq))), []
    for _ in range(k):
        at = [None if p is None else back[p] for p in at]
        out.append([-1 if p is None else seq[p] for p in at])
    return out


@pytest.mark.parametrize("right", [True, False])
def test_hops(spark, right):
    args = KhopsArgs(max_khops=4, min_khops=2, max_prefix_length=40, min_prefix_length=10)
    told = khop_sources.sequences(khop_sources.khops_instances(spark, 20, args, 2), 23, 28, 2).persist()
    seqs = defaultdict(list)
    for r in told.orderBy("inst", "i").collect():
        seqs[r.inst].append(r.token)
    hopped = khops.hops(told, 4, right).persist()
    rows = {r.inst: r for r in hopped.collect()}
    assert all(rows[i].tokens == s and rows[i].hops == plain_hops(s, 4, right) for i, s in seqs.items())
    every = {(r.inst, r.i): r.labels for r in khops.hop_targets(hopped, KhopsArgs(), 6).collect()}
    assert every == {(i, p): [x] for i, s in seqs.items() for p, x in enumerate(plain_hops(s, 4, right)[3]) if x >= 0}
    late = {(r.inst, r.i) for r in khops.hop_targets(hopped, KhopsArgs(mask_to_vocab_size=True), 6).collect()}
    assert late == {(i, p) for i, p in every if p >= len(seqs[i]) - 6}
    for (i, p), labels in {(r.inst, r.i): r.labels for r in khops.hop_targets(hopped, KhopsArgs(intermediate_labels=True, mask_to_size=12), 6).collect()}.items():
        back = [h[p] for h in reversed(plain_hops(seqs[i], 4, right))]
        n = next((n for n in range(1, 4) if back[n] in back[:n]), 4)
        assert p > 12 and labels == back[:n]
    row = khops.khops_tokens(hopped, khops.hop_targets(hopped, KhopsArgs(), 6), VOCAB).filter("inst = 3").collect()[0]
    assert row.query == [VOCAB["/"], VOCAB["D4"], VOCAB["?"]] and row.task[1:-1] == seqs[3] and len(row.targets) == len(row.task)


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("fresh", [True, False])
@pytest.mark.parametrize("method", ["uniform", "non_uniform"])
def test_generated_chains_verify(spark, right, fresh, method):
    args = KhopsArgs(max_khops=6, min_khops=2, max_prefix_length=30, min_prefix_length=18, right_side_connect=right, no_repeats=fresh, partition_method=method)
    told = khops.generated_tokens(khop_sources.generated_segments(khop_sources.khops_instances(spark, 60, args, 3), 23, 60, args, 3), VOCAB)
    rows = [(r.inst, r.query, r.task[1:-1]) for r in told.collect()]
    schema = "inst long, prefix array<int>, truths array<int>"
    assert {r.code for r in verify.verify_khops(spark.createDataFrame(rows, schema), right, first=0).collect()} == {1}
    wrong = [(i, p, [t[0] + 1, *t[1:]]) for i, p, t in rows]
    assert {r.code for r in verify.verify_khops(spark.createDataFrame(wrong, schema), right, first=0).collect()} == {0}
    labels = khops.generated_tokens(khop_sources.generated_segments(khop_sources.khops_instances(spark, 3, args, 3), 23, 60, args, 3), VOCAB, multi_label=True).collect()
    assert all(r.targets[1] == r.task[1:-1] for r in labels)
    assert spark.createDataFrame(rows, schema).select(F.size("prefix")).first()[0] > 0


def test_sql_names(spark):
    from graphloom.functions import names, partitions
    from graphloom.functions.draws import draw

    names.register(spark)
    names.register(spark)  # again does no harm
    got = {(r.total, r.parts): r.n for r in spark.sql("SELECT t.total, p.parts, p.n FROM VALUES (1), (7), (40), (0), (NULL) t(total), LATERAL partition_counts(t.total) p").collect()}
    assert got == {(q, k): str(partitions.count(q, k, q)) for q in (1, 7, 40) for k in range(1, q + 1)}
    r = spark.range(50).select(draw(5, "id").alias("a"), F.expr("graph_draw(5, CAST(id AS STRING))").alias("b"), F.expr("graph_uniform(5, CAST(id AS STRING))").alias("u")).collect()
    assert all(x.a == x.b and x.u == x.a / 2**32 for x in r)
    assert spark.sql("SELECT graph_hash(array(named_struct('s', 2, 'o', 1, 'd', 0), named_struct('s', 1, 'o', 2, 'd', 3))) AS h, graph_hash(NULL) AS n").first() == (hashlib.md5(b"1,2,3;2,1,0").hexdigest(), None)


def test_left_over_keeps_repeats_and_nulls(spark):
    told = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3), (2, 3)], "inst long, u int")
    known = spark.createDataFrame([(1, None), (2, 3)], "inst long, u int")
    from graphloom.operators import measures

    assert sorted(measures.left_over(told, known).collect(), key=str) == [(1, None), (2, 3), (2, 3)]
    assert measures.left_over(told.limit(0), known).count() == 0
