import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components
from graphloom.llm import embedding_dedup as E
from graphloom.llm.queries import op8_embedding_dedup


def brute(rows, least=0.9):
    sound = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for length in {len(rows[i][1]) for i in sound}:
        own = [i for i in sound if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[own[a]].add(own[b])
    part = {}
    for i in sorted(links, key=lambda i: (rows[i][0] is None, rows[i][0])):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in part:
                part[j] = rows[i][0]
                stack += links[j]
    return sorted(((d, len(links[i]), part[i]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_embeddings_table(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = op8_embedding_dedup(spark, sf)
    assert found(out) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 0.45]), (4, [1.0, 0.5]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [1.0, None]), (9, [float("nan"), 1.0]),
        (10, [float("inf"), 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-300, 0.0]), (13, [1e300, -0.0]), (14, [0.0, 1.0]), (15, [-1.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    want = [(d, 0 if d is None else n, c) for d, n, c in brute([(d, [x * 1e-290 for x in v] if d == 13 else [x * 1e290 for x in v] if d == 12 else v) for d, v in rows])]
    assert found(E.embedding_groups(table)) == want
    assert E.embedding_groups(table.limit(0)).count() == 0


def test_hot_copies_and_hot_near_copies(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(900, 32))
    x[100:400] = x[7] + 0.15 * draw.normal(size=(300, 32))
    x[400:700] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=(100, 1000))) == brute(rows)


@pytest.mark.parametrize("noise", [0.05, 0.12])
def test_recall_of_the_graph_against_brute_force(noise):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(400, 64))
    x = np.concatenate([centres[draw.integers(0, 400, 3000)] + noise * draw.normal(size=(3000, 64)), draw.normal(size=(2000, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = E.Graph(x, np.arange(len(x)))
    beam, recall = graph.audited_beam(0.9)
    assert recall >= E.RECALL
    got = set(zip(*(a.tolist() for a in graph.within(x, 0.9, beam)), strict=True))
    want = set(map(tuple, np.argwhere(x @ x.T >= 0.9).tolist()))
    assert len(got & want) >= 0.97 * len(want)


class Blind(E.Graph):
    """Finds nothing but the vector itself, or the members of one large group, unless the beam is wide."""

    def within(self, q, least, width):
        cos = q @ self.x.T
        found = cos >= least
        if width < 64:
            found &= (cos >= 0.99999) | (self.back < self.group)
        a, b = np.nonzero(found)
        return a, self.back[b]


@pytest.mark.parametrize("group", [0, 600])
def test_audit_counts_partners_and_not_the_vector_itself(group):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(2000, 32))
    x[:group] = x[0] + 0.02 * draw.normal(size=(group, 32))
    x[1000:1010] = x[1990:] + 0.05 * draw.normal(size=(10, 32))
    if group:
        x[1100:1140] = x[1200:1240] + 0.05 * draw.normal(size=(40, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Blind(x, np.arange(len(x)))
    graph.group = group
    beam, recall = graph.audited_beam(0.9)
    assert beam >= 64 and recall >= E.RECALL


def test_audit_meets_vectors_of_other_shards():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = E.Graph(x, np.arange(len(x)))
    seen = []
    within = graph.within
    graph.within = lambda q, least, width: seen.append(q) or within(q, least, width)
    guests = x[:20] + 0.01 * draw.normal(size=(20, 32))
    guests = (guests / np.linalg.norm(guests, axis=1)[:, None]).astype(np.float32)
    assert graph.audited_beam(0.9, guests)[1] >= E.RECALL
    met = np.concatenate(seen)
    assert all((met == g).all(axis=1).any() for g in guests)


def _shard(x, node, graph=E.Graph):
    out = E._Shard.__new__(E._Shard)
    out.unit, out.node, out.copies, out.beam = x, node, np.ones(len(x), np.int64), 64
    out.graph = graph(x, node)
    return out


class OneWay(E.Graph):
    """Finds nothing for vectors whose first component is positive."""

    def parts_within(self, q, least, width):
        for a, b in super().parts_within(q, least, width):
            yield a[q[a, 0] <= 0], b[q[a, 0] <= 0]


@pytest.mark.parametrize("same", [False, True])
def test_a_link_counts_for_both_ends_whichever_finds_it(monkeypatch, same):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 16))
    x[200:] = x[:200] + 0.2 * draw.normal(size=(200, 16))
    x[:200, 0] = -abs(x[:200, 0])
    x[200:, 0] = abs(x[200:, 0]) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    shards = [_shard(x, np.arange(400), OneWay)] * 2 if same else [_shard(x[:200], np.arange(200), OneWay), _shard(x[200:], np.arange(200, 400), OneWay)]
    monkeypatch.setattr(E, "_Shard", lambda which, _: shards[which])
    table = pa.table({"shard": [1], "block": [1 if same else 2], "index": [0], "other": [1], "index_beam": [64], "other_beam": [64]})
    got = [r for r in E._meet(table, 0.9).to_pylist() if r["other"] is None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    # two vectors of which neither finds anything have no link here
    close[200:, 200:] = False
    if not same:
        close[:200, :200] = False
    assert close.any() and {r["node"]: r["links"] for r in got} == {i: int(n) for i, n in enumerate(close.sum(axis=1)) if n}


def test_large_vectors_make_small_shards(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD_BYTES", 50 * (8 * 24 + 176))
    draw = np.random.default_rng(8)
    x = draw.normal(size=(500, 24))
    x[250:] = x[:250] + 0.05 * draw.normal(size=(250, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_broadcasts_of_vectors_are_bounded_by_bytes(spark, monkeypatch):
    """What 1500 narrow keys may take, 300 vectors of 24 don't: only the hot one is sent."""
    monkeypatch.setattr(components, "FEW", 1500)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 24))
    x[:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sent, real = [], F.broadcast

    def broadcast(df):
        if "v" in df.columns:
            sent.append(df.count())
        return real(df)

    monkeypatch.setattr(F, "broadcast", broadcast)
    assert found(E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)
    assert sent == [1]
