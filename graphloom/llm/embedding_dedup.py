"""Near copies among embeddings: a hierarchical navigable small-world graph for each shard, searched by every vector.

Equal vectors are one from the start. The others are dealt into shards; each shard builds its graph, layer by layer,
in growing batches whose searches run in step on arrays. Every vector then searches every shard for all vectors at the
threshold or nearer. A search keeps a beam of the nearest found; where the whole beam is near enough, it is widened
for that vector until it isn't, so that no number of partners is too large. How wide beams start is set by an audit:
vectors of the shard and vectors of other shards that have partners in it are sought by brute force, and the beam
doubles until it finds enough of their partners, on average over vectors and never counting a vector itself; where too
few are met, vectors planted beside the shard's own fill up the audit. Whatever a search finds is verified in double
precision. A task takes two shards, searches each one's graph by the other's vectors, and unites what the two directions
have found, so that a link counts for both its ends whichever end has found it. It reports counts by vector and a
spanning forest of the links, not the pairs; components are the union of all forests.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm import kernels as K
from graphloom.llm.components import connected_components, join_by_key
from graphloom.llm.shared import materialize

#: Vectors of a shard: at least so many and at most so many, and 64 shards in between; and its bytes at most.
SHARD = (1 << 14, 1 << 18)
SHARD_BYTES = 1 << 28
LEAST_SHARDS = 4
#: Links of a node in upper layers; the lowest has twice as many.
LINKS = 12
BUILD_BEAM = 48
FIRST_BEAM = 16
#: Vectors with partners that an audit wants, of the shard and of others each; vectors that it looks at for them at most.
AUDIT, AUDIT_LOOKS = 256, 4096
RECALL = 0.99
_CELLS = 1 << 24


class Graph:
    """Layers of neighbour lists over unit vectors; nodes are rows of ``x``."""

    def __init__(self, x: np.ndarray, key: np.ndarray):
        """key: any integers, one each, that set the order of levels; the same input gives the same graph."""
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        u = (K.mix64(key.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS), 8).astype(np.int64)
        # the highest first, so that a batch always meets layers that are complete above it
        order = np.lexsort((np.arange(n), -level))
        self.x, self.back, level = self.x[order], order, level[order]
        self.layers = [np.full((int((level >= h).sum()), LINKS * (2 if h == 0 else 1)), -1, np.int32) for h in range(int(level[0]) + 1 if n else 0)]
        for h in reversed(range(len(self.layers))):
            self._fill(h)

    def _fill(self, h: int) -> None:
        """Links the nodes of layer h, in batches that double it."""
        total = len(self.layers[h])
        have = 0
        while have < total:
            size = min(max(64, have), total - have, 2048)
            new = np.arange(have, have + size)
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -2)
            k = min(BUILD_BEAM, size - 1)
            ids = new[np.argpartition(-near, max(k - 1, 0), axis=1)[:, :k]] if k else np.zeros((size, 0), np.int64)
            if have:
                old, _ = self._search(self.x[new], h, have, BUILD_BEAM)
                ids = np.concatenate([ids, old], axis=1)
            if ids.shape[1]:
                self._link(h, new, ids)
            have += size
        self._tie(h)

    def _tie(self, h: int) -> None:
        """Gives every node that no walk from the first node reaches a link from its nearest node that is reached: in tight
        groups pruning can leave some without any link to them, and no beam would find those."""
        layer = self.layers[h]
        seen = np.zeros(len(layer), bool)
        front = np.zeros(1, np.int64)
        more: list[tuple[int, int]] = []
        while True:
            while len(front):
                seen[front] = True
                near = np.unique(layer[front])
                near = near[near >= 0]
                front = near[~seen[near]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            known = np.flatnonzero(seen)
            lost = lost[:1024]
            best = known[np.concatenate([(self.x[lost[i : i + 64]] @ self.x[known].T).argmax(axis=1) for i in range(0, len(lost), 64)])]
            more += zip(best.tolist(), lost.tolist(), strict=True)
            front = lost
        if more:
            of: dict[int, list[int]] = {}
            for v, u in more:
                of.setdefault(v, []).append(u)
            wide = np.full((len(layer), max(map(len, of.values()))), -1, np.int32)
            for v, us in of.items():
                wide[v, : len(us)] = us
            self.layers[h] = np.concatenate([layer, wide], axis=1)

    def _pick(self, node: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (-1: none) up to ``most``: from the nearest on, each that is nearer to the node than
        to any chosen before it, then the nearest of the others."""
        out = np.full((len(node), most), -1, np.int32)
        step = max(1, _CELLS // max(1, ids.shape[1] * (ids.shape[1] + self.x.shape[1])))
        for a in range(0, len(node), step):
            c = ids[a : a + step]
            v = self.x[c]
            s = np.einsum("nd,ncd->nc", self.x[node[a : a + step]], v)
            s[c < 0] = -2
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            v = np.take_along_axis(v, order[:, :, None], 1)
            between = v @ v.transpose(0, 2, 1)
            chosen = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                free = (chosen.sum(axis=1) < most) & (s[:, j] > -2)
                chosen[:, j] = free & ~(chosen[:, :j] & (between[:, j, :j] > s[:, j, None])).any(axis=1)
            # chosen first, then the rest, each by nearness
            rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
            kept = np.where(np.take_along_axis(s, rank, 1) > -2, np.take_along_axis(c, rank, 1), -1)
            out[a : a + step, : kept.shape[1]] = kept
        return out

    def _link(self, h: int, new: np.ndarray, ids: np.ndarray) -> None:
        layer = self.layers[h]
        most = layer.shape[1]
        mine = self._pick(new, ids, most)
        layer[new] = mine
        # and back: every new neighbour joins the lists of those it chose, which are picked anew if they overflow
        to, of = mine.ravel(), np.repeat(new, most)
        of, to = of[to >= 0], to[to >= 0]
        nearness = np.einsum("nd,nd->n", self.x[of], self.x[to])
        order = np.lexsort((-nearness, to))
        to, of = to[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        inside = place < most
        targets = to[first]
        extra = np.full((len(targets), most), -1, np.int64)
        extra[np.searchsorted(targets, to[inside]), place[inside]] = of[inside]
        all_ids = np.concatenate([layer[targets], extra], axis=1)
        # a list may hold a node twice where both chose each other
        order = np.argsort(all_ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(all_ids, order, 1)
        sorted_ids[:, 1:][sorted_ids[:, 1:] == sorted_ids[:, :-1]] = -1
        layer[targets] = self._pick(targets, sorted_ids, most)

    def _descend(self, q: np.ndarray, h: int, have: int) -> np.ndarray:
        """The nearest node that greedy search from the top down to above layer h finds, for each query."""
        at = np.zeros(len(q), np.int64)
        for up in range(len(self.layers) - 1, h, -1):
            best, _ = self._beam(q, at[:, None], self.layers[up], 1)
            at = best[:, 0]
        return np.where(at < have, at, 0)

    def _search(self, q: np.ndarray, h: int, have: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(q, self._descend(q, h, have)[:, None], self.layers[h][:have], width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found (ids, cosines; -1 and -2 where fewer), all queries in step."""
        ids = np.full((len(q), width), -1, np.int64)
        cos = np.full((len(q), width), -2, np.float32)
        step = max(1, _CELLS // max(1, len(layer)))
        for a in range(0, len(q), step):
            self._beam_part(q[a : a + step], entry[a : a + step], layer, width, ids[a : a + step], cos[a : a + step])
        return ids, cos

    def _beam_part(self, q, entry, layer, width, ids, cos) -> None:
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(layer)), bool)
        seen[rows[:, None], entry] = True
        ids[:, : entry.shape[1]] = entry
        cos[:, : entry.shape[1]] = np.einsum("nd,ncd->nc", q, self.x[entry])
        done = np.zeros(ids.shape, bool)
        active = rows
        wide = 4 if width >= 16 else 1
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), -3, cos[active])
            pick = np.argpartition(-open_, min(wide, width) - 1, axis=1)[:, : min(wide, width)]
            value = np.take_along_axis(open_, pick, 1)
            go = value > -3
            alive = go.any(axis=1)
            active, pick, go = active[alive], pick[alive], go[alive]
            if not len(active):
                break
            done[active[:, None], pick] |= go
            node = np.where(go, np.take_along_axis(ids[active], pick, 1), -1)
            near = np.where(node[:, :, None] >= 0, layer[node], -1).reshape(len(active), -1)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            near = np.where(fresh, near, -1)
            # a node may come from two lists in one step
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[active[r]], self.x[near[r, c]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_cos = np.concatenate([cos[active], s], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-all_cos, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            cos[active] = np.take_along_axis(all_cos, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with a cosine of about ``least`` or more; beams that are full of them widen."""
        out = [*self.parts_within(q, least, width)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(x for _, x in out)])

    def parts_within(self, q: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same in parts."""
        least -= 1e-5
        q = np.ascontiguousarray(q, np.float32)
        left = np.arange(len(q))
        while len(left):
            width = min(width, len(self.x))
            again = []
            part = max(1, _CELLS // max(1, width * 4))
            for a in range(0, len(left), part):
                some = left[a : a + part]
                ids, cos = self._search(q[some], 0, len(self.x), width)
                hit = (ids >= 0) & (cos >= least)
                full = hit.all(axis=1) & (width < len(self.x))
                again.append(some[full])
                r, c = np.nonzero(hit & ~full[:, None])
                yield some[r], self.back[ids[r, c]]
            left = np.concatenate(again)
            width *= 4

    def _partnered(self, q: np.ndarray, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The first AUDIT of the vectors that have partners here, by place, and how many each has. own: the rows of
        ``x`` that the vectors are themselves."""
        some: list[np.ndarray] = []
        partners: list[np.ndarray] = []
        have = 0
        for a in range(0, len(q), 64):
            near = self.x @ q[a : a + 64].T >= least + 1e-5
            if own is not None:
                near[own[a : a + 64], np.arange(near.shape[1])] = False
            n = near.sum(axis=0)
            some.append(a + np.flatnonzero(n))
            partners.append(n[n > 0])
            have += len(some[-1])
            if have >= AUDIT:
                break
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *some])[:AUDIT], np.concatenate([empty, *partners])[:AUDIT]

    def _planted(self, rows: np.ndarray, least: float) -> np.ndarray:
        """Unit vectors beside rows of ``x``, at cosines from the threshold to 1."""
        draw = np.random.default_rng(len(self.x))
        x = self.x[rows]
        away = draw.normal(size=x.shape)
        away -= np.einsum("nd,nd->n", away, x)[:, None] * x
        away /= np.maximum(np.sqrt(np.einsum("nd,nd->n", away, away)), 1e-9)[:, None]
        c = draw.uniform(min(1.0, least + 1e-4), 1.0, len(rows))[:, None]
        return _unit(c * x + np.sqrt(1 - c * c) * away).astype(np.float32)

    def audited_beam(self, least: float, guests: np.ndarray | None = None) -> tuple[int, float]:
        """The beam, doubled from the first until the recall of each audit passes; and the least recall of them.

        guests: unit vectors of other shards. The recall of an audit is the mean, over its vectors, of the share of
        their partners that is found; a vector isn't its own partner.
        """
        n = len(self.x)
        if not n:
            return FIRST_BEAM, 1.0
        rows = np.random.default_rng(n).permutation(n)[:AUDIT_LOOKS]
        audits = [(self.x[rows], rows)]
        if guests is not None and len(guests):
            audits.append((np.ascontiguousarray(guests[:AUDIT_LOOKS], np.float32), None))
        known = []
        for q, own in audits:
            some, partners = self._partnered(q, own, least)
            known.append((q[some], None if own is None else own[some], partners))
        if sum(len(x[2]) for x in known) < AUDIT:
            q = self._planted(rows[:AUDIT], least)
            some, partners = self._partnered(q, None, least)
            known.append((q[some], None, partners))
        width = FIRST_BEAM
        while True:
            recall = min(self._recall(*x, least, width) for x in known)
            if recall >= RECALL or width >= n:
                return width, recall
            width *= 2

    def _recall(self, q: np.ndarray, own: np.ndarray | None, partners: np.ndarray, least: float, width: int) -> float:
        found = np.zeros(len(q), np.int64)
        place = np.empty(len(self.x), np.int64)
        place[self.back] = np.arange(len(self.x))
        for a in range(0, len(q), 16):
            i, node = self.within(q[a : a + 16], least, width)
            i, node = i + a, place[node]
            for b in range(0, len(i), 1 << 16):
                k, j = i[b : b + (1 << 16)], node[b : b + (1 << 16)]
                real = np.einsum("nd,nd->n", q[k], self.x[j]) >= least + 1e-5
                if own is not None:
                    real &= own[k] != j
                found += np.bincount(k[real], minlength=len(q))
        return float(np.minimum(found / partners, 1.0).mean()) if len(q) else 1.0


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _build(table: pa.Table, least: float) -> pa.Table:
    """A shard's graph and beam. Rows of 0 copies are vectors of other shards, for the audit alone."""
    table = table.sort_by("node")
    guests = table.filter(pc.equal(table.column("copies"), 0))
    table = table.filter(pc.greater(table.column("copies"), 0))
    if not len(table):
        return pa.table({c: pa.array([], kind) for c, kind in (("shard", pa.int64()), ("beam", pa.int64()), ("recall", pa.float64()), ("size", pa.int64()), ("index", pa.binary()))})
    node = table.column("node").to_numpy()
    v = _matrix(table.column("v"), len(node))
    graph = Graph(_unit(v), node)
    beam, recall = graph.audited_beam(least, _unit(_matrix(guests.column("v"), len(guests))) if len(guests) else None)
    out = io.BytesIO()
    np.savez(out, node=node, v=v, copies=table.column("copies").to_numpy(), back=graph.back, **{f"layer{h}": x for h, x in enumerate(graph.layers)})
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "beam": pa.array([beam], pa.int64()), "recall": [recall], "size": pa.array([len(node)], pa.int64()), "index": pa.array([out.getvalue()], pa.large_binary()).cast(pa.binary())})


class _Shard:
    """A shard's graph as it was written, its unit vectors in double precision, their numbers and copies."""

    def __init__(self, index: bytes, beam: int):
        own = np.load(io.BytesIO(index))
        self.node, self.copies, self.beam = own["node"], own["copies"], beam
        self.unit = _unit(own["v"])
        self.graph = Graph.__new__(Graph)
        self.graph.back = own["back"]
        self.graph.x = np.ascontiguousarray(self.unit[self.graph.back], np.float32)
        self.graph.layers = [own[f"layer{h}"] for h in range(len(own.files) - 4)]


def _links(asking: _Shard, asked: _Shard, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of asking, row of asked) of different vectors that the search finds and double precision confirms."""
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for a, b in asked.graph.parts_within(asking.unit, least, asked.beam):
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            real = (np.einsum("nd,nd->n", asking.unit[x], asked.unit[y]) >= least) & (asking.node[x] != asked.node[y])
            found.append((x[real].astype(np.int32), y[real].astype(np.int32)))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _meet(table: pa.Table, least: float) -> pa.Table:
    """Two shards, or one and itself: rows (node, links, other): links counts, or other an edge."""
    one, two = (_Shard(table.column(c)[0].as_py(), table.column(f"{c}_beam")[0].as_py()) for c in ("index", "other"))
    same = table.column("shard")[0] == table.column("block")[0]
    a, b = _links(two, one, least)
    y, x = (a, b) if same else _links(one, two, least)
    # what either direction has found, once
    keys = np.unique(np.concatenate([a.astype(np.int64) * len(one.node) + b, x.astype(np.int64) * len(one.node) + y]))
    a, b = keys // len(one.node), keys % len(one.node)
    sides = [(two.node, a, one.copies[b])] if same else [(two.node, a, one.copies[b]), (one.node, b, two.copies[a])]
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for node, at, weight in sides:
        links = np.bincount(at, weights=weight, minlength=len(node)).astype(np.int64)
        some = np.flatnonzero(links)
        rows.append((node[some], links[some]))
    forest = _forest(two.node[a], one.node[b])
    nodes, links = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pa.table({
        "node": pa.array(np.concatenate([nodes, forest[:, 0]]), pa.int64()),
        "links": pa.array(np.concatenate([links, np.zeros(len(forest), np.int64)]), pa.int64()),
        "other": pa.array(np.concatenate([np.zeros(len(nodes), np.int64), forest[:, 1]]), pa.int64(), mask=np.arange(len(nodes) + len(forest)) < len(nodes)),
    })


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each end of the links with the smallest node that it reaches through them."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        np.minimum.at(new, x, least[y])
        np.minimum.at(new, y, least[x])
        new = new[new]
        if (new == least).all():
            break
        least = new
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return np.stack([nodes[other], nodes[least[other]]], axis=1) if len(other) else np.zeros((0, 2), np.int64)


def embedding_groups(table: DataFrame, least: float = 0.9, column: str = "embedding", shard: tuple[int, int] = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table(vec_id, embedding, ...)``.

    Two vectors link if their cosine in double precision is ``least`` or more. component_id is the smallest vec_id
    reachable by links, kept whether it is the row's own. Vectors that are null, zero, empty, or hold null or
    non-finite components link with nothing; vectors of different lengths never link. Rows with one vec_id are
    vectors each; equal vectors link with each other and have the links of one. A row without vec_id has neither
    component nor links, nor counts for others. Other columns are ignored; an empty table gives no rows. A task holds two
    shards and the links between them, 8 bytes each and direction; two shards travel once for each pair of them, so give
    large executors large shards. Very long vectors make small shards.
    """
    spark = table.sparkSession
    ship(spark)
    rows = materialize(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")), "vectors")
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 is 0.0, and sizes are brought near 1 so that squares neither vanish nor overflow
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs)))
    scaled = F.transform("v", lambda x: x / F.col("most") + 0.0)
    good = rows.filter(sound).select("vec_id", scaled.alias("v"))
    # equal vectors are one node, named by their smallest id; equal names (one id, two vectors) are told apart by number
    nodes = good.groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, longest = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    # a row of the index holds a vector in double precision and some 40 numbers of 4 bytes, mostly its links
    per = max(1, min(max(shard[0], min(shard[1], -(-n // 64))), SHARD_BYTES // (8 * (longest or 1) + 176)))
    shards = max(LEAST_SHARDS, -(-n // per))
    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("deal"), F.size("v").alias("length"), "node", "copies", "v")
    # vectors of one length only meet: a shard is a part of a length
    dealt = dealt.withColumn("shard", F.col("length") * F.lit(1 << 32).cast("long") + F.col("deal"))
    # some vectors visit the other shards, to audit them
    visits = dealt.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, n // AUDIT_LOOKS))) == 0).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("to <> deal")
    guests = visits.select((F.col("shard") - F.col("deal") + F.col("to")).alias("shard"), "node", F.lit(0).cast("long").alias("copies"), "v")
    index = dealt.select("shard", "node", "copies", "v").unionByName(guests).groupBy("shard").applyInArrow(lambda t: _build(t, least), "shard long, beam long, recall double, size long, index binary")
    index = materialize(index, "graphs")
    # every two shards of one length meet in one task, which has both graphs
    length = F.shiftright("shard", 32).alias("length")
    keys = index.select("shard", length)
    pairs = keys.join(F.broadcast(keys.withColumnRenamed("shard", "block")), "length").filter("shard <= block").select("shard", "block")
    pairs = pairs.join(index.select("shard", "index", F.col("beam").alias("index_beam")), "shard").join(index.select(F.col("shard").alias("block"), F.col("index").alias("other"), F.col("beam").alias("other_beam")), "block")
    found = materialize(pairs.groupBy("shard", "block").applyInArrow(lambda t: _meet(t, least), "node long, links long, other long"), "links")
    part = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("of"))
    known = join_by_key(known, names, ["component"], "of", n)
    known = materialize(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"), "groups")
    # a vector that very many rows have is broadcast, the others meet by shuffle; a broadcast holds a vector as key and in its row
    total = known.agg(F.sum("copies")).first()[0] or 0
    met = join_by_key(rows.filter(sound).select("vec_id", scaled.alias("v")), known, ["v"], "copies", total, width=2 * (8 * (longest or 1) + 50))
    out = met.select("vec_id", "n_links", "component_id").unionByName(rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
