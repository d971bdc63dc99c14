"""Exact Jaccard self-join of word n-gram sets, size-aware: subsets for small sets, inverted lists for large ones.

A document's set has its distinct ``k``-word shingles as 64-bit hashes. With fewer than ``k`` words the whole sequence
is its one shingle; without words the set is empty and links with nothing. Two documents link when
``100 * |A & B| >= percent * |A | B|``.

Equal sets are one node from the start, whatever their number. Then

* sets below a boundary are *light*: each registers every subset that leaves out as many shingles as a partner may
  lack. Two sets that meet in a subset of size s link if ``100 * s >= percent * (|A| + |B| - s)``, and for the subset
  that equals their intersection this is the very definition. So in each subset's group the smallest set alone
  decides: whoever links with anyone there links with it, and a star round it keeps every component.
* sets at or above it are *heavy*: they are listed under their first shingles in one global order, rarest first, as
  many as make sure that linked sets meet. Each list first links to its pivot (the set with most copies); then
  only pairs that are still in different components are tried. Candidates pass an exact bound from parity maps, and
  the survivors are verified on whole sets.
* sets just above the boundary are both, so that a light and a heavy set meet.

The boundary is the one of least estimated cost under the corpus's own histogram of set sizes. The order of shingles
comes from counts over all documents; a bounded table of the most frequent ones only changes cost, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.components import connected_components, join_by_key
from graphloom.llm.shared import map_arrow, materialize

#: Most entries of the broadcast table of frequent shingles: 16 bytes each.
TABLE = 1 << 20
#: Up to so many document ids are broadcast to pick documents out of a scan; beyond, they are joined.
FEW_IDS = 1 << 20
#: Cost of an entry of an inverted list, verification included, against one subset key.
LIST_COST = 6.0
_CHUNK = 1 << 20


def _shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in K.slices(texts):
        data, at = K.utf8(part)
        starts, ends, first = K.segment(data, at, K.SPACED)
        words = K.hash_words(data, starts, ends)
        grams = K.runs(words, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([K.whole(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _missing(n: int, percent: int) -> int:
    """How many of its n shingles a set may lack in a partner at most."""
    return n - -(-percent * n // 100)


# ---------------------------------------------------------------------------------------------- corpus statistics
def _count_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): kind 0 a shingle with its documents here, kind 1 a set size with its documents."""
    held: list[np.ndarray] = []
    size = 0
    sizes: dict[int, int] = {}

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= 3
        keys, n = keys[often], n[often]
        if len(keys) > (most := 1 << 16):  # the rest only lose their place in the order
            top = np.argpartition(n, -most)[-most:]
            keys, n = keys[top], n[top]
        return pa.record_batch({"kind": np.zeros(len(keys), np.int32), "key": _signed(keys), "n": n.astype(np.int64)})

    for batch in batches:
        for grams in _shingles(batch.column(0), k):
            sizes[len(grams)] = sizes.get(len(grams), 0) + 1
            held.append(grams)
            size += len(grams)
            if size >= _CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    yield pa.record_batch({"kind": np.ones(len(sizes), np.int32), "key": np.array([*sizes], np.int64), "n": np.array([*sizes.values()], np.int64)})


def _subsets(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(_missing(n, percent) + 1))


def _list_cost(n: int, percent: int) -> float:
    return LIST_COST * (_missing(n, percent) + 1)


def largest_light(percent: int) -> int:
    """No set of more shingles has fewer subsets than a list entry costs (1024 where that is never so)."""
    fit = [n for n in range(1, 1025) if _missing(n, percent) <= 4 and _subsets(n, percent) <= _list_cost(n, percent)]
    return fit[-1]


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The size from which sets are heavy: the one of least total cost."""

    def cost(x: int) -> float:
        both = (x - 1) * 100 // percent  # the largest partner of a light set
        return sum(c * ((_subsets(n, percent) if 0 < n <= both else 0) + (_list_cost(n, percent) if n >= x else 0)) for n, c in sizes.items())

    return min(range(1, largest_light(percent) + 2), key=lambda x: (cost(x), x))


def _statistics(docs: DataFrame, k: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The light boundary, and the most frequent shingles with their document counts."""
    counted = map_arrow(docs.select("text"), lambda it: _count_batches(it, k), "kind int, key long, n long")
    table = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "shingle-counts")
    # one row for each set size that may be light or its partner, then one for each order of magnitude: both bounded
    sizes = {r["key"]: r["n"] for r in table.filter(f"kind = 1 and key <= {(largest_light(percent) + 1) * 100 // percent}").collect()}
    steps = F.floor(F.log2("n") * 4)
    fit = 0
    lowest = 1 << 62
    for r in table.filter("kind = 0").groupBy(steps.alias("step")).count().orderBy(F.desc("step")).collect():
        if fit + r["count"] > TABLE:
            break
        fit += r["count"]
        lowest = r["step"]
    often = table.filter("kind = 0").filter(steps >= lowest).select("key", "n").toArrow()
    keys = often.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return light_boundary(sizes, percent), keys[order], often.column("n").to_numpy()[order]


# ------------------------------------------------------------------------------------------------------ signatures
class _Order:
    """The place of shingles in the global order: those not in the table first, then by count, then by hash."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys >> np.uint64(42)).astype(np.int64)] = True

    def rank(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[(grams >> np.uint64(42)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[i] == grams[at], self.n[i], 0)
        return out

    def first(self, grams: np.ndarray, p: int) -> np.ndarray:
        """The first p of sorted grams in the order."""
        rank = self.rank(grams)
        if not rank.any():
            return grams[:p]
        return grams[np.argsort(rank, kind="stable")[:p]]


def _subset_keys(grams: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every subset that lacks up to ``drop`` shingles, and its size."""
    part = K.mix64(grams)
    total = np.add.reduce(part, dtype=np.uint64)
    keys, sizes = [np.array([total])], [np.array([len(grams)])]
    for d in range(1, drop + 1):
        gone = np.array([*combinations(range(len(grams)), d)])
        keys.append(total - np.add.reduce(part[gone], axis=1, dtype=np.uint64))
        sizes.append(np.full(len(gone), len(grams) - d))
    size = np.concatenate(sizes)
    return K.mix64(np.concatenate(keys) ^ K.mix64(size.astype(np.uint64))), size


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of shingles fall on it; two maps differ in no more bits than the sets differ.

    A map has a power of two of bits, 512 at least and as many as shingles, for else those of large sets would look
    alike. Halves laid over each other (xor) make the map of half the size.
    """
    bits = max(512, 1 << max(0, len(grams) - 1).bit_length())
    odd = (np.bincount((K.mix64(grams ^ np.uint64(0x5EED)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _differ(a: str, b: str) -> Column:
    """In how many bits two maps differ at least; the longer one is halved to the size of the other, which for linked
    sets takes one step."""

    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    x, y = F.col(a), F.col(b)
    each = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    # maps that are still of different sizes belong to sets that can't link
    return F.when(F.size(folded(x, y)) == F.size(folded(y, x)), F.aggregate(each, F.lit(0), lambda s, v: s + v))


def _prints(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        both = (np.add.reduce(K.mix64(grams ^ np.uint64(i)), dtype=np.uint64) for i in (1, 2))
        return tuple(int(np.uint64(x).view(np.int64)) for x in both)


_SIGNATURE = "doc_id long, row long, n long, fp1 long, fp2 long, parity array<long>, listed array<long>, subset array<long>, subset_size array<int>"


def _sign_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int, light: int, order) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("parity", "listed", "subset")), ("subset_size", pa.list_(pa.int32()))])
    place = None
    both = (light - 1) * 100 // percent
    for batch in batches:
        place = place or _Order(*order.value)
        rows: dict[str, list] = {c: [] for c in schema.names if c not in ("doc_id", "row")}
        for grams in _shingles(batch.column(1), k):
            n = len(grams)
            one, two = _prints(grams)
            rows["n"].append(n)
            rows["fp1"].append(one)
            rows["fp2"].append(two)
            rows["parity"].append(_parity(grams) if n >= light else None)
            rows["listed"].append(_signed(place.first(grams, _missing(n, percent) + 1)) if n >= light else None)
            if 0 < n <= both:
                keys, size = _subset_keys(grams, _missing(n, percent))
                rows["subset"].append(_signed(keys))
                rows["subset_size"].append(size.astype(np.int32))
            else:
                rows["subset"].append(None)
                rows["subset_size"].append(None)
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), *(pa.array(rows[c], schema.field(c).type) for c in schema.names[2:])], schema=schema)


def _set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [*_shingles(batch.column(1), k)]
        prints = np.array([_prints(g) for g in sets], np.int64).reshape(-1, 2)
        yield pa.record_batch({"fp1": prints[:, 0], "fp2": prints[:, 1], "grams": pa.array([_signed(g) for g in sets], pa.list_(pa.int64()))})


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(fp1, fp2, grams) with the whole set of each row."""
    return map_arrow(docs.select("doc_id", "text"), lambda it: _set_batches(it, k), "fp1 long, fp2 long, grams array<long>")


# ----------------------------------------------------------------------------------------------------------- links
def _pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: broadcast if they are few, else joined."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _allowed(percent: int) -> Column:
    """The greatest size of the symmetric difference of two linked sets of na and nb shingles."""
    return F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of candidate ``pairs(a, b)``."""
    short = nodes.select("node", "parity", "n")
    ends = pairs.distinct()
    for side in ("a", "b"):
        ends = ends.join(short.select(F.col("node").alias(side), F.col("parity").alias(f"p{side}"), F.col("n").alias(f"n{side}")), side)
    near = materialize(ends.filter(_differ("pa", "pb") <= _allowed(percent)).select("a", "b", "na", "nb"), "near", gather=True)
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least_id", "fp1", "fp2"), "node")
    wanted = materialize(wanted, "wanted", gather=True)
    # a doc_id may have other texts too: sets are known by their prints
    found = shingle_sets(_pick(docs, wanted.select(F.col("least_id").alias("doc_id")).distinct()), k)
    sets = materialize(found.join(wanted, ["fp1", "fp2"]).groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(side), F.col("grams").alias(f"g{side}")), side)
    common = F.size(F.array_intersect("ga", "gb")).cast("long")
    return near.withColumn("i", common).filter(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _light_links(nodes: DataFrame, percent: int) -> DataFrame:
    each = nodes.filter("subset is not null").select("node", "n", F.explode(F.arrays_zip("subset", "subset_size")).alias("s"))
    each = each.select("node", "n", F.col("s.subset").alias("key"), F.col("s.subset_size").alias("size"))
    # aggregated before the shuffle, then joined: a subset that very many sets share is never one task's work
    least = each.groupBy("key", "size").agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("of")).filter("of > 1").drop("of")
    met = each.join(least, ["key", "size"]).filter("least.node <> node")
    return met.filter(100 * F.col("size") >= percent * (F.col("n") + F.col("least.n") - F.col("size"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()


def _heavy_links(nodes: DataFrame, docs: DataFrame, k: int, percent: int, known: DataFrame) -> DataFrame:
    """Links among heavy sets that, with ``known`` ones, make all components."""
    each = nodes.filter("listed is not null").select("node", "n", "copies", F.posexplode("listed").alias("place", "gram"))
    # most shingles are listed once: only their hashes are counted, and only the others' entries go on
    shared = each.groupBy("gram").agg(F.count("*").alias("of")).filter("of > 1")
    total = nodes.agg(F.sum(F.size("listed"))).first()[0] or 0
    entries = materialize(join_by_key(each, shared, ["gram"], "of", total), "entries", gather=True)
    pivot = F.max_by(F.struct("node", "n"), F.struct("copies", -F.col("n"), -F.col("node")))
    lists = join_by_key(entries.drop("copies"), entries.groupBy("gram").agg(pivot.alias("pivot"), F.count("*").alias("of")), ["gram"], "of", total)

    def possible(na: str, nb: str, pa_: str, pb: str) -> Column:
        """Sizes, and what is left from the shared shingle on, allow a link: so it is for the first one that a linked pair shares."""
        small, large = F.least(na, nb), F.greatest(na, nb)
        most = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
        return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (F.col(na) + F.col(nb)))

    # the stars only need to find most links cheaply; what they miss is tried among the pairs across components
    stars = lists.select("node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m")).filter("node <> pivot")
    sized = stars.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    first = materialize(_verified(sized.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), nodes, docs, k, percent).unionByName(known), "links", gather=True)
    part = connected_components(first)
    placed = lists.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("gram").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("of")).filter("parts > 1").drop("parts")
    split = materialize(join_by_key(placed.select("gram", "node", "n", "place", "component"), main, ["gram"], "of", total), "split-lists")
    # linked sets differ in size by one step of a geometric scale at most: lists meet by shingle and step
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) - 1e-9) if percent < 100 else F.col("n")
    near = F.explode(F.array(step - 1, step, step + 1) if percent < 100 else F.array(step))
    stray = split.filter("component <> main").select("gram", "node", "n", "place", F.col("component").alias("ca"), near.alias("step"))
    other = split.select("gram", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("component").alias("cb"), (F.col("component") != F.col("main")).alias("astray2"), step.alias("step"))
    cross = stray.join(other, ["gram", "step"]).filter("ca <> cb and (not astray2 or node < node2)")
    cross = cross.filter(possible("n", "n2", "place", "place2"))
    pairs = materialize(cross.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "cross")
    return first.unionByName(_verified(pairs, nodes, docs, k, percent))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row, n, representative, component_id) for every row of docs(doc_id, text, row)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    light, keys, n = _statistics(docs, k, percent)
    order = docs.sparkSession.sparkContext.broadcast((keys, n))
    signed = materialize(map_arrow(docs.select("doc_id", "text", "row"), lambda it: _sign_batches(it, k, percent, light, order), _SIGNATURE), "signatures")
    some = [F.first(c).alias(c) for c in ("parity", "listed", "subset", "subset_size")]
    sets = signed.filter("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), *some)
    # a number for each set: one doc_id may have many
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _heavy_links(nodes, docs, k, percent, materialize(_light_links(nodes, percent), "light"))
    part = connected_components(links)
    known = nodes.select("fp1", "fp2", "n", "node", "least_id", "copies").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("of"))
    known = materialize(join_by_key(known, names, ["component"], "of", known.count()).select("fp1", "fp2", "n", F.col("least_id").alias("representative"), "component_id", "copies"), "groups", gather=True)
    own = signed.select("doc_id", "row", "n", "fp1", "fp2")
    grouped = F.col("n") > 0
    met = join_by_key(own.filter(grouped & F.col("doc_id").isNotNull()), known, ["fp1", "fp2", "n"], "copies", known.agg(F.sum("copies")).first()[0] or 0)
    alone = own.filter(~grouped | F.col("doc_id").isNull()).withColumns({"representative": F.col("doc_id"), "component_id": F.col("doc_id")})
    return met.unionByName(alone).drop("fp1", "fp2")


def _rows(docs: DataFrame) -> list[Column]:
    """doc_id, text and a hash of the text, by which rows of one doc_id are told apart."""
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row")]


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, representative, component_id) for every row of ``docs(doc_id, text, ...)``.

    representative: the smallest doc_id with an equal set; component_id: the smallest reachable by links, itself
    included. Null or empty texts have an empty set, a component of their own and no links. A row without doc_id has
    neither representative nor component. Rows of one doc_id with different texts are documents each. Other columns are
    ignored; an empty table gives no rows. Very long texts are taken whole.
    """
    out = _grouped(docs.select(*_rows(docs)), k, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "representative", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that whose doc_id names the group, of such rows with different texts the one
    of the least hash, of rows that agree in both the first by their JSON text. Rows without doc_id or words stay, but
    for repeated ones of one doc_id. Cases as in :func:`jaccard_groups`.
    """
    groups = _grouped(docs.select(*_rows(docs)), k, percent).filter("doc_id is not null")
    groups = materialize(groups.groupBy("component_id", "doc_id", "row").agg(F.count("*").alias("of")), "rows")
    first = groups.filter("component_id = doc_id").groupBy("doc_id", "component_id").agg(F.min("row").alias("first"), F.count("*").alias("texts")).filter("texts > 1")
    later = groups.join(first, ["doc_id", "component_id"]).filter("row <> first").select("doc_id", "row")
    gone = materialize(groups.filter("component_id <> doc_id").select("doc_id", "row").unionByName(later), "copies", gather=True)
    few = gone.limit(FEW_IDS + 1).count() <= FEW_IDS
    # the caller's columns travel in one struct, where no name can clash
    doc_id, _, row = _rows(docs)
    rows = docs.select(doc_id, row, F.struct("*").alias("_doc"))
    left = rows.join(F.broadcast(gone) if few else gone, ["doc_id", "row"], "left_anti")
    twice = materialize(groups.filter("of > 1").select("doc_id", "row"), "repeated")
    if not twice.isEmpty():
        some = left.join(twice, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
        left = left.join(twice, ["doc_id", "row"], "left_anti").unionByName(some)
    return left.select("_doc.*")
