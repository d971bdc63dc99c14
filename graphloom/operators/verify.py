"""Verdicts on what a model has written: paths, breadth-first searches, k-hop chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vocab import Vocab


def verify_paths(predictions: DataFrame, dist: DataFrame, vocab_size: int, compat: bool = False) -> DataFrame:
    """(inst, code) of predictions(inst, start, end, tokens) against dist(inst, src, dst, d) in the same ids.

    1: a shortest path; 0: a longer one; -1: wrong ends or empty; -2: an end outside the vocabulary; -3: no path joins
    the ends; -4: a token outside the vocabulary; -5: a hop that is no edge. With ``compat`` any reachable hop will do
    and counts its distance.
    """
    own = F.col("tokens")
    bad_ends = (F.size(own) < 1) | own.isNull() | (F.get(own, F.lit(0)) != F.col("start")) | (F.element_at(own, -1) != F.col("end"))
    rows = predictions.withColumn("bad", F.coalesce(bad_ends, F.lit(True)))
    best = dist.select("inst", F.col("src").alias("start"), F.col("dst").alias("end"), F.col("d").alias("best"))
    rows = rows.join(best, ["inst", "start", "end"], "left")
    pairs = F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.get("tokens", i - 1).alias("src"), F.get("tokens", i).alias("dst"))))
    hop = rows.select("inst", F.posexplode(pairs).alias("at", "h")).select("inst", "at", "h.src", "h.dst")
    met = hop.join(dist, ["inst", "src", "dst"], "left")
    outside = (F.col("src") >= vocab_size) | (F.col("dst") >= vocab_size) | (F.col("src") < 0) | (F.col("dst") < 0)
    wrong = F.col("d").isNull() | (F.col("d") <= 0 if compat else F.col("d") != 1)
    fault = F.when(outside, -4).when(wrong, -5)
    walked = met.groupBy("inst").agg(F.min_by(fault, F.when(fault.isNotNull(), F.col("at"))).alias("fault"), F.sum("d").alias("walked"))
    rows = rows.join(walked, "inst", "left")
    ends_out = (F.col("start") >= vocab_size) | (F.col("end") >= vocab_size) | (F.col("start") < 0) | (F.col("end") < 0)
    code = F.when(F.col("bad"), -1).when(ends_out, -2).when(F.col("best").isNull(), -3).when(F.col("fault").isNotNull(), F.col("fault"))
    return rows.select("inst", code.when(F.coalesce("walked", F.lit(0)) > F.col("best"), 0).otherwise(1).alias("code"))


def hops_and_ends(predictions: DataFrame) -> DataFrame:
    """(inst, src, dst): the only pairs of predictions(inst, start, end, tokens) whose distances :func:`verify_paths` looks at."""
    hops = F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.get("tokens", i - 1).alias("src"), F.get("tokens", i).alias("dst"))))
    none = F.expr("cast(array() as array<struct<src:int,dst:int>>)")
    ends = F.array(F.struct(F.col("start").cast("int").alias("src"), F.col("end").cast("int").alias("dst")))
    return predictions.select("inst", F.explode(F.concat(ends, F.coalesce(hops.cast("array<struct<src:int,dst:int>>"), none))).alias("p")).select("inst", "p.src", "p.dst").filter("src is not null and dst is not null")


def verify_path(predictions: DataFrame, dist: DataFrame, vocab_size: int) -> DataFrame:
    """(inst, code) of predictions(inst, tokens): 1 a shortest path between its own ends, 0 a longer one, -1 none."""
    own = predictions.select("inst", F.get("tokens", F.lit(0)).alias("start"), F.element_at("tokens", -1).alias("end"), "tokens")
    return verify_paths(own, dist, vocab_size).select("inst", F.when(F.col("code") < 0, -1).otherwise(F.col("code")).alias("code"))


#: Verdicts on a written search.
BFS_CODES = {
    1: "a right search", 0: "some adjacency list is wrong", -1: "a depth mark is missing", -2: "a queue doesn't open", -22: "a queue doesn't close", -3: "the text ends early",
    -4: "an adjacency list doesn't open", -44: "an adjacency list doesn't close", -444: "a repeated list doesn't open", -4444: "a repeated list doesn't close",
    -5: "an id is outside the vocabulary", -6: "an id of a repeated list is outside the vocabulary", -7: "a level has no parent of the path", -8: "the path doesn't begin at the start",
    -9: "start or end is outside the vocabulary", -10: "the path isn't a shortest one",
}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though named often."""
    return F.get(F.transform(F.array(value), use), 0)


def _kinds(tokens: Column, ids: dict[str, int]) -> Column:
    """A letter for each token: a bracket, or x for anything else."""
    letter = lambda t: F.coalesce(*(F.when(t == ids[s], s) for s in "[]{}"), F.lit("x"))
    return F.array_join(F.transform(tokens, letter), "")


def _levels(tokens: Column, marks: list[int], plain: int) -> Column:
    """The tokens of each level without its mark: level k ends where the mark of level k + 1, or the plain one, stands."""
    of = F.array(*(F.lit(m) for m in marks)) if marks else F.expr("cast(array() as array<int>)")
    begins = F.aggregate(
        F.sequence(F.lit(0), F.size(tokens) - 1),
        F.expr("cast(array() as array<int>)"),
        lambda s, i: F.when((F.get(tokens, i) == plain) | F.coalesce(F.get(tokens, i) == F.get(of, F.size(s)), F.lit(False)), F.concat(s, F.array(i))).otherwise(s),
    )
    cut = lambda at: F.transform(at, lambda b, k: F.slice(tokens, b + 2, F.coalesce(F.get(at, k + 1), F.size(tokens)) - b - 1))
    return F.when(F.size(tokens) == 0, F.expr("cast(array() as array<array<int>>)")).otherwise(_bind(begins, cut))


def _entries(level: Column, ids: dict[str, int], queue: bool, twice: bool) -> Column:
    """A level as (node, nbrs, again) for each whole entry, and the code of what follows the last one, if anything does.

    The grammar is a regular expression over one letter a token: ``\\G`` chains entries from the first on.
    """
    head, tail = r"(\{[^}]*\})" if queue else "()", r"(\{[^}]*\})" if twice else "()"
    entry = rf"{head}(.)\[([^\]]*)\]{tail}"

    def parts(kinds: Column) -> Column:
        """The entries that stand whole, one after another from the first on; then the rest of the level."""

        def read(state: Column, text: Column) -> Column:
            at = lambda group: F.length(F.regexp_extract(text, entry, group))
            own = state["end"] + at(1)
            one = F.struct(
                F.get(level, own).alias("node"),
                F.slice(level, own + 3, at(3)).alias("nbrs"),
                F.slice(level, own + at(3) + 5, F.greatest(at(4) - 2, F.lit(0))).alias("again"),
            )
            return F.struct((state["end"] + F.length(text)).alias("end"), F.concat(state["entries"], F.array(one)).alias("entries"))

        start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<node:int,nbrs:array<int>,again:array<int>>>)").alias("entries"))
        whole = F.aggregate(F.regexp_extract_all(kinds, F.lit(rf"\G{entry}"), F.lit(0)), start, read)
        return _bind(whole, lambda w: F.struct(w["entries"].alias("entries"), _bind(F.substring(kinds, w["end"] + 1, F.length(kinds)), broken).alias("rest")))

    def broken(rest: Column) -> Column:
        """Which piece of an entry is missing: the first of the grammar's prefixes that the rest doesn't have."""
        missing = F.when(rest == "", F.lit(None).cast("int"))
        prefix = "^"
        wanted = [(r"\{", -2), (r"[^}]*\}", -22), (".", -3)] if queue else []
        wanted += [("" if queue else ".", -3), (r"\[", -4), (r"[^\]]*\]", -44)] + ([(r"\{", -444), (r"[^}]*\}", -4444)] if twice else [])
        for piece, code in wanted:
            prefix += piece
            missing = missing.when(~rest.rlike(prefix), code)
        return missing

    return _bind(_kinds(level, ids), parts)


def verify_bfs(predictions: DataFrame, dist: DataFrame, vocab: Vocab, vocab_size: int, include_queue: bool = False, duplicate_adjacency: bool = False, near: DataFrame | None = None) -> DataFrame:
    """(inst, code) of predictions(inst, start, end, tokens): tokens are a written search without its ``#``; see BFS_CODES.

    dist: (inst, src, dst, d) by id. Any order of lists and of nodes within a level is right. What is said first decides
    among faults of the text. A list is judged by its first token that is no neighbour: outside the vocabulary or just
    wrong; a wrong list may be made good by its repeat. Then the ends are traced back, level by level, over all hops that
    are both listed and edges. near: (inst, near), each node's neighbours as a map; with it, dist need only have the pairs
    (start, end); without it, neighbours are the pairs at distance 1.
    """
    ids = {s: vocab[s] for s in "[]{}"}
    if near is None:
        arc = dist.filter("d = 1").groupBy("inst", "src").agg(F.collect_list("dst").alias("to"))
        near = arc.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("src", "to"))).alias("near"))
    best = dist.select("inst", F.col("src").alias("start"), F.col("dst").alias("end"), F.col("d").alias("best"))
    none = F.expr("cast(array() as array<int>)")
    rows = predictions.select("inst", "start", "end", F.coalesce(F.col("tokens").cast("array<int>"), none).alias("tokens")).join(near, "inst", "left").join(best, ["inst", "start", "end"], "left")
    rows = rows.withColumn("levels", F.transform(_levels(F.col("tokens"), vocab.depth_ids(), vocab.ids.get(vocab.depth_symbol, -1)), lambda x: _entries(x, ids, include_queue, duplicate_adjacency)))

    def judged(e: Column) -> Column:
        """An entry with the code of an id outside the vocabulary, whether its list is wrong, and its real hops."""
        own = F.coalesce(F.try_element_at("near", e["node"]), none)
        inside = lambda x: (x < vocab_size) & (e["node"] < vocab_size)
        fault = lambda xs, code: F.get(F.filter(F.transform(xs, lambda x: F.when(~inside(x), code).when(~F.array_contains(own, x), 0)), lambda c: c.isNotNull()), 0)

        def weighed(first: Column) -> Column:
            second = F.when(first.isNotNull(), fault(e["again"], -6))
            good = first.isNull() | (second.isNull() & F.lit(duplicate_adjacency))
            code = F.when(first < 0, first).when(second < 0, second)
            hops = F.when(good & first.isNotNull(), e["again"]).otherwise(F.array_intersect(e["nbrs"], own))
            return F.struct(e["node"].alias("node"), code.alias("code"), (~good).alias("wrong"), hops.alias("hops"))

        return _bind(fault(e["nbrs"], -5), weighed)

    rows = rows.withColumn("seen", F.transform("levels", lambda x: F.struct(F.transform(x["entries"], judged).alias("entries"), x["rest"].alias("rest"))))
    said = F.flatten(F.transform("seen", lambda x: F.concat(F.transform(x["entries"], lambda e: e["code"]), F.array(x["rest"]))))
    marked = (F.size("tokens") == 0) | (F.size("levels") > 0) & _opens(vocab)
    # the nodes of each level from which the end is reached, from the last level to the first
    back = F.aggregate(
        F.reverse("seen"),
        F.array("end"),
        lambda s, x: F.when(F.size(s) == 0, s).otherwise(F.array_distinct(F.transform(F.filter(x["entries"], lambda e: F.arrays_overlap(e["hops"], s)), lambda e: e["node"]))),
    )
    rows = rows.withColumns({
        "fault": F.get(F.filter(said, lambda c: c.isNotNull()), 0),
        "wrong": F.exists(F.flatten(F.transform("seen", lambda x: x["entries"])), lambda e: e["wrong"]),
        "roots": back,
    })
    code = (
        F.when(~marked, -1)
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.size("roots") == 0, -7)
        .when(~F.array_contains("roots", F.col("start")), -8)
        .when((F.col("start") >= vocab_size) | (F.col("end") >= vocab_size), -9)
        .when(~F.col("best").eqNullSafe(F.size("levels")), -10)
    )
    return rows.select("inst", code.when(F.col("wrong"), 0).otherwise(1).alias("code"))


def _opens(vocab: Vocab) -> Column:
    """Whether the text begins with the mark of the first level."""
    marks = [*vocab.depth_ids()[:1], vocab.ids.get(vocab.depth_symbol, -1)]
    return F.get("tokens", 0).isin(marks)


def khop_chain(prefix: Column, right: bool = True, first: int = 1) -> Column:
    """The values met when a query (segments, ``/``, last token, ``?``) is walked back from its last token: wherever the
    current value stands, its neighbour to the right (or left) is the next; in the order told, not walked."""
    n = F.size(prefix)
    value = F.get(prefix, n - 2)
    state = F.struct(value.alias("value"), F.lit(False).alias("skip"), F.array(value).alias("out"))

    def step(s: Column, i: Column) -> Column:
        hit = ~s["skip"] & (F.get(prefix, i) == s["value"])
        beside = F.get(prefix, i + (1 if right else -1))
        return F.struct(F.when(hit, beside).otherwise(s["value"]).alias("value"), (hit & F.lit(not right)).alias("skip"), F.when(hit, F.concat(s["out"], F.array(beside))).otherwise(s["out"]).alias("out"))

    places = F.when(n - 4 >= first, F.sequence(n - 4, F.lit(first), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.reverse(F.aggregate(places, state, step, lambda s: s["out"]))


def verify_khops(predictions: DataFrame, right: bool = True, first: int = 1) -> DataFrame:
    """(inst, code) of predictions(inst, prefix, truths): 1 if the truths are the chain of the prefix, else 0. Places
    before ``first`` aren't looked at."""
    return predictions.select("inst", F.when(khop_chain(F.col("prefix"), right, first) == F.col("truths"), 1).otherwise(0).alias("code"))
