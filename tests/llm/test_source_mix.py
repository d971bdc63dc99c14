import random
import re
from collections import Counter, defaultdict
from math import comb
from statistics import stdev

import pytest

from graphloom.llm import source_mix


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    names = ["a", "b", "ä", "z", "", None]
    rows = []
    for i in range(n):
        source = draw.choices(names, [30, 3, 3, 3, 1, 2])[0]
        rows.append((i, " ".join(["w"] * draw.choice([0, 1, 5, 40, 400])), source))
    return rows


def level(sizes, share=1.5, cap=2.0):
    """Targets by sharing again and again what is above the caps."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    full = set()
    rest = share * sum(sizes.values())
    while rest > 1e-6 and len(full) < len(order):
        free = sum(weight[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += rest * weight[s] / free
        rest = 0
        for s in order:
            if target[s] > cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


SCHEMA = "doc_id long, text string, source string"


def test_targets_and_exact_takes(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = source_mix.mixed_sizes(docs, shard_words=5000, block_words=700).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = level(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r.size == len(re.findall(r"\S+", rows[r.doc_id][1]))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, source_mix.mixed_sizes(docs, shard_words=5000, block_words=700).collect()), key=str)


def test_the_mix_has_the_words_of_the_plan(spark):
    rows = corpus(seed=2)
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", shard string")
    args = {"shard_words": 5000, "block_words": 700}
    plan = {r.doc_id: r.taken for r in source_mix.mixed_sizes(docs, **args).collect()}
    mixed = source_mix.mix_sources(docs, **args)
    assert mixed.columns == [*docs.columns, "mix_shard", "pass", "taken"]
    got = defaultdict(int)
    shards = defaultdict(int)
    for r in mixed.collect():
        assert len(r.text.split()) == r.taken and rows[r.doc_id][1].startswith(r.text) and r.source == rows[r.doc_id][2]
        got[r.doc_id] += r.taken
        shards[r.mix_shard] += r.taken
    assert {d: n for d, n in plan.items() if n} == got
    assert len(shards) == 32 and max(shards.values()) < 2 * sum(shards.values()) / 32  # blocks of one or two documents here


def test_the_result_comes_from_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    split = source_mix._split
    # a tree that loses a source: so does the result
    monkeypatch.setattr(source_mix, "_split", lambda *args: split(*args).filter("slot <> 1"))
    assert sum(r.taken for r in source_mix.mixed_sizes(docs, block_words=50).collect() if r.source == "") == 0
    monkeypatch.setattr(source_mix, "_split", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        source_mix.mixed_sizes(docs)


def test_split_draws_every_block_once_and_halves_exactly(spark):
    quotas = spark.createDataFrame([(1, 37), (2, 5), (3, 1), (4, 0)], "slot int, quota long")
    leaves = source_mix._split(quotas, 3, 7).collect()
    by_slot, by_leaf = defaultdict(list), defaultdict(int)
    for r in leaves:
        by_slot[r.slot] += range(r.start, r.start + r.quota)
        by_leaf[r.node] += r.quota
    assert {s: sorted(x) for s, x in by_slot.items()} == {1: [*range(37)], 2: [*range(5)], 3: [0]}
    assert set(by_leaf) == set(range(8)) and max(by_leaf.values()) - min(by_leaf.values()) <= 1
    assert leaves == source_mix._split(quotas.repartition(3), 3, 7).collect()


def test_a_leaf_follows_the_hypergeometric_law(spark):
    """Left halves of nodes with 6, 3 and 1 blocks: every outcome as often as the law says."""
    held = "array(named_struct('slot', 1, 'start', 0L, 'quota', 6L), named_struct('slot', 2, 'start', 0L, 'quota', 3L), named_struct('slot', 3, 'start', 0L, 'quota', 1L))"
    n = 20000
    nodes = spark.range(n).selectExpr("id as node", f"{held} as held")
    got = Counter(tuple(x["quota"] for x in r[0]) for r in nodes.select(source_mix._half(3)).collect())
    assert all(sum(k) == 5 for k in got)
    for a in range(7):
        for b in range(4):
            if 0 <= (c := 5 - a - b) <= 1:
                want = n * comb(6, a) * comb(3, b) * comb(1, c) / comb(10, 5)
                assert abs(got[a, b, c] - want) < 5 * want**0.5 + 1


def test_large_counts_are_drawn_in_the_middle(spark):
    nodes = spark.range(400).selectExpr("id as node", "array(named_struct('slot', 1, 'start', 0L, 'quota', 600000L), named_struct('slot', 2, 'start', 0L, 'quota', 400000L)) as held")
    got = [r[0][0]["quota"] for r in nodes.select(source_mix._half(3)).collect()]
    # mean 300000, standard deviation sqrt(500000 * 0.6 * 0.4 * 0.5) = 245
    assert abs(sum(got) / 400 - 300000) < 5 * 245 / 20 and 200 < stdev(got) < 290


def test_odd_tables(spark):
    assert source_mix.mixed_sizes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert source_mix.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert [r.taken for r in source_mix.mixed_sizes(nothing).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b c d", "s")] * 3 + [(None, "x y", "s")], SCHEMA)
    out = source_mix.mixed_sizes(same).collect()
    assert sum(r.taken for r in out) == 21 and max(r.taken for r in out) <= 8
    assert sum(r.taken for r in source_mix.mix_sources(same).collect()) == 21
    # rows without doc_id are told apart by their texts; names that are taken
    lone = spark.createDataFrame([(None, f"w{i} " * 5, "s", 1, 2, 3) for i in range(200)], SCHEMA + ", shard int, mix_shard int, pass int")
    blocks = source_mix._Plan(lone.select("doc_id", "text", "source"), "source", 1.5, 2.0, (5, 2, 1), 7, 100, 50, 8, 64)
    assert blocks.dealt.select("block").distinct().count() > 10
    out = source_mix.mix_sources(lone)
    assert out.columns == [*lone.columns, "mix_mix_shard", "mix_pass", "taken"] and sum(r.taken for r in out.collect()) == 1500
