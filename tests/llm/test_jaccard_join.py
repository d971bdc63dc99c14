import random
import re

import pytest

from graphloom.llm import components, jaccard_join

SCHEMA = "doc_id long, text string, component string"


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    part = {d: d for d in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    by_gram = {}
    for d in ids:
        for g in sets[d]:
            by_gram.setdefault(g, []).append(d)
    near = {(a, b) for docs in by_gram.values() for i, a in enumerate(docs) for b in docs[i + 1 :] if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b]))}
    for a, b in near:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            part[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def varied(seed):
    """Short and long texts in near copies of many degrees, with passages in common and every odd case."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "a b c"), (1007, "A  b\nC")]
    for group in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 9, 12, 20, 25, 31, 60, 150, 400]))]
        if group % 3 == 0:
            base += passage
        for _ in range(draw.choice([1, 2, 5, 9])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "percent", "few"), [(3, 90, True), (5, 80, False), (1, 80, True)])
def test_equals_brute_force(spark, monkeypatch, k, percent, few):
    """By broadcast, and as with very many rows, where only hot keys are broadcast."""
    if not few:
        monkeypatch.setattr(components, "FEW", 0)
    rows = varied(k)
    out = jaccard_join.jaccard_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), k, percent).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k, percent)


def test_a_hot_group_of_different_near_copies(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    out = jaccard_join.jaccard_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 90)


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = jaccard_join.jaccard_groups(docs, 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 90)


def test_empty_table_and_odd_rows(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", None)], SCHEMA)
    out = sorted(jaccard_join.jaccard_groups(odd).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in out] == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(odd).collect()) == ["1", "None"]


def test_one_doc_id_with_two_texts_has_the_links_of_each(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    near = lambda t: t.replace("w0 ", "x ")
    rows = [(5, a, "x"), (5, b, "x"), (7, near(a), "x"), (3, near(b), "x"), (9, "other words here", None), (9, "other words here", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(docs, 3, 90).collect()}
    assert got == {(5, 5), (7, 5), (5, 3), (3, 3), (9, 9)}
    assert sorted((r.doc_id, r.text) for r in jaccard_join.keep_one(docs, 3, 90).collect()) == sorted([(5, a), (3, near(b)), (9, "other words here")])


def test_columns_that_have_no_hash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", {"x": 1})] * 2 + [(2, "a b c d e f", {"x": 2})], "doc_id long, text string, row map<string,int>")
    assert [tuple(r) for r in jaccard_join.keep_one(docs).collect()] == [(1, "a b c d e f", {"x": 1})]


@pytest.mark.parametrize(("k", "percent", "n"), [(3, 90, 10), (5, 80, 7)])
def test_the_light_half_finds_links_by_proper_subsets(spark, k, percent, n):
    """Short texts and the same without their first or last word: all sets are light, and no list is made."""
    draw = random.Random(n)
    rows = []
    for _ in range(40):
        base = [f"v{draw.randrange(5000)}" for _ in range(n + k - 1)]
        rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate((base, base[1:], base[:-1]))]
    assert jaccard_join.light_boundary({n: 40, n - 1: 80}, percent) > n
    lists = []
    heavy = jaccard_join._heavy_links
    spy = lambda nodes, *a: lists.append(nodes.filter("listed is not null").count()) or heavy(nodes, *a)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard_join, "_heavy_links", spy)
        out = jaccard_join.jaccard_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), k, percent).collect()
    want = brute(rows, k, percent)
    assert lists == [0] and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_light_boundary_follows_the_histogram():
    assert jaccard_join.light_boundary({}, 90) == 1
    assert jaccard_join.light_boundary({5: 1000}, 90) > 5
    assert jaccard_join.light_boundary({30: 10}, 80) <= 30
