import math
import random
import re
from collections import Counter

import pytest

from graphloom.llm import lm_scoring

SCHEMA = "doc_id long, text string, good string"


def brute(rows, good, places, strength):
    """The same model over words instead of places."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in rows}
    out = {}
    for d, w in words.items():
        loss = []
        for docs in (good, set(words)):
            single, pair = Counter(), Counter()
            for o in docs - {d}:
                single.update(words[o])
                pair.update(zip(words[o], words[o][1:], strict=False))
            total = sum(single.values())
            sum_ = 0.0
            for i, x in enumerate(w):
                p = 0.95 * single[x] / max(total, 1) + 0.05 / places
                h, j = (single[w[i - 1]], pair[w[i - 1], x]) if i else (0, 0)
                sum_ -= math.log((j + strength * p) / (h + strength))
            loss.append(sum_ / max(1, len(w)))
        out[d] = (len(w), *loss)
    return out


def corpus():
    draw = random.Random(4)
    rows = [(-1, None), (-2, ""), (-3, "one"), (-4, "a a A a")]
    for i in range(60):
        topic = "xyz" if i % 2 else "abc"
        rows.append((i, " ".join(draw.choice(topic) + draw.choice(topic) for _ in range(draw.choice([3, 30, 200])))))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    good = {d for d, _ in rows if d >= 0 and d % 2 and d % 3}
    ids = spark.createDataFrame([(d,) for d in good] * 2 + [(None,)], "doc_id long")
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = brute(rows, good, 1 << 20, 16.0)
    for r in lm_scoring.cross_entropy_difference(docs, ids).collect():
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n
        if n:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((target, background, background - target), abs=1e-5)
        else:
            assert r.score is None


def test_held_out_topic_is_told_apart(spark):
    rows = corpus()
    good = spark.createDataFrame([(d,) for d, _ in rows if d >= 0 and d % 2 and d % 3], "doc_id long")
    out = lm_scoring.cross_entropy_difference(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), good).collect()
    held = [(r.score > 0) == bool(r.doc_id % 2) for r in out if r.doc_id >= 0 and not (r.doc_id % 2 and r.doc_id % 3)]
    assert sum(held) / len(held) > 0.95
    assert lm_scoring.cross_entropy_difference(spark.createDataFrame([], SCHEMA), good).count() == 0


def test_unseen_pairs_stay_unseen_in_a_large_corpus(spark):
    """Counts are exact by word and pair, with more distinct pairs than any fixed table of 2**22 places keeps apart."""
    draw = random.Random(5)
    n = 40000
    docs = spark.range(600).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 10000), i -> cast(pmod(xxhash64(id, i), {n}) as string)), ' ') as text")
    seen = " ".join(str(draw.randrange(n)) for _ in range(2000))
    docs = docs.union(spark.createDataFrame([(-1, seen)], "doc_id long, text string"))
    rows = {r.doc_id: r.text.split() for r in docs.collect()}
    (got,) = lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(0,)], "doc_id long")).filter("doc_id = -1").collect()
    single, pair = Counter(), Counter()
    wanted = set(zip(rows[-1], rows[-1][1:], strict=False))
    for d, w in rows.items():
        if d != -1:
            single.update(w)
            pair.update(p for p in zip(w, w[1:], strict=False) if p in wanted)
    total, loss = sum(single.values()), 0.0
    for i, x in enumerate(rows[-1]):
        p = 0.95 * single[x] / total + 0.05 / (1 << 20)
        h, j = (single[rows[-1][i - 1]], pair[rows[-1][i - 1], x]) if i else (0, 0)
        loss -= math.log((j + 16 * p) / (h + 16))
    assert got.background_loss == pytest.approx(loss / len(rows[-1]), abs=1e-6)
