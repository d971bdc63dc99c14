import re

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard_join import brute as groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns over the smallest documents, each written and read again."""
    sf, top = "/root/testdata/sf0.001", tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(top / name.replace(" ", "-")))
        out[name] = docs = spark.read.parquet(str(top / name.replace(" ", "-")))
    return {k: v.collect() for k, v in out.items()}


def test_columns(stages):
    for name in ("quality rules", "near copies", "source mix"):
        assert stages[name][0].asDict().keys() == stages["documents"][0].asDict().keys()


def test_quality_rules_reject_by_rule(stages):
    from test_quality_rules import brute

    kept = {r.doc_id for r in stages["quality rules"]}
    failed = {r.doc_id for r in stages["documents"] if brute(r.text)[5]}
    assert kept == {r.doc_id for r in stages["documents"]} - failed


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages["quality rules"]]
    assert {r.doc_id for r in stages["near copies"]} == {c for _, c in groups(before, 5, 80).values()}


def test_mix_repeats_and_cuts_texts(stages):
    before = {r.doc_id: r for r in stages["near copies"]}
    words = {s: 0 for s in {r.source for r in before.values()}}
    for r in stages["source mix"]:
        assert before[r.doc_id].text.startswith(r.text) and before[r.doc_id].source == r.source
        words[r.source] += len(WORD.findall(r.text))
    assert sum(words.values()) == pytest.approx(1.5 * sum(len(WORD.findall(r.text)) for r in before.values()), rel=1e-3)


def test_packed_ids_are_those_of_the_texts(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids + [2]) for r in stages["source mix"])
    got: dict = {}
    for r in stages["packing"]:
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    flat = []
    for (doc, n), parts in got.items():
        starts = sorted({s for s, _ in parts})
        copies = sum(s == 0 for s, _ in parts)
        for c in range(copies):
            ids = [x for s in starts for x in sorted(p for t, p in parts if t == s)[c]]
            flat.append((doc, ids))
            assert len(ids) == n
    assert sorted(flat) == want
    used: dict = {}
    for r in stages["packing"]:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == len(stages["packing"])
