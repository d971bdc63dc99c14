import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 49407


def test_documents_table_and_odd_texts(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a <|endoftext|> b<|startoftext|>"), (-4, "x\n\ny  z"), (-5, "word " * 3000), (-6, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int").repartition(3)
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    for block in (50, 1 << 18):
        assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs, PATH, END, block=block).collect()} == want
    assert T.count_tokens(docs.limit(0), PATH, END).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_stitching_equals_a_plain_split(spark, block):
    draw = random.Random(block)
    files, want = [], []
    for f in range(6):
        ids = [draw.choice([0, 0, 1, 2, 3, 4]) for _ in range(draw.choice([0, 1, 5, 60]))]
        files += [(f, b, np.array(ids[i : i + block], "<u2").tobytes()) for b, i in enumerate(range(0, max(1, len(ids)), block))]
        size = done = 0
        for x in ids:
            size += x != 0
            if x == 0:
                want.append((f, done, size, True))
                size, done = 0, done + 1
        if size:
            want.append((f, done, size, False))
    blocks = spark.createDataFrame(files, "file long, block long, ids binary")
    assert sorted(map(tuple, T.separator_scan(blocks, 0).collect())) == sorted(want)


def test_raw_files(spark, tmp_path):
    ids = np.array([5, 6, 0, 7, 0, 0, 8, 9, 9, 9, 0, 1], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    out = T.separator_scan(T.read_flat_files(spark, str(tmp_path), block=4), 0).collect()
    assert sorted((r.ordinal, r.n_tokens, r.complete) for r in out) == [(0, 2, True), (1, 1, True), (2, 0, True), (3, 4, True), (4, 1, False)]
