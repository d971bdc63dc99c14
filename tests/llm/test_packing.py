import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm.queries import op6_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "Hello  World\n\tit's", "<|endoftext|> a<|startoftext|>", "ΟΔΟΣ ΟΔΟΣ\nİstanbul é ́x", "x" * 20000, "1234 567 don't we'll", "a\r\nb\x0bc d e 　", "日本語 テキスト 🙂🙂"]


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, seq_len=4096):
    """Each id in exactly one piece, sequences gapless and within their length; the share of padding."""
    tokens = {}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        ids = tokens[d] = whole(texts[d])
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return 1 - sum(map(len, tokens.values())) / (seq_len * len(by_sequence))


def test_documents_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op6_packing(spark, sf).collect(), texts) < 0.03


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    pieces = packing.token_pieces(docs, PATH)
    from pyspark.sql import functions as F

    check(packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids"))).collect(), dict(enumerate(ODD)))
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0
    for r in packing.pack(packing.token_pieces(docs, PATH, dtype="<u2"), payload=("ids",)).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == whole(ODD[r.doc_id])[r.start : r.start + r.length]


def test_cutting_stock_meets_demand_with_little_waste():
    draw = random.Random(3)
    sizes = np.array(sorted(draw.sample(range(3, 400), 60)))
    demand = np.array([draw.randrange(1, 3000) for _ in sizes])
    runs = packing.cutting_stock(sizes, demand, 512)
    assert (sum(p * n for p, n in runs) == demand).all()
    assert all(int(p @ sizes) <= 512 for p, _ in runs)
    used = sum(n for _, n in runs)
    assert used * 512 <= 1.01 * int(sizes @ demand)
    assert packing.cutting_stock(np.zeros(0, int), np.zeros(0, int), 512) == []
    assert sum(n for _, n in packing.cutting_stock(np.array([512]), np.array([7]), 512)) == 7


def test_knapsack_is_exact():
    draw = random.Random(1)
    for _ in range(20):
        sizes = np.array(sorted(draw.sample(range(1, 30), 5)))
        value = np.array([draw.random() for _ in sizes])
        best = [0.0] * 61
        for w in range(1, 61):
            best[w] = max([best[w - 1], *(best[w - s] + v for s, v in zip(sizes, value, strict=True) if s <= w)])
        found, count = packing._knapsack(value, sizes, 60)
        assert abs(found - best[60]) < 1e-9 and abs(count @ value - found) < 1e-9 and count @ sizes <= 60


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, cache = Tokenizer.from_file(path), packing.WordCache(path)
    assert packing.WordCache(PATH).by_word and not cache.by_word
    for text in ODD:
        assert np.frombuffer(cache.encode(text or ""), "<u4").tolist() == own.encode(text or "", add_special_tokens=False).ids


def test_ids_that_do_not_fit_are_an_error():
    cache = packing.WordCache(PATH)
    cache.fits("<u2", 2)
    for dtype, end in (("<u1", 2), ("<u2", 1 << 16)):
        try:
            cache.fits(dtype, end)
        except ValueError:
            continue
        raise AssertionError(dtype)


def test_repeated_rows_and_rows_without_id(spark):
    texts = ["a b c", "a b c", None, ""]
    docs = spark.createDataFrame([(d, t) for d, t in zip([1, 1, None, None], texts)], "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(docs, PATH)).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 4), (False, 4), (True, 1), (True, 1)]
    assert sum(r.length for r in rows) == max(r.offset + r.length for r in rows)
