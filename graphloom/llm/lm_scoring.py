"""Documents scored by cross-entropy difference between two matched n-gram models.

The target model is trained on the documents that a label table marks as good, the background model on all documents;
both have the same vocabulary, order and smoothing. A document's score is the mean over its tokens of the background
model's loss less the target model's: above 0 it is more like the target. Its own counts are left out of both models
where it was counted, else every document outside the target would look unlike it for its own rare words.

The models are interpolated bigram models over words and pairs of neighbouring words, each counted exactly under its
64-bit hash, as many as the corpus has. Documents are written once as chunks of bounded size: a list of words and the
texts as places in it. A chunk sends its distinct words and pairs, with its own counts, to buckets by ranges of the
hash; a bucket adds up its part over the corpus and answers each chunk, in the order of the chunk's keys, with what
the other chunks have; the chunk scores its documents with its own counts and the answers. No table of counts is
broadcast, and neither chunks nor buckets grow with the corpus: their numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm import kernels as K
from graphloom.llm.shared import map_arrow, materialize

#: Bytes of text of a chunk, and of the corpus for each bucket.
CHUNK, BUCKET = 1 << 23, 1 << 23
LEAST_BUCKETS = 16
#: Words that the models allow for, seen or not: each has as much of 5 % of p(w).
VOCABULARY = 1 << 20


def _planes(n: np.ndarray) -> bytes:
    """Numbers by byte planes, packed: the upper ones are mostly zeros."""
    data = np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(n).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Keys in order by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


_CHUNKS = "chunk long, bytes long, tokens long, good_tokens long, doc_id array<long>, sizes binary, good binary, words binary, places binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of documents."""
    number = TaskContext.get().partitionId() << 32
    ids, words, sizes, marks, have = [], [], [], [], 0

    def chunk() -> pa.RecordBatch:
        size, good = np.concatenate(sizes), np.concatenate(marks)
        known, places, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        # frequent words first, so that most places are small
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = (number, have, int(size.sum()), int(size[good].sum()), [x for part in ids for x in part.to_pylist()], _planes(size), good.tobytes(), _planes(known[order]), _planes(rank[places]))
        kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 4)
        return pa.record_batch([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _CHUNKS.split(", ")])

    for batch in batches:
        good = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        row = 0
        for part in K.slices(batch.column(1)):
            data, at = K.utf8(part)
            starts, ends, first = K.segment(data, at, K.SPACED)
            hashes, begin = K.hash_words(data, starts, ends), 0
            while begin < len(part):
                # as many texts as the chunk has room for, one at least
                upto = np.asarray(at[begin + 1 :]) - at[begin] + 64 * np.arange(1, len(part) - begin + 1) + have
                end = begin + max(1, int(np.searchsorted(upto, CHUNK, side="right")))
                ids.append(batch.column(0).slice(row + begin, end - begin))
                words.append(hashes[first[begin] : first[end]])
                sizes.append(np.diff(first[begin : end + 1]))
                marks.append(good[row + begin : row + end])
                have = int(upto[end - begin - 1])
                if have >= CHUNK or end < len(part):
                    yield chunk()
                    ids, words, sizes, marks, have = [], [], [], [], 0
                    number += 1
                begin = end
            row += len(part)
    if ids:
        yield chunk()


class _Chunk:
    """A chunk's texts by places in its keys: distinct words and pairs (each word with the one before it in its text, or
    with a mark of the beginning), in order."""

    def __init__(self, places: bytes, words: bytes, sizes: bytes, good: bytes):
        self.good, self.size = np.frombuffer(good, bool), _numbers(sizes).astype(np.int64)
        code, known = _numbers(places).astype(np.int64), _numbers(words)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.starts = np.zeros(len(code), bool)
        self.starts[(np.cumsum(self.size) - self.size)[self.size > 0]] = True
        self.last = np.concatenate([np.zeros(min(1, len(code)), np.int64), np.arange(len(code) - 1)])
        hashes = known[code]
        before = np.where(self.starts, np.uint64(1), hashes[self.last])
        pairs, back = np.unique(K.mix64(hashes ^ K.mix64(before)), return_inverse=True)
        keys = np.concatenate([known, pairs])
        order = np.argsort(keys, kind="stable")
        at = np.empty(len(keys), np.int64)
        at[order] = np.arange(len(keys))
        self.keys, self.word, self.pair = keys[order], at[code], at[len(known) + back]

    def counts(self, good: bool) -> np.ndarray:
        """How often each key occurs, in all texts or in the target's."""
        chosen = self.good[self.text] if good else slice(None)
        return sum(np.bincount(x[chosen], minlength=len(self.keys)) for x in (self.word, self.pair))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the keys of a chunk in order are its buckets' keys in order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words and pairs and its counts of them, a row for each bucket."""
    for batch in batches:
        for number, *row in zip(*batch.columns, strict=True):
            own = _Chunk(*(x.as_py() for x in row))
            bucket, at = np.unique(_bucket(own.keys, buckets), return_index=True)
            if not len(at):
                continue
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(own.keys)], strict=True))
            n, good = own.counts(False), own.counts(True)
            yield pa.record_batch([
                pa.array(bucket, pa.int64()), pa.array([number.as_py()] * len(bucket), pa.int64()), pa.array([_steps(own.keys[a:b]) for a, b in cuts], pa.binary()),
                pa.array([_planes(n[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(good[a:b]) for a, b in cuts], pa.binary()),
            ], names=["bucket", "chunk", "keys", "n", "good"])


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's counts over the other chunks, for each chunk in the order of its keys."""
    parts = [_keys(x.as_py()) for x in table.column("keys")]
    cuts = np.cumsum([0, *map(len, parts)])
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    del parts
    out = {"chunk": table.column("chunk"), "bucket": table.column("bucket")}
    for name in ("n", "good"):
        own = np.concatenate([_numbers(x.as_py()) for x in table.column(name)]).astype(np.int64)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, own)
        other = total[back] - own
        out[name] = pa.array([_planes(other[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
    return pa.table(out)


#: Up to so many target ids are broadcast, 8 bytes each; beyond, they are joined by shuffle.
FEW_IDS = 1 << 21


def _marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    ids = good.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct()
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.join((F.broadcast(ids) if few else ids).withColumn("good", F.lit(True)), F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "text", "good")


class Model:
    """p(w | h) = (c(h, w) + strength * p(w)) / (c(h) + strength); p(w) = 0.95 c(w) / N + 0.05 / VOCABULARY, so that a word
    that neither model has seen costs the same in both, however different their sizes."""

    def __init__(self, counts: np.ndarray, total: float, strength: float):
        """counts: of a chunk's keys, words and pairs alike; total: of all words."""
        self.counts, self.total, self.strength = counts.astype(np.float64), float(total), strength

    def loss(self, word: np.ndarray, pair: np.ndarray, before: np.ndarray, starts: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray:
        """Loss of each token in nats. before: the place of the word before it; starts: whether there is none; own: what
        the token's text itself has counted of its word, its pair, the word before and of all words."""
        single = 0.95 * (self.counts[word] - own[0]) / np.maximum(self.total - own[3], 1.0) + 0.05 / VOCABULARY
        history = np.where(starts, 0.0, self.counts[before] - own[2])
        joint = np.where(starts, 0.0, self.counts[pair] - own[1])
        return -np.log((joint + self.strength * single) / (history + self.strength))


def _own_counts(place: np.ndarray, text: np.ndarray, places: int) -> np.ndarray:
    """How often each token's place occurs in its text."""
    _, back, n = np.unique(text * places + place, return_inverse=True, return_counts=True)
    return n[back].astype(np.float64)


def _score(table: pa.Table, answers: pa.Table, totals: tuple[int, int], strength: float) -> pa.Table:
    """The scores of a chunk's documents."""
    own = _Chunk(*(table.column(c)[0].as_py() for c in ("places", "words", "sizes", "good")))
    answers = answers.sort_by("bucket")
    every, good = (np.concatenate([np.zeros(0, np.int64), *(_numbers(x.as_py()) for x in answers.column(c))]).astype(np.int64) for c in ("n", "good"))
    if len(every) != len(own.keys):
        raise ValueError("a chunk's answers don't fit its keys")
    models = Model(good + own.counts(True), totals[1], strength), Model(every + own.counts(False), totals[0], strength)
    size, text = own.size, own.text
    of_word = _own_counts(own.word, text, len(own.keys))
    mine = (of_word, _own_counts(own.pair, text, len(own.keys)), of_word[own.last], size[text].astype(np.float64))
    counted = own.good[text]
    losses = []
    for model, held in ((models[0], tuple(np.where(counted, x, 0.0) for x in mine)), (models[1], mine)):
        loss = np.bincount(text, weights=model.loss(own.word, own.pair, own.word[own.last], own.starts, held), minlength=len(size))
        losses.append(loss / np.maximum(size, 1))
    target, background = losses
    none = size == 0
    return pa.table({
        "doc_id": table.column("doc_id").combine_chunks().flatten(), "n_tokens": pa.array(size), "target_loss": pa.array(target, mask=none),
        "background_loss": pa.array(background, mask=none), "score": pa.array(background - target, mask=none),
    })


def cross_entropy_difference(docs: DataFrame, good: DataFrame, strength: float = 16.0) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs``, losses in nats a token.

    Tokens are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, of whole texts. A text without tokens has null losses and
    score; a null doc_id stays null and is in no target; repeated rows are counted and scored each; an empty table
    gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    # written once, so that both passes see the same chunks
    chunks = materialize(map_arrow(_marked(docs, good), _chunks, _CHUNKS), "chunks")
    size, *totals = (x or 0 for x in chunks.agg(F.sum("bytes"), F.sum("tokens"), F.sum("good_tokens")).first())
    buckets = max(LEAST_BUCKETS, size // BUCKET)
    texts = chunks.drop("bytes", "tokens", "good_tokens")
    sent = map_arrow(texts.select("chunk", "places", "words", "sizes", "good"), lambda it: _send(it, buckets), "bucket long, chunk long, keys binary, n binary, good binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, n binary, good binary")
    both = texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(lambda t, a: _score(t, a, totals, strength), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
