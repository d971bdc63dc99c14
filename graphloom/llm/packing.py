"""Packing token sequences by cutting-stock column generation.

Documents are tokenised, ended by an id, and cut into pieces of at most the sequence length: whole sequences first,
then the rest. Rests are counted by length class in one distributed histogram. A linear program over patterns (how
many pieces of each class fill one sequence) is solved on the driver by column generation: a knapsack dynamic program
prices new patterns against the duals until none helps. Its size is set by the number of classes, not by the data.
Rounded down, patterns are run as often as the program says, and the few pieces left over are packed best-fit by
class. Documents are then ranked within their class (counts by part and class, added up in Spark) and the ranks are
assigned to the slots of the patterns; offsets follow from the true lengths, so that sequences have no gaps.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.shared import map_arrow, materialize

#: A class holds lengths that round up to the same multiple of seq_len / CLASSES.
CLASSES = 512


# ----------------------------------------------------------------------------------------------------- tokenisation
#: Words of printable Latin-1 characters without apostrophe: the tokenizer cuts them into runs of letters, single
#: numerals and runs of anything else, and lower-cases them character by character.
_PLAIN = re.compile(r"[\x21-\x26\x28-\x7e\xa1-\xff]+")
_RUNS = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


#: How a tokenizer file says that it lower-cases and cuts texts in this way.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_MARK = "</w>"


def _cuts_words(path: str) -> bool:
    """Whether the tokenizer drops white space, ends every word with a mark and cuts words as :class:`WordCache` does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        spec["model"].get("end_of_word_suffix") == _MARK
        and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (cut.get("type"), cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ("Split", {"Regex": _CUTS}, "Removed", True)
    )


class WordCache:
    """Ids, as little-endian unsigned 32-bit bytes, of texts. For tokenizers that end every word with a mark and drop
    white space they are kept by word between spaces and line breaks, which such a tokenizer never joins, and below that
    by run, which it never joins either. Bounded: a part that holds too much starts anew. With any other tokenizer each
    text is encoded whole."""

    def __init__(self, path: str, plain: bool = False, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # their strings in a text are then ordinary text
        self.most = most
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.by_word = _cuts_words(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_MARK)]] = True

    def fits(self, dtype: str, *ids: int) -> None:
        """An error if an id of the vocabulary, or one of ``ids``, is beyond ``dtype``."""
        if (most := max(len(self.ends) - 1, *ids)) > np.iinfo(dtype).max:
            raise ValueError(f"id {most} doesn't fit {dtype}")

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > self.most:
                self.words.clear()
                new = set(words)
            self._learn(new)
        return b"".join(map(self.words.__getitem__, words))

    def _learn(self, new: set[str]) -> None:
        plain, runs_of = _PLAIN.fullmatch, _RUNS.findall
        cut = {w: runs_of(w.lower()) for w in new if plain(w) and "<|" not in w}
        runs = set(chain.from_iterable(cut.values())).difference(self.runs)
        if len(self.runs) + len(runs) > max(self.most, 1 << 19):
            self.runs.clear()
            runs = set(chain.from_iterable(cut.values()))
        self._learn_runs(list(runs))
        get = self.runs.__getitem__
        self.words.update((w, b"".join(map(get, rs))) for w, rs in cut.items())
        whole = [w for w in new if w not in cut] if len(cut) < len(new) else []
        for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 4096):
            part = runs[i : i + 4096]
            # one text of all runs: each ends with the only id that is marked as an end
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and (not len(part) or last[-1] == len(ids)):
                data = ids.tobytes()
                at = [0, *(4 * last).tolist()]
                self.runs.update((r, data[a:b]) for r, a, b in zip(part, at, at[1:], strict=False))
            else:
                for r, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.runs[r] = np.array(e.ids, "<u4").tobytes()


_CACHES: dict[tuple[str, bool], WordCache] = {}


def cached(path: str, plain: bool = False, most: int = 1 << 20) -> WordCache:
    """The worker's cache for a tokenizer file: it lives as long as the Python worker. An entry takes some 200 bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    if (path, plain) not in _CACHES:
        _CACHES[path, plain] = WordCache(path, plain, most)
    return _CACHES[path, plain]


_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, seq_len: int, dtype: str) -> Iterator[pa.RecordBatch]:
    cache = cached(path)
    cache.fits(dtype, end_id)
    encode = cache.encode
    end = np.array([end_id], "<u4").tobytes()
    width = np.dtype(dtype).itemsize
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens")), ("ids", pa.binary())])
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            n = len(ids) // 4
            if width != 4:
                ids = np.frombuffer(ids, "<u4").astype(dtype).tobytes()
            rows += [(doc, i, min(seq_len, n - i), n, ids[width * i : width * (i + seq_len)]) for i in range(0, n, seq_len)]
            held += len(ids)
            if held > 1 << 22:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = 4096, dtype: str = "<u4") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut every ``seq_len`` ids.

    ids: the bytes of numbers of ``dtype``, little-endian unsigned 32-bit if not given; an error if the vocabulary
    doesn't fit. A null text is empty and has ``end_id`` alone; very long texts are encoded whole; a null doc_id stays
    null; repeated rows each have their pieces; an empty table gives none; other columns are ignored.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(thin, lambda it: _piece_batches(it, tokenizer, end_id, seq_len, dtype), _PIECES)


# ------------------------------------------------------------------------------------------------------- patterns
def _knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of pieces in ``room``, any number of each, and how many of each."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for w in range(1, room + 1):
        n = int(np.searchsorted(sizes, w, side="right"))
        best[w] = best[w - 1]
        if n:
            with_piece = best[w - sizes[:n]] + value[:n]
            i = int(with_piece.argmax())
            if with_piece[i] > best[w] + 1e-12:
                best[w], pick[w] = with_piece[i], i
    count = np.zeros(len(sizes), np.int64)
    w = room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            count[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return float(best[room]), count


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 4e-3, most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often to run each, so that every demand is met exactly.

    sizes ascend. The linear program is solved to within ``gap`` of its bound by column generation over a dense basis;
    patterns are then run the rounded-down number of times, and what is left is packed best-fit by decreasing size.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        dual = inverse.sum(axis=0)
        best, new = _knapsack(dual, sizes, room)
        if best <= 1 + gap:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x -= ratio[out] * step
        x[out] = ratio[out]
        columns[:, out] = new
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left = demand.astype(np.int64).copy()
    runs: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x):
        pattern = columns[:, j].round().astype(np.int64)
        used = pattern > 0
        times = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= pattern * times
            runs.append((pattern, times))
    return runs + _best_fit(sizes, left, room)


def _best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for a few pieces: again and again the fullest sequence that the pieces left can make, largest first."""
    left = left.copy()
    runs = []
    while left.any():
        pattern = np.zeros(len(sizes), np.int64)
        free = room
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), free // int(sizes[i]))
            pattern[i] = n
            free -= n * int(sizes[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        runs.append((pattern, times))
    return runs


# -------------------------------------------------------------------------------------------------------- packing
def pack(pieces: DataFrame, seq_len: int = 4096, classes: int = CLASSES, payload: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (with doc_id, start and length, 1 to ``seq_len``) with sequence_id and offset.

    Columns named in ``payload`` take no part in the planning: they stay where they were written and are joined to the
    plan once, at the end. Give wide columns so. In each sequence offsets run from 0 without gaps and lengths add up to ``seq_len`` at most. Rows that agree in
    everything are packed one by one, in either order. An empty table gives no rows.
    """
    if seq_len % classes:
        raise ValueError("classes must divide seq_len")
    spark = pieces.sparkSession
    unit = seq_len // classes
    kind = F.ceil(F.col("length") / unit).cast("int")
    whole = materialize(pieces.withColumns({"_class": kind, "_part": F.spark_partition_id(), "_piece": F.monotonically_increasing_id()}), "pieces")
    held = whole.drop(*payload)
    counts = materialize(held.groupBy("_class", "_part").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(total), np.int64)
    runs = cutting_stock(sizes, np.array([total[s] for s in sizes.tolist()], np.int64), classes)
    # (class, ranks from low to high) -> sequences from first on, times of them, one piece of the class in each in turn
    table: list[tuple[int, int, int, int, int]] = []
    seen = dict.fromkeys(total, 0)
    first = 0
    for pattern, times in runs:
        for i in np.flatnonzero(pattern):
            c = int(sizes[i])
            table.append((c, seen[c], seen[c] + int(pattern[i]) * times, first, times))
            seen[c] += int(pattern[i]) * times
        first += times
    slots = F.broadcast(spark.createDataFrame(table, "_class int, _low long, _high long, _first long, _times long"))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_class", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "length")
    ranked = held.withColumn("_rank", F.row_number().over(inside) - 1).join(base, ["_class", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(slots, "_class").filter("_rank >= _low and _rank < _high")
    placed = placed.withColumn("sequence_id", F.col("_first") + (F.col("_rank") - F.col("_low")) % F.col("_times"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    placed = placed.withColumn("offset", offset)
    if payload:
        placed = placed.join(whole.select("_piece", *payload), "_piece")
    return placed.select(*pieces.columns, "sequence_id", "offset")
