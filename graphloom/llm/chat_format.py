"""Conversations as training text: one rendering, one encoding with offsets, and a loss mask by intersecting spans.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn; its three marks are added tokens, so that
no token reaches over a boundary between mark and text. Control strings inside roles and texts get a backslash behind
their first character, and those that already have backslashes there get one more; taking one away restores the text.
A conversation is rendered whole and encoded once; the spans of its assistant texts, in order, are intersected with
the sorted spans of tokens by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import map_arrow

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates, escaped wherever they stand in a role or text.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The whole conversation, and the spans of assistant texts in it."""
    parts: list[str] = []
    spans = []
    at = 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (starts and ends sorted) lie in the spans (sorted, disjoint): for each span the first token that
    ends behind its start and the first that starts at its end or later, both by binary search."""
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.maximum(first, last), -1)
    return np.cumsum(step[:-1]) > 0


@cache
def _tokenizer(path: str):
    """The worker's tokenizer for a file: it lives as long as the Python worker, and starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.add_special_tokens([START, SEP, END])
    return found


_SCHEMA = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def _format_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    number = pa.list_(pa.int32())
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            turns = [[(t["role"] or "", t["text"] or "") for t in sorted(c, key=lambda t: (t["turn"] is not None, t["turn"] or 0))] for c in part.column(1).to_pylist()]
            whole = [render(t) for t in turns]
            ids, starts, ends, loss = [], [], [], []
            for text, spans in whole:
                e = tokenizer.encode(text, add_special_tokens=False)
                at = np.array(e.offsets, np.int64).reshape(-1, 2)
                ids.append(e.ids)
                starts.append(at[:, 0])
                ends.append(at[:, 1])
                loss.append(loss_mask(at[:, 0], at[:, 1], spans))
            yield pa.record_batch({
                "conv_id": part.column(0).cast(pa.int64()), "formatted": pa.array([w for w, _ in whole], pa.string()),
                "ids": pa.array(ids, number), "starts": pa.array(starts, number), "ends": pa.array(ends, number), "loss": pa.array(loss, pa.list_(pa.bool_())),
            })


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss) for each conversation of ``turns(conv_id, turn, role, text)``.

    starts and ends: each token's span in formatted, in code points; loss: whether the token is assistant text. Turns
    go by number, null first, then by role and text; repeated turns stay. Null roles and texts are empty; rows
    without conv_id make one conversation. Other columns are ignored; an empty table gives no rows. A conversation is
    one training sample and so one row, however many turns it has.
    """
    whole = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"),
    )
    whole = whole.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return map_arrow(whole, lambda it: _format_batches(it, tokenizer), _SCHEMA)


def under_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text whose tokens are under the mask."""
    out: list[list[int]] = []
    for a, b in zip(starts[loss].tolist(), ends[loss].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [formatted[a:b] for a, b in out]


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")}
        for i in range(batch.num_rows):
            formatted, starts, ends, loss = (batch.column(c)[i] for c in ("formatted", "starts", "ends", "loss"))
            formatted = formatted.as_py()
            turns = read_back(formatted)
            at = [x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, loss)]
            text = "".join(unescape(x) for x in under_loss(formatted, *at))
            rows["n_turns"].append(len(turns))
            rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            rows["loss_chars"].append(len(text))
            rows["loss_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            rows["formatted_chars"].append(len(formatted))
            rows["n_tokens"].append(len(at[0]))
        yield pa.record_batch([batch.column("conv_id"), *map(pa.array, rows.values())], names=["conv_id", *rows])


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation says when read back from its text, token spans and mask."""
    return map_arrow(formatted, _digest_batches, _DIGEST)
