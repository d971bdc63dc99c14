"""Vectorised text kernels for Arrow batches: words of whole texts, their hashes and hashes of word runs.

All work on the UTF-8 bytes of a whole batch at once. A word class is a table of 256 booleans; every byte of a
non-ASCII code point has the same class, so byte classes and code point classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd, so its powers never vanish
_BLOCK = 1 << 18

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for texts whose A-Z are lower-cased: the same as a-z, A-Z, 0-9 and non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x + _GOLD).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix64(_FOLD.astype(np.uint64)) | np.uint64(1)  # by byte, A-Z as a-z
_VALUE_AS_IS = mix64(np.arange(256, dtype=np.uint64)) | np.uint64(1)


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts). A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of a text column of about ``most`` bytes, one text at least: the kernels' memory is a multiple
    of a part, whatever the size of a batch."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, side="right")))
        yield texts.slice(i, j - i)
        i = j


def segment(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]  # a text's first byte never continues a word
    edge[first] = inside[first]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    edge[last] = inside[last]
    return starts, np.flatnonzero(edge) + 1, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``fold`` A-Z hash as a-z. Works block by block in bounded memory."""
    out = np.empty(len(starts), np.uint64)
    value = _VALUE if fold else _VALUE_AS_IS
    power = np.ones(1, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK)))
        s, e = starts[i:j], ends[i:j]
        size = e - s
        if (longest := int(size.max())) > len(power):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest - 1, _STEP)]), dtype=np.uint64)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = value[data[np.repeat(s, size) + place]] * power[place]
        out[i:j] = mix64(np.add.reduceat(terms, first) + size.astype(np.uint64) * _GOLD)
        i = j
    return out


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` neighbouring words, by its first word (runs may cross texts: cut by text later)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix64(total ^ words[i : i + n])
    return total


def whole(words: np.ndarray) -> int:
    """One hash of a whole sequence of words, of whatever length."""
    total = np.uint64(len(words))
    for w in words:
        total = mix64(np.array([total ^ w]))[0]
    return int(total)
