"""Random partitions of an integer into a given number of parts, and their exact counts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.draws import host_between, host_draw


@lru_cache(maxsize=1 << 16)
def count(total: int, parts: int, most: int) -> int:
    """Partitions of ``total`` into exactly ``parts`` parts of at most ``most`` each; exact, of any size."""
    if parts == 0:
        return int(total == 0)
    if total < parts or total > parts * most:
        return 0
    # the largest part is below most, or one part is most
    return count(total, parts, most - 1) + count(total - most, parts - 1, most)


def set_cache_size(entries: int) -> None:
    """Bounds the memory of the counts; they start anew."""
    global count
    count = lru_cache(maxsize=entries)(count.__wrapped__)


def table(largest: int) -> list[list[int]]:
    """p[q][n]: partitions of q into exactly n parts, for all q and n up to ``largest``, bottom up."""
    p = [[0] * (largest + 1) for _ in range(largest + 1)]
    p[0][0] = 1
    for q in range(1, largest + 1):
        for n in range(1, q + 1):
            p[q][n] = p[q - 1][n - 1] + (p[q - n][n] if q >= n else 0)
    return p


def counts_table(spark: SparkSession, largest: int) -> DataFrame:
    """(total, parts, n) as text, for counts pass any integer type; the table has largest**2 / 2 rows by its parameter."""
    return spark.createDataFrame([(q, n, str(c)) for q, row in enumerate(table(largest)) for n, c in enumerate(row) if c], "total int, parts int, n string")


def uniform_partition(total: int, parts: int, seed: int, *key, shuffle: bool = True) -> list[int]:
    """A partition drawn uniformly among all, in a drawn order (or largest first)."""
    if not 1 <= parts <= total:
        raise ValueError(f"{total} has no partition into {parts} parts")
    _warm(total, parts)
    every = count(total, parts, total - parts + 1)
    bits = 0
    for i in range(1 + every.bit_length() // 32 + 2):
        bits = (bits << 32) | host_draw(seed, *key, "which", i)
    which = bits % every
    out: list[int] = []
    most = total - parts + 1
    while parts:
        # partitions in order of their largest part: those below k come before those with k
        low, high = -(-total // parts), most
        while low < high:
            k = (low + high) // 2
            if count(total, parts, k) > which:
                high = k
            else:
                low = k + 1
        which -= count(total, parts, low - 1)
        out.append(low)
        total, parts, most = total - low, parts - 1, low
    return shuffled(out, seed, *key) if shuffle else out


def _warm(total: int, parts: int) -> None:
    """Fills the cache from below, so that the recursion stays shallow."""
    for most in range(1, total - parts + 2, 200):
        count(total, parts, most)


def quick_partition(total: int, parts: int, seed: int, *key, shuffle: bool = True) -> list[int]:
    """A partition that isn't uniform but needs no counts: each part in turn takes a drawn share of what is left."""
    if not 1 <= parts <= total:
        raise ValueError(f"{total} has no partition into {parts} parts")
    left = total - parts
    out = []
    for i in range(parts - 1):
        more = host_between(0, left, seed, *key, "part", i)
        out.append(1 + more)
        left -= more
    out.append(1 + left)
    return shuffled(out, seed, *key) if shuffle else sorted(out)


def shuffled(items: list, seed: int, *key) -> list:
    return [x for _, _, x in sorted((host_draw(seed, *key, "order", i), i, x) for i, x in enumerate(items))]
