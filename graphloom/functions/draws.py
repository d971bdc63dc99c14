"""Deterministic draws: results depend on a seed and on row keys, never on partitions, order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def draw(seed: int, *keys) -> Column:
    """A uniform integer in [0, 2**32): the first 8 hex digits of md5 over the seed and the keys, joined by ':'.

    Keys are columns, column names, or plain numbers and text given as ``F.lit``.
    """
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *keys) -> Column:
    """A uniform real in [0, 1)."""
    return draw(seed, *keys) / float(RANGE)


def between(low, high, seed: int, *keys) -> Column:
    """A uniform integer from low to high, both included; low and high are numbers or columns."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + draw(seed, *keys) % (high - low + 1)).cast("int")


def draw_sql(seed: int, *keys: str) -> str:
    """The same draw as DuckDB SQL; keys are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT"


def host_draw(seed: int, *keys) -> int:
    """The same draw in plain Python, for kernels and drivers."""
    import hashlib

    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16)


def host_uniform(seed: int, *keys) -> float:
    return host_draw(seed, *keys) / RANGE


def host_between(low: int, high: int, seed: int, *keys) -> int:
    return low + host_draw(seed, *keys) % (high - low + 1)
