"""Token sequences for k-hop tasks, as (inst, i, token), and generated segments, as (inst, seg, i, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import KhopsArgs
from graphloom.functions.draws import between, draw, host_between
from graphloom.functions.kernels import map_instances
from graphloom.functions.partitions import quick_partition, shuffled, uniform_partition


def khops_instances(spark: SparkSession, batch: int, args: KhopsArgs, seed: int, first: int = 0) -> DataFrame:
    """(inst, k, length): both drawn from their ranges."""
    return khops_of(spark.range(first, first + batch).withColumnRenamed("id", "inst"), args, seed)


def khops_of(ids: DataFrame, args: KhopsArgs, seed: int) -> DataFrame:
    """The same of the instances in ``ids(inst)``."""
    return ids.select(
        "inst",
        between(args.min_khops, args.max_khops, seed, F.lit("k"), "inst").alias("k"),
        between(args.min_prefix_length, args.max_prefix_length, seed, F.lit("length"), "inst").alias("length"),
    )


def sequences(instances: DataFrame, low: int, high: int, seed: int, permutations: int = 0) -> DataFrame:
    """Tokens from low to high, none equal to its neighbour.

    The first is uniform; every other is a step of 1 to (high - low) onwards, round the range: uniform among the tokens
    that differ from the one before, without rejection, and a running sum makes it one window. With ``permutations`` the
    sequence is so many permutations of the whole range, one after another.
    """
    size = high - low + 1
    if size < 3:
        raise ValueError("at least three tokens are needed")
    if permutations:
        return _permutations(instances, low, high, seed, permutations)
    steps = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.when(i == 0, between(0, size - 1, seed, F.lit("seq"), "inst", i)).otherwise(between(1, size - 1, seed, F.lit("seq"), "inst", i)))
    sums = F.aggregate(steps, F.expr("cast(array() as array<int>)"), lambda s, x: F.concat(s, F.array(((F.coalesce(F.element_at(s, F.when(F.size(s) > 0, F.lit(-1)).otherwise(F.lit(None))), F.lit(0)) + x) % size).cast("int"))))
    return instances.select("inst", F.posexplode(sums).alias("i", "t")).select("inst", "i", (F.col("t") + low).cast("int").alias("token"))


def _permutations(instances: DataFrame, low: int, high: int, seed: int, times: int) -> DataFrame:
    size = high - low + 1
    vocab = F.sequence(F.lit(low), F.lit(high))
    one = lambda r: F.transform(F.array_sort(F.transform(vocab, lambda t: F.struct(draw(seed, F.lit("perm"), "inst", r, t).alias("d"), t.alias("t")))), lambda x: x["t"])

    def joined(s, r):
        new = one(r)
        # a permutation that begins with the token before it swaps its first two
        clash = (F.size(s) > 0) & (F.element_at(new, 1) == F.get(s, F.size(s) - 1))
        swapped = F.concat(F.array(F.element_at(new, 2), F.element_at(new, 1)), F.slice(new, 3, size))
        return F.concat(s, F.when(clash, swapped).otherwise(new))

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(times - 1)), F.expr("cast(array() as array<int>)"), joined)
    return instances.select("inst", F.posexplode(whole).alias("i", "token"))


def generated_segments(instances: DataFrame, low: int, high: int, args: KhopsArgs, seed: int) -> DataFrame:
    """(inst, seg, i, token): the prefix length of each instance is split into k parts, and each part becomes a segment of
    one more token that avoids the current value and then ends with it (in the last but one place if connected to
    the left); its neighbour at the end is the next current value. Without repeats, the values are drawn as a path of
    different tokens.
    """
    if args.no_repeats and args.max_khops + 1 > high - low + 1:
        raise ValueError("not enough tokens for a path without repeats")
    right, fresh = args.right_side_connect, args.no_repeats
    split = uniform_partition if args.partition_method == "uniform" else quick_partition

    def kernel(row: dict) -> list[dict]:
        inst, k = row["inst"], row["k"]
        parts = split(max(row["length"], k), k, seed, "split", inst)
        path = shuffled(list(range(low, high + 1)), seed, "path", inst)
        value = path[0] if fresh else host_between(low, high, seed, "value", inst)
        out = []
        for s, size in enumerate(parts):
            tokens = [host_between(low, high - 1, seed, "token", inst, s, i) for i in range(size + 1)]
            tokens = [t + (t >= value) for t in tokens]
            last = s == len(parts) - 1
            at_end = last or right
            tokens[-1 if at_end else -2] = value
            # where the next value stands: beside the current one
            beside = -2 if right else -1
            if not (last and not right):
                if fresh:
                    tokens[beside] = path[s + 1]
                value_next = tokens[beside]
            out += [{"inst": inst, "seg": s, "i": i, "token": t, "truth": value} for i, t in enumerate(tokens)]
            if not last:
                value = value_next
        return out

    return map_instances(instances, kernel, "inst long, seg int, i int, token int, truth int")
