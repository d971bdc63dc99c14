"""Leak-free splits: instances are known by a hash of what they say, and training keeps clear of held-out hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many held-out hashes are broadcast, some 60 bytes each; beyond, they are joined by shuffle.
FEW_HASHES = 1 << 18


def distance_hashes(packaged: DataFrame) -> DataFrame:
    """(inst, hash) of distances by vocabulary id: md5 over ``src,dst,d`` in order, so that equal graphs told in any order
    under the same ids are equal, and no two digits run together."""
    cell = F.concat_ws(",", F.col("src_tok").cast("string"), F.col("dst_tok").cast("string"), F.col("d").cast("string"))
    own = packaged.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("src_tok", "dst_tok", cell.alias("c")))).alias("s"))
    return own.select("inst", F.md5(F.array_join(F.col("s.c"), ";")).alias("hash"))


def token_hashes(instances: DataFrame) -> DataFrame:
    """(inst, hash) of token rows."""
    flat = F.array_join(F.transform(F.flatten("src_tokens"), lambda x: x.cast("string")), ",")
    return instances.select("inst", F.md5(flat).alias("hash"))


def text_hashes(table: DataFrame, key: str, text: str) -> DataFrame:
    """(inst, hash) of texts."""
    return table.select(F.col(key).cast("long").alias("inst"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hash"))


def split_sizes(split_hashes: DataFrame) -> DataFrame:
    """(split, n): different hashes of each split."""
    return split_hashes.groupBy("split").agg(F.countDistinct("hash").alias("n"))


def marked(hashes: DataFrame, split_hashes: DataFrame) -> DataFrame:
    """hashes with in_validation, in_test and is_invalid (in either), from split_hashes(split, hash)."""
    own = split_hashes.groupBy("hash").agg(F.max(F.col("split") == "valid").alias("in_validation"), F.max(F.col("split") == "test").alias("in_test"))
    few = own.limit(FEW_HASHES + 1).count() <= FEW_HASHES if not hashes.isStreaming else True
    out = hashes.join(F.broadcast(own) if few else own, "hash", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("in_validation", "in_test")}
    return out.withColumns(flags).withColumn("is_invalid", F.col("in_validation") | F.col("in_test"))


def decontaminated(instances: DataFrame, hashes: DataFrame, split_hashes: DataFrame) -> DataFrame:
    """instances whose hash no split has."""
    clear = hashes.join(split_hashes.select("hash").distinct(), "hash", "left_anti").select("inst")
    return instances.join(clear, "inst", "left_semi")


def first_of_each(hashes: DataFrame, size: int) -> DataFrame:
    """The first ``size`` different hashes by instance: a held-out set as (inst, hash)."""
    own = hashes.groupBy("hash").agg(F.min("inst").alias("inst"))
    return own.orderBy("inst").limit(size).select("inst", "hash")
