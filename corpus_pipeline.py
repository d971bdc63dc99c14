"""Training corpus from raw documents: quality rules, near copies, source mix, packed sequences.

Each stage works on all that the one before kept, as a table written in between.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard_join, packing, quality_rules, source_mix
from graphloom.functions.written import delete, fresh_path
from graphloom.llm.shared import recorded

#: Tables that the last stage over a folder has written in between.
_BETWEEN: dict[str, list[str]] = {}


def stage(function):
    """A stage reads only what the one before has written: what that one wrote in between, over the same folder, can go."""

    @wraps(function)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _BETWEEN.setdefault(sf_dir, [])
        while paths:
            delete(spark, paths.pop())
        with recorded(paths):
            return function(spark, docs, sf_dir)

    return run_alone


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that recur across the documents of their source."""
    return quality_rules.apply_quality_rules(docs)


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents repeat as often as the mix takes them."""
    return source_mix.mix_sources(docs).select(docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, two bytes an id, with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), dtype="<u2"), payload=("ids",))


STAGES = [("quality rules", keep_quality), ("near copies", keep_one_of_each), ("source mix", mix), ("packing", pack)]

#: Tokenising and the packing program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
