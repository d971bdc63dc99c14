import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join
from graphloom.llm.shared import materialize, recorded
from test_jaccard_join import SCHEMA, brute, varied


def files(path):
    return sorted(p.name for p in Path(re.sub("^file:", "", path)).iterdir())


def parts(path):
    return [x for x in files(path) if x.startswith("part-")]


def test_a_file_each_without_a_second_one(spark):
    """Hadoop starts a process for each file on a local disk."""
    with recorded(paths := []):
        out = materialize(spark.range(0, 1000, numPartitions=8), "many")
    assert len(files(paths[0])) == 8 + 1 and "_SUCCESS" in files(paths[0])
    assert sorted(r.id for r in out.collect()) == [*range(1000)]


def test_few_rows_of_many_tasks_are_one_file(spark):
    with recorded(paths := []):
        out = materialize(spark.range(0, 1000, numPartitions=40), "few", gather=True)
        none = materialize(spark.range(0, 1000, numPartitions=40).filter("id < 0"), "none", gather=True)
    assert len(parts(paths[0])) == 1
    assert sorted(r.id for r in out.collect()) == [*range(1000)]
    assert none.collect() == [] and none.dtypes == out.dtypes


def test_damage_is_an_error(spark):
    with recorded(paths := []):
        out = materialize(spark.range(0, 5000, numPartitions=1).select(F.hash("id").alias("x")), "damaged")
    path = Path(re.sub("^file:", "", paths[0])) / parts(paths[0])[0]
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc|corrupt"):
        out.agg(F.sum("x")).collect()


def test_near_copies_in_few_files(spark, monkeypatch):
    """What tables of many files are joined to doesn't take as many files again."""
    rows = varied(5)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(12)
    own = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "12"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        with recorded(paths := []):
            left = jaccard_join.keep_one(docs, k=5, percent=80).select("doc_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    named = [(re.sub("-[0-9a-f]{32}$", "", p.rsplit("/", 1)[1]), len(parts(p))) for p in paths]
    gathered = [x for x in named if x[0] in ("entries", "near", "wanted", "links", "groups", "copies")]
    assert len(gathered) == 8 and all(n <= 1 for _, n in gathered), named
    assert sorted(r.doc_id for r in left) == sorted({c for _, c in brute(rows, 5, 80).values()})
