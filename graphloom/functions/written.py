"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it back, so that a lost executor costs a
re-read and never a recomputation from the source, and each row is computed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.shipping import own_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session has none, local runs get a new one; on a cluster, where
    every machine would have its own, that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(own_folder())
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, under the application's own name, that nothing uses yet."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as Parquet and read back: its plan starts at that table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
