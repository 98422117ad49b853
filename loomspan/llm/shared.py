"""Places that every executor sees, and tables written there to cut lineage."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    Where a session in local mode has no such setting (tests, a laptop) a temporary folder
    takes its place; a cluster must set it to storage that driver and executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to storage that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{purpose}-{uuid.uuid4().hex}")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, whatever its size seems to be.

    Ids and hashes take many times the bytes of their compressed files in memory, where
    the driver would hold each table that Spark takes for small enough to broadcast.
    """
    return df.hint("merge")


def table(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Downstream work restarts from files, so a lost executor costs a task and not the
    chain of stages before it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
