"""Tables written to storage that driver and executors share, to be read more than once."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_path(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; a temporary one in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to storage that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{purpose}-{uuid.uuid4().hex}")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that what uses it twice computes it once."""
    path = staging_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
