"""Incremental upserts from a stream of events, by micro-batch, that a restart takes up again.

Late events must apply, so no watermark drops them: each micro-batch is merged into a
versioned snapshot, whose newest parts are the result. The snapshot's state lies beside it: every
batch writes the parts that it touches as its own version and then, last, a commit that names
them. A run that starts again reads the commits, and the stream's own checkpoint tells it where
to go on. A batch that is replayed reads what was committed before it and writes the same
version again, whether its commit was there or not.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.staging import staging_path

COMMITS = "part int, version long"


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last event in ``order``."""
    last = F.max(F.struct(*order, *[c for c in events.columns if c not in keys + order]))
    return events.groupBy(*keys).agg(last.alias("x")).select(*keys, "x.*")


def versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The newest committed version of each part, or the newest before a batch."""
    path = posixpath.join(root, "commits")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return {}
    commits = spark.read.schema(COMMITS).json(posixpath.join(path, "batch=*"))
    commits = commits if before is None else commits.where(F.col("version") < before)
    return {r.part: r.version for r in commits.groupBy("part").agg(F.max("version").alias("version")).collect()}  # as many as parts


def snapshot(spark: SparkSession, root: str, schema) -> DataFrame:
    """The state after the last commit."""
    paths = [posixpath.join(root, f"version={v}", f"part={p}") for p, v in sorted(versions(spark, root).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replay(spark: SparkSession, path: str, keys: list[str], order: list[str], files_a_batch: int = 1, parts: int = 64, root: str | None = None) -> DataFrame:
    """The latest event of each key after all files at ``path`` that are there by now.

    The path is read as a pattern, so that a single file will do as well as a folder. The
    snapshot lies in ``parts`` by the hash of the key, and a batch rewrites those that it
    touches. With the same ``root`` a later call takes new files only.
    """
    schema = spark.read.parquet(path).schema
    base = root or staging_path(spark, "replay")
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    kept = latest(spark.createDataFrame([], schema), keys, order).schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r.part for r in batch.select(part.alias("part")).distinct().collect()]  # ``parts`` at most
        if not touched:
            return
        known = versions(spark, base, number)
        paths = [posixpath.join(base, f"version={known[p]}", f"part={p}") for p in touched if p in known]
        new = spark.read.schema(kept).parquet(*paths).select(*batch.columns).unionByName(batch) if paths else batch
        target = posixpath.join(base, f"version={number}")
        latest(new, keys, order).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(target)
        commit = spark.range(1).select(F.explode(F.array(*map(F.lit, touched))).alias("part"), F.lit(number).cast("long").alias("version"))
        commit.coalesce(1).write.mode("overwrite").json(posixpath.join(base, "commits", f"batch={number}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path}*")
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", posixpath.join(base, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshot(spark, base, kept)
