"""Papers, chunks and vectors as tables bucketed by document, so that what is stored stays where it is.

An ingest deals what comes in to the buckets of the stored papers and merges both in one pass.
The pass writes the papers' next version and counts, as it writes, what it has seen, created,
updated, skipped and refused: the ledger row is made of these counts, not of a second reading.
Chunks of changed papers are replaced bucket by bucket. The content hash is kept with the paper,
so that no stored text is hashed again. A version counts once the ledger names it.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import abstract_of, content_hash, title_of
from loomspan.operators.ingest import chunk_table

LEDGER = "version long, started timestamp, status string, seen long, created long, updated long, skipped long, failed long, chunks long, errors string"
ACTIONS = ("created", "updated", "skipped", "failed")


def refusal(text: Column) -> Column:
    """Why a paper can't be kept, or null."""
    return F.when(text.isNull(), "no text").when(title_of(text) == "", "no title").when(abstract_of(text) == "", "no abstract")


@dataclass(frozen=True)
class Store:
    """A version of the tables below ``root``; ``buckets`` should be as many as an ingest has tasks."""

    spark: SparkSession
    root: str
    buckets: int
    version: int = -1

    # tables

    def _name(self, table: str, version: int) -> str:
        return f"loomspan_{table}_{uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex}_{version}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table, self.version))

    def _write(self, rows: DataFrame, table: str, version: int) -> None:
        """A version of a table; what a stopped run has left of it is replaced."""
        path = posixpath.join(self.root, table, f"version={version}")
        rows.write.mode("overwrite").bucketBy(self.buckets, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(self._name(table, version))

    # ingesting

    def merged(self, incoming: DataFrame) -> DataFrame:
        """Stored and incoming papers (doc_id, text) with what becomes of them: (doc_id, text, content_hash, action, error)."""
        new = incoming.repartition(self.buckets, "doc_id").select("doc_id", F.col("text").alias("new"), content_hash(F.col("text")).alias("new_hash"), refusal(F.col("text")).alias("error"), F.lit(True).alias("came"))
        if self.version < 0:
            both = new.withColumns({"text": F.lit(None).cast("string"), "content_hash": F.lit(None).cast("string"), "known": F.lit(False)})
        else:
            both = self.table("papers").select("doc_id", "text", "content_hash", F.lit(True).alias("known")).join(new, "doc_id", "full")
        came, known = F.coalesce("came", F.lit(False)), F.coalesce("known", F.lit(False))
        same = F.col("content_hash") == F.col("new_hash")
        action = F.when(~came, "kept").when(F.col("error").isNotNull(), "failed").when(~known, "created").when(same, "skipped").otherwise("updated")
        both = both.withColumn("action", action)
        takes = F.col("action").isin("created", "updated")
        return both.select("doc_id", F.when(takes, F.col("new")).otherwise(F.col("text")).alias("text"), F.when(takes, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"), "action", "error")

    def ingest(self, incoming: DataFrame, errors: int = 20) -> "Store":
        """The store after an upsert of papers; refused ones leave what is stored, and the run failed."""
        version = self.version + 1
        counts = Observation()
        of = lambda a: F.count_if(F.col("action") == a).alias(a)
        started = self.spark.sql("SELECT current_timestamp() AS t").first().t
        merged = self.merged(incoming).observe(counts, F.count_if(F.col("action") != "kept").alias("seen"), *map(of, ACTIONS))
        self._write(merged, "merged", version)
        whole = self.spark.table(self._name("merged", version))
        self._write(whole.where("text is not null").select("doc_id", "text", "content_hash", F.col("action").isin("created", "updated").alias("changed")), "papers", version)
        out = replace(self, version=version)
        changed = out.table("papers").where("changed")
        made = Observation()
        new = chunk_table(changed).observe(made, F.count("*").alias("chunks"))
        old = self.table("chunks").join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(new) if self.version >= 0 else new
        self._write(old, "chunks", version)
        got, n = counts.get, made.get["chunks"]
        lines = whole.where("action = 'failed'").orderBy("doc_id").limit(errors).select(F.concat("doc_id", F.lit(": "), "error").alias("line")).collect()
        status = "failed" if got["failed"] else "success"
        row = (version, started, status, got["seen"], *(got[a] for a in ACTIONS), n, "\n".join(r.line for r in lines))
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").json(posixpath.join(self.root, "ledger", f"version={version}"))
        return out

    def ledger(self) -> DataFrame:
        """A row for each run that was finished."""
        return self.spark.read.schema(LEDGER).json(posixpath.join(self.root, "ledger", "version=*"))

    # vectors

    def store_vectors(self, vectors: DataFrame, width: int) -> None:
        """Vectors (doc_id, chunk_index, vector) beside their chunks; one that the width doesn't fit fails the write."""
        told = F.concat(F.lit("vector of "), F.coalesce(F.size("vector"), F.lit(0)).cast("string"), F.lit(f" instead of {width} numbers: "), F.concat_ws("#", "doc_id", "chunk_index"))
        good = F.col("vector").isNotNull() & (F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
        checked = vectors.select("doc_id", "chunk_index", F.when(good, F.col("vector")).otherwise(F.raise_error(told)).alias("vector"))
        self._write(checked.repartition(self.buckets, "doc_id"), "vectors", self.version)

    def unembedded(self) -> DataFrame:
        """(doc_id, chunk_index) of chunks without a vector, bucket by bucket."""
        have = self.table("vectors").groupBy("doc_id").agg(F.collect_set("chunk_index").alias("have"))
        chunks = self.table("chunks").join(have, "doc_id", "left")
        return chunks.where(~F.coalesce(F.array_contains("have", F.col("chunk_index")), F.lit(False))).select("doc_id", "chunk_index")
