"""Upserts, chunk state, ledgers and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import TOKENS_A_WORD, chunks, content_hash, words_of_squeezed


def classified(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, action): created, skipped if the content hash is the same, else updated."""
    new = incoming.select("doc_id", content_hash(F.col("text")).alias("new"))
    old = current.select("doc_id", content_hash(F.col("text")).alias("old"))
    action = F.when(F.col("old").isNull(), "created").when(F.col("old") == F.col("new"), "skipped").otherwise("updated")
    return new.join(old, "doc_id", "left").select("doc_id", action.alias("action"))


def upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The snapshot after an upsert: rows that change are replaced, new ones added."""
    changed = classified(incoming, current).where("action <> 'skipped'").select("doc_id")
    return current.join(changed, "doc_id", "left_anti").unionByName(incoming.join(changed, "doc_id", "left_semi"))


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text, token_estimate)."""
    out = docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text"))
    tokens = F.ceil(words_of_squeezed(F.col("text")) * TOKENS_A_WORD).cast("long")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", tokens.alias("token_estimate"))


def counters(actions: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(F.count("*").alias("seen"), count("created"), count("updated"), count("skipped"))


def stale(state: DataFrame) -> DataFrame:
    """Chunks not yet indexed, or without a vector."""
    return state.where(~F.col("indexed") | ~F.col("embedded"))


def completeness(state: DataFrame) -> DataFrame:
    """(doc_id, chunk_count, complete): complete once no chunk is left to index."""
    return state.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.bool_and("indexed").alias("complete"))


def integrity(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(check, n): counts that a finished pass over the corpus is held to."""
    counts = state.agg(F.count("*").alias("chunks"), F.count_if("indexed").alias("indexed"), F.count_if(~F.col("embedded")).alias("unembedded"))
    chunkless = docs.join(state, "doc_id", "left_anti").agg(F.count("*").alias("without_chunks"))
    wide = docs.agg(F.count("*").alias("documents")).join(counts).join(chunkless)
    return wide.unpivot([], ["documents", "chunks", "indexed", "unembedded", "without_chunks"], "check", "n")


def fixture(docs: DataFrame, labelled: DataFrame, others: int) -> DataFrame:
    """(doc_id, labelled): every labelled document and the first ``others`` of the rest by id."""
    keys = docs.select("doc_id").distinct()
    marked = labelled.select("doc_id").distinct()
    some = keys.join(marked, "doc_id", "left_anti").orderBy("doc_id").limit(others)
    return keys.join(marked, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(some.withColumn("labelled", F.lit(False)))


def rechunked(state: DataFrame, incoming: DataFrame, changed: DataFrame, model: str) -> DataFrame:
    """The chunk state after documents changed: their old chunks go, new ones come unindexed.

    ``state`` and the result: (doc_id, chunk_index, text, model, indexed, was_split).
    """
    new = chunk_table(incoming.join(changed, "doc_id", "left_semi"))
    sizes = new.groupBy("doc_id").agg((F.count("*") > 1).alias("was_split"))
    new = new.join(sizes, "doc_id").select("doc_id", "chunk_index", "text", F.lit(model).alias("model"), F.lit(False).alias("indexed"), "was_split")
    return state.join(changed, "doc_id", "left_anti").unionByName(new.select(*state.columns))


def vanished(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys (doc_id, chunk_index) of an index that the chunks no longer have."""
    return before.select("doc_id", "chunk_index").join(after, ["doc_id", "chunk_index"], "left_anti")


def run_counters(actions: DataFrame, state: DataFrame) -> DataFrame:
    """One row of a run: documents by action, and the chunks and split documents it wrote."""
    wrote = actions.where("action <> 'skipped'").select("doc_id")
    chunks = state.join(wrote, "doc_id", "left_semi").agg(F.count("*").alias("chunks"), F.count_if(F.col("was_split") & (F.col("chunk_index") == 0)).alias("split"))
    return counters(actions).crossJoin(F.broadcast(chunks))  # a row each


def ledger(events: DataFrame, most: int = 20) -> DataFrame:
    """(run, status, seen, failed, watermark, errors) of runs' events (run, at, item, error).

    A run without errors succeeded, and only then has a watermark; the first ``most`` errors
    are kept, a line each.
    """
    from pyspark.sql import Window

    bad = F.col("error").isNotNull()
    nth = F.row_number().over(Window.partitionBy("run").orderBy("item"))
    lines = events.where(bad).withColumn("nth", nth).where(F.col("nth") <= most).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("nth", "error"))).alias("e"))
    totals = events.groupBy("run").agg(F.count("*").alias("seen"), F.count_if(bad).alias("failed"), F.max("at").alias("last"))
    out = totals.join(lines, "run", "left")
    text = F.coalesce(F.array_join(F.transform("e", lambda x: x["error"]), "\n"), F.lit(""))
    return out.select("run", F.when(F.col("failed") == 0, "success").otherwise("failed").alias("status"), "seen", "failed", F.when(F.col("failed") == 0, F.col("last")).alias("watermark"), text.alias("errors"))


def watermarks(runs: DataFrame) -> DataFrame:
    """(categories, watermark) of the latest successful run (categories, started, run, status, watermark) of each exact set."""
    good = runs.where((F.col("status") == "success") & F.col("watermark").isNotNull())
    return good.groupBy("categories").agg(F.max_by("watermark", F.struct("started", "run")).alias("watermark"))


def vector_problems(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, problem) of vectors that an index would refuse."""
    v = F.col("embedding")
    bad = F.when(v.isNull(), "missing").when(F.size(v) != width, "width").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "component")
    return vectors.select("vec_id", bad.alias("problem")).where("problem is not null")
