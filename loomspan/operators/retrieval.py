"""Lexical and dense retrieval for a table of queries at once, ranking and fusion.

Queries are (item_id, text), documents (doc_id, text), ranked lists (item_id, doc_id,
score, rank). Blank queries have no hits. Lexical search reads a stored index, or makes one of
the documents it is given. Dense scores are block products:
packed blocks of rows meet packed blocks of queries in a grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import SPACES
from loomspan.operators.cells import usable
from loomspan.operators.lexicon import PLAIN, Analysis, Index
from loomspan.sources.staging import staging_path

DEPTH, TOP_K, RRF_K = 50, 10, 60
BUCKETS = 384
#: Rows and queries at most of a cell of the grid, and those that travel as one row.
CELL_ROWS, CELL_QUERIES, PACKED = 32_768, 16_384, 256
#: Put before a query, but not before a document, ahead of embedding.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def ranked(scored: DataFrame, depth: int, by: str = "item_id", digits: int = 6) -> DataFrame:
    """Ranks from 1 within ``by``, by rounded score, ties to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    rounded = scored.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).withColumn("rank", F.col("rank").cast("long"))


def asked_for(queries: DataFrame) -> DataFrame:
    """The queries that aren't blank."""
    return queries.where(F.regexp_replace("text", SPACES, "") != "")


def indexed(docs: DataFrame | Index, analysis: Analysis = PLAIN) -> Index:
    """An index as it is, or one of documents (doc_id, text, and chunk if there are parts)."""
    return docs if isinstance(docs, Index) else Index.build(docs, staging_path(docs.sparkSession, "index"), analysis)


def bm25(queries: DataFrame, docs: DataFrame | Index, depth: int = DEPTH) -> DataFrame:
    """(item_id, doc_id, score, rank): the sum over a query's distinct terms."""
    return ranked(indexed(docs).search(queries, depth).select("item_id", "doc_id", "score"), depth)


def bm25_parts(queries: DataFrame, parts: DataFrame | Index, depth: int = DEPTH) -> DataFrame:
    """(item_id, doc_id, chunk_index, score, rank) of parts (doc_id, chunk, text)."""
    found = indexed(parts).search(queries, depth).select("item_id", F.struct("doc_id", "chunk").alias("doc_id"), "score")
    return ranked(found, depth).select("item_id", "doc_id.doc_id", F.col("doc_id.chunk").cast("long").alias("chunk_index"), "score", "rank")


def bm25_best_fields(queries: DataFrame, fields: dict[str, tuple[DataFrame | Index, float]], depth: int = DEPTH) -> DataFrame:
    """The best field's boosted score, with its name; equal scores name the first.

    What is among the best by its best field is among the best of that field, so each field
    sends its best only.
    """
    scored = [
        indexed(docs).search(queries, depth).select("item_id", F.struct("doc_id", "chunk").alias("doc_id"), (F.col("score") * boost).alias("score"), F.lit(name).alias("field"))
        for name, (docs, boost) in fields.items()
    ]
    every = reduce(DataFrame.unionByName, scored)
    best = every.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("field", F.struct(-F.round("score", 6), "field")).alias("best_field"))
    return ranked(best, depth).select("item_id", "doc_id.doc_id", F.col("doc_id.chunk").cast("long").alias("chunk_index"), "score", "best_field", "rank")


def hash_embedding(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, bucket, weight): signed hashed words, of unit length; sparse.

    A text whose words cancel out, or that has none, points along bucket 0.
    """
    words = F.filter(F.split(F.lower(F.col(text)), SPACES + "+"), lambda w: w != "")
    h = F.sha2("w", 256)
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % BUCKETS).alias("bucket")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = df.select(key, F.explode(words).alias("w")).groupBy(key, bucket).agg(F.sum(sign).cast("double").alias("s")).where("s <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    some = sums.join(norms, key).select(key, "bucket", (F.col("s") / F.col("norm")).alias("weight"))
    none = df.select(key).join(norms, key, "left_anti").select(key, F.lit(0).cast("long").alias("bucket"), F.lit(1.0).alias("weight"))
    return some.unionByName(none)


_places: dict[str, tuple[int, int]] = {}


def _place(word: str) -> tuple[int, int]:
    """A word's bucket and sign."""
    if word not in _places:
        if len(_places) > 500_000:
            _places.clear()
        h = hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()
        _places[word] = (int(h[:8], 16) % BUCKETS, 1 if int(h[8:10], 16) % 2 == 0 else -1)
    return _places[word]


def embedded(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, v): the hashed embedding as the bytes of ``BUCKETS`` doubles."""

    @F.pandas_udf("binary")
    def vector(words: pd.Series) -> pd.Series:
        out = []
        for own in words:
            v = np.zeros(BUCKETS)
            if len(own):
                at, sign = zip(*map(_place, own))
                np.add.at(v, np.array(at), sign)
            norm = np.sqrt(v @ v)
            if norm:
                v /= norm
            else:
                v[0] = 1.0
            out.append(v.tobytes())
        return pd.Series(out, dtype=object)

    words = F.filter(F.split(F.lower(F.col(text)), SPACES + "+"), lambda w: w != "")
    return df.select(F.col(key).alias("id"), vector(F.coalesce(words, F.array().cast("array<string>"))).alias("v"))


def embedding_arrays(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, vector): the hashed embedding as an array of ``BUCKETS`` doubles."""

    @F.pandas_udf("array<double>")
    def opened(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.frombuffer(x, np.float64))

    return embedded(df.select(F.struct(*keys).alias("key"), text), "key", text).select(*[F.col(f"id.{k}").alias(k) for k in keys], opened("v").alias("vector"))


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of up to ``PACKED`` (id, v): no, ids and v as arrays."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), PACKED):
                part = batch.iloc[i : i + PACKED]
                yield pd.DataFrame({"ids": [part["id"].tolist()], "v": [part["v"].tolist()]})

    return rows.mapInPandas(pack, f"ids array<{kind}>, v array<binary>")


def top_products(queries: DataFrame, rows: DataFrame, depth: int, digits: int = 6, but_own: bool = False) -> DataFrame:
    """(item_id, doc_id, score): of each query (id, v) the largest products with rows (id, v).

    Blocks of both meet in a grid, whose cells each keep ``depth`` of every query, so that no
    task holds more than a cell and no pair of rows leaves one unranked.
    """
    kinds = [dict(df.dtypes)["id"] for df in (queries, rows)]
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    n = rows.count()
    down = max(1, -(-n // max(PACKED, min(CELL_ROWS, n // tasks))))
    across = max(1, -(-queries.count() // CELL_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    left = _packed(rows, kinds[1]).withColumn("down", dealt(down)).withColumn("across", every(across))
    right = _packed(queries, kinds[0]).withColumn("across", dealt(across)).withColumn("down", every(down))

    def opened(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(part["ids"].tolist()), np.frombuffer(b"".join([v for row in part["v"] for v in row]), np.float64)

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            (ids, x), (items, q) = opened(rows), opened(asked)
            x, q = x.reshape(len(ids), -1), q.reshape(len(items), -1)
            for i in range(0, len(items), 512):
                for item, scores in zip(items[i : i + 512], np.round(q[i : i + 512] @ x.T, digits)):
                    if but_own:
                        scores[ids == item] = -np.inf
                    if len(ids) > depth:
                        pick = np.flatnonzero(scores >= np.partition(scores, -depth)[-depth])
                    else:
                        pick = np.arange(len(ids))
                    pick = pick[np.lexsort((ids[pick], -scores[pick]))][:depth]
                    pick = pick[scores[pick] > -np.inf]
                    out.append(pd.DataFrame({"item_id": item, "doc_id": ids[pick], "score": scores[pick]}))
        return pd.concat(out) if out else pd.DataFrame({"item_id": [], "doc_id": [], "score": []})

    grid = left.groupBy("down", "across").cogroup(right.groupBy("down", "across"))
    return grid.applyInPandas(best, f"item_id {kinds[0]}, doc_id {kinds[1]}, score double")


def dense(queries: DataFrame, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    asked = asked_for(queries).select("item_id", F.concat(F.lit(QUERY_PREFIX), "text").alias("text"))
    return ranked(top_products(embedded(asked, "item_id"), embedded(docs, "doc_id"), depth), depth)


def collapsed(chunk_hits: DataFrame, top_k: int) -> DataFrame:
    """Chunk hits (item_id, doc_id, chunk_index, score, rank) to documents.

    Each keeps its best chunk; ``extra_hits`` counts its others, null if there are none.
    """
    best = chunk_hits.groupBy("item_id", "doc_id").agg(F.min(F.struct("rank", "chunk_index", "score")).alias("b"), (F.count("*") - 1).alias("x"))
    order = Window.partitionBy("item_id").orderBy("old")
    out = best.select("item_id", "doc_id", F.col("b.chunk_index").alias("best_chunk"), F.nullif("x", F.lit(0)).alias("extra_hits"), F.col("b.rank").alias("old"))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).drop("old").where(F.col("rank") <= top_k)


def fused(runs: dict[str, DataFrame], k: int = RRF_K, top_k: int | None = TOP_K) -> DataFrame:
    """Reciprocal rank fusion; of each run rank, score and contribution stay, as ``<run>_rank`` etc.

    ``k`` below 0 is refused, and so are ranks below 1, which would overweight the top.
    """
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    every = reduce(DataFrame.unionByName, [df.select("item_id", "doc_id", "rank", F.col("score") if "score" in df.columns else F.lit(None).cast("double").alias("score"), F.lit(name).alias("run")) for name, df in runs.items()])
    of = lambda name, c: F.min(F.when(F.col("run") == name, c))
    ranks = [of(name, F.col(c)).alias(f"{name}_{c}") for name in runs for c in ("rank", "score")]
    ranks += [of(name, 1 / (k + F.col("rank"))).alias(f"{name}_contribution") for name in runs]
    share = F.when(F.col("rank") < 1, F.raise_error(F.lit("ranks begin at 1"))).otherwise(1 / (k + F.col("rank")))
    merged = every.groupBy("item_id", "doc_id").agg(F.sum(share).alias("score"), *ranks)
    return ranked(merged, top_k or 1 << 30, digits=9)


def hydrated(hits: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Hits that still have a document, with its columns, ranked anew in their order."""
    order = Window.partitionBy("item_id").orderBy("old")
    found = hits.withColumnRenamed("rank", "old").join(docs.select("doc_id", *columns), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).drop("old")


def knn(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """Exact cosine neighbours of each ``every``-th vector: (query_id, vec_id, similarity, rank).

    Vectors of another length than most have none; null, zero and non-finite ones neither.
    """
    rows = vectors.where(usable(F.col("embedding")))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    rows = rows.where(F.size("embedding") == (width.width if width else 0))

    @F.pandas_udf("binary")
    def unit(vectors: pd.Series) -> pd.Series:
        x = vectors.map(lambda v: np.asarray(v, np.float64))
        return x.map(lambda v: (v / np.sqrt(v @ v)).tobytes())

    rows = rows.select(F.col("vec_id").alias("id"), unit("embedding").alias("v"))
    scored = top_products(rows.where(F.col("id") % every == 0), rows, k, but_own=True)
    return ranked(scored, k).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("vec_id"), F.col("score").alias("similarity"), "rank")


def hybrid(runs: dict[str, DataFrame | None], k: int = RRF_K, top_k: int | None = TOP_K, tolerate_failure: bool = True) -> DataFrame:
    """Fusion of the runs that there are; ``failed`` names those that are missing (None).

    ``degraded`` tells whether any is. Without a run, or with one missing if that isn't
    tolerated, there is no result but an error.
    """
    present = {name: df for name, df in runs.items() if df is not None}
    failed = [name for name in runs if name not in present]
    if not present:
        raise ValueError("no run to fuse")
    if failed and not tolerate_failure:
        raise ValueError(f"failed: {', '.join(failed)}")
    return fused(present, k, top_k).withColumn("degraded", F.lit(bool(failed))).withColumn("failed", F.lit(",".join(failed)))


def passages(hits: DataFrame, docs: DataFrame, n: int = 5, chars: int = 2000) -> DataFrame:
    """(item_id, number, doc_id, passage): the first ``n`` hits that have a document, numbered from 1."""
    found = hydrated(hits.where(F.col("rank") <= n), docs, ["text"])
    return found.select("item_id", F.col("rank").alias("number"), "doc_id", F.substring("text", 1, chars).alias("passage"))


def prompts(numbered: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, prompt): numbered passages, then the question."""
    line = F.concat(F.lit("["), "number", F.lit("] "), "passage")
    lines = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    body = numbered.groupBy("item_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("body"))
    return body.join(queries, "item_id").select("item_id", F.concat("body", F.lit("\n\nQuestion: "), "text").alias("prompt"))


MODES, LONGEST_QUERY, MOST_RESULTS = ("bm25", "dense", "hybrid"), 512, 50


def requests(asked: DataFrame) -> DataFrame:
    """Requests (query, mode, top_k), trimmed and with defaults filled in, and ``error``: the first rule they break."""
    query = F.coalesce(F.regexp_replace("query", f"^{SPACES}+|{SPACES}+$", ""), F.lit(""))
    error = (
        F.when(F.col("query") == "", "blank query")
        .when(F.char_length("query") > LONGEST_QUERY, "long query")
        .when(~F.col("mode").isin(*MODES), "unknown mode")
        .when(~F.col("top_k").between(1, MOST_RESULTS), "top_k")
    )
    out = asked.withColumn("query", query).withColumn("error", error)
    return out.withColumn("mode", F.coalesce("mode", F.lit("hybrid"))).withColumn("top_k", F.coalesce("top_k", F.lit(TOP_K)))


def envelopes(queries: DataFrame, hits: DataFrame, docs: DataFrame, mode: str, top_k: int) -> DataFrame:
    """One answer a query: its settings, the number of hits that have a document, and their ids."""
    found = hydrated(hits, docs, [])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    lists = found.groupBy("item_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))
    failed = hits.agg(F.coalesce(F.max("failed"), F.lit("")).alias("failed"))
    out = queries.select("item_id").join(lists, "item_id", "left").crossJoin(F.broadcast(failed))  # one row
    settings = {"mode": F.lit(mode), "top_k": F.lit(top_k), "rrf_k": F.lit(RRF_K), "fusion_depth": F.lit(DEPTH)}
    return out.withColumns(settings | {"n": F.coalesce("n", F.lit(0)).cast("long"), "ids": F.coalesce("ids", F.lit(""))})
