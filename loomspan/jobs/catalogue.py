"""The registered queries of the reference's own operators, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import evaluation as E
from loomspan.operators import ingest as I
from loomspan.operators import retrieval as R
from loomspan.operators.cells import VectorIndex
from loomspan.operators.lexicon import PLAIN, Analysis, Index
from loomspan.sources.tables import feed_entries, page, read
from loomspan.sources.staging import staged, staging_path
from loomspan.streaming.replay import replay

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: k values of the fusion sweep.
SWEEP = (0, 1, 5, 10, 20, 60, 120)

APART = "regexp_replace({0}, '([\\p{{Han}}\\p{{Hiragana}}])', ' \\1 ', 'g')"
TOK = f"regexp_extract_all(lower({APART.format('text')}), '{T.WORD}')"
SQUEEZE = "trim(regexp_replace({0}, '" + T.SPACES + "+', ' ', 'g'))"
TITLE = SQUEEZE.format("split_part({0}, chr(10), 1)")
ABSTRACT = SQUEEZE.format("CASE WHEN instr({0}, chr(10)) > 0 THEN substr({0}, instr({0}, chr(10)) + 1) ELSE '' END")
HASH = f"sha256(concat({TITLE}, chr(10), chr(10), {ABSTRACT}))"


def _embed_sql(name: str, key: str, source: str) -> str:
    return f"""
{name}_w AS (SELECT {key} AS k, w FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '{T.SPACES}+')) AS w FROM {source}) WHERE w <> ''),
{name}_s AS (SELECT k, CAST(concat('0x', substr(sha256(w), 1, 8)) AS BIGINT) % {R.BUCKETS} AS bucket,
  sum(CASE WHEN CAST(concat('0x', substr(sha256(w), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM {name}_w GROUP BY 1, 2 HAVING s <> 0),
{name}_n AS (SELECT k, sqrt(sum(s * s)) AS norm FROM {name}_s GROUP BY 1),
{name} AS (SELECT k, bucket, CAST(s AS DOUBLE) / norm AS weight FROM {name}_s JOIN {name}_n USING (k)
  UNION ALL SELECT {key}, 0, 1.0 FROM {source} WHERE {key} NOT IN (SELECT k FROM {name}_n))"""


def _rank_sql(name: str, source: str, depth: int, by: str = "item_id") -> str:
    return f"""
{name} AS (SELECT {by}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {depth})"""


BM = f"""
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2),
lens AS (SELECT doc_id, len({TOK}) AS dl FROM documents),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
asked AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
bm_s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), corp GROUP BY 1, 2),{_rank_sql("bm", "bm_s", R.DEPTH)}"""
DN = f"""
prefixed AS (SELECT item_id, concat('{R.QUERY_PREFIX}', text) AS text FROM benchmark WHERE trim(text) <> ''),{_embed_sql("de", "doc_id", "documents")},{_embed_sql("qe", "item_id", "prefixed")},
dn_s AS (SELECT b.item_id, d.doc_id, round(coalesce(s, 0), 6) AS score FROM prefixed b CROSS JOIN documents d LEFT JOIN (SELECT qe.k AS item_id, de.k AS doc_id, sum(qe.weight * de.weight) AS s FROM qe JOIN de USING (bucket) GROUP BY 1, 2) x ON x.item_id = b.item_id AND x.doc_id = d.doc_id),{_rank_sql("dn", "dn_s", R.DEPTH)}"""


def _fuse_sql(name: str, k: str, depth: int, extra: str = "") -> str:
    return f"""
{name}_s AS (SELECT item_id, doc_id, round(sum(1.0 / ({k} + rank)), 9) AS score, min(CASE WHEN run = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN run = 'dense' THEN rank END) AS dense_rank{extra}
  FROM (SELECT item_id, doc_id, rank, 'bm25' AS run FROM bm UNION ALL SELECT item_id, doc_id, rank, 'dense' FROM dn) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {depth})"""


HY = _fuse_sql("hy", str(R.RRF_K), R.TOP_K)
TRUTH = """
truth AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
RUNS = """
runs AS (SELECT 'bm25' AS mode, item_id, doc_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'dense', item_id, doc_id, rank FROM dn WHERE rank <= 10 UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM hy)"""


def _metric_sql(runs: str = "runs") -> str:
    ideal = lambda k: f"list_sum([1.0 / log2(i + 1) FOR i IN range(1, least(n_rel, {k}) + 1)])"
    cols = [f"round(count(*) FILTER (rank <= {k}) / n_rel, 6) AS recall_{k}, round(count(*) FILTER (rank <= {k}) / {k}, 6) AS precision_{k}, round(coalesce(sum(1.0 / log2(rank + 1)) FILTER (rank <= {k}), 0) / {ideal(k)}, 6) AS ndcg_{k}" for k in E.KS]
    return f"""
n_rel AS (SELECT item_id, count(*) AS n_rel FROM truth GROUP BY 1),
hits AS (SELECT mode, item_id, rank FROM {runs} JOIN truth USING (item_id, doc_id)),
scored AS (SELECT m.mode, r.item_id, {", ".join(cols)}, round(coalesce(1.0 / min(rank) FILTER (rank <= 10), 0), 6) AS mrr
  FROM (SELECT DISTINCT mode FROM {runs}) m CROSS JOIN n_rel r LEFT JOIN hits h ON h.mode = m.mode AND h.item_id = r.item_id GROUP BY 1, 2, n_rel)"""


ALL = ",".join([BM, DN, HY, TRUTH, RUNS, _metric_sql()])

WORDS = "len(string_split({0}, ' '))"
#: Sentences of squeezed text s: split between an end mark and a capital or digit.
SENTENCES = "[x FOR x IN string_split(regexp_replace(s, '([.!?])\\s+([A-Z0-9])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)) IF trim(x) <> '']"
#: Chunks [a, b] of sentences, found by walking over them; start is the open chunk's first.
CHUNKS = f"""
sq AS (SELECT *, CAST(ceil(CASE WHEN s = '' THEN 0 ELSE {WORDS.format('s')} END * 1.7::DOUBLE) AS BIGINT) AS t FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)),
sen AS (SELECT doc_id, unnest(parts) AS sentence, CAST(generate_subscripts(parts, 1) AS BIGINT) AS i FROM (SELECT doc_id, {SENTENCES} AS parts FROM sq WHERE t > {T.CHUNK_TOKENS})),
pre AS (SELECT *, CAST(sum({WORDS.format('sentence')}) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto, {WORDS.format('sentence')} AS own FROM sen),
walk AS (SELECT doc_id, i, i AS start, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM pre WHERE i = 1 UNION ALL
  SELECT doc_id, i, CASE WHEN full_up AND i - start > 1 THEN i - 1 WHEN full_up THEN i ELSE start END, CASE WHEN full_up THEN start END, CASE WHEN full_up THEN i - 1 END
  FROM (SELECT w.doc_id, n.i, w.start, ceil((n.upto - f.upto + f.own) * 1.7::DOUBLE) > {T.CHUNK_TOKENS} AS full_up FROM walk w JOIN pre n ON n.doc_id = w.doc_id AND n.i = w.i + 1 JOIN pre f ON f.doc_id = w.doc_id AND f.i = w.start)),
spans AS (SELECT doc_id, a, b FROM walk WHERE a IS NOT NULL UNION ALL SELECT doc_id, last(start ORDER BY i), max(i) FROM walk GROUP BY 1),
chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS chunk_index, text FROM (SELECT s.doc_id, s.a, s.b, string_agg(p.sentence, ' ' ORDER BY p.i) AS text FROM spans s JOIN pre p ON p.doc_id = s.doc_id AND p.i BETWEEN s.a AND s.b GROUP BY 1, 2, 3)
  UNION ALL SELECT doc_id, 0, s FROM sq WHERE t <= {T.CHUNK_TOKENS}),
chunk_state AS (SELECT doc_id, chunk_index, doc_id % 3 <> 0 OR chunk_index = 0 AS indexed, (doc_id + chunk_index) % 5 <> 0 AS embedded FROM chunked)"""


def registered(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


# text

@registered(f"SELECT doc_id, CAST(CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS BIGINT) AS n_words, CAST(length(s) AS BIGINT) AS norm_len FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)")
def sc1_normalise(spark, sf_dir):
    s = T.squeezed(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", T.n_words(F.col("text")).alias("n_words"), F.char_length(s).cast("long").alias("norm_len"))


@registered(f"SELECT doc_id, {HASH.format('text')} AS content_hash FROM documents")
def sc4_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@registered(f"SELECT content_hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS min_doc_id FROM (SELECT doc_id, {HASH.format('text')} AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def sc4_duplicate_groups(spark, sf_dir):
    return sc4_content_hash(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_doc_id")).where("n > 1")


@registered(f"SELECT doc_id, t AS token_estimate, t > {T.CHUNK_TOKENS} AS needs_split FROM (SELECT doc_id, CAST(ceil(CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END * 1.7::DOUBLE) AS BIGINT) AS t FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents))")
def sc6_token_estimate(spark, sf_dir):
    t = T.token_estimate(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("token_estimate"), (t > T.CHUNK_TOKENS).alias("needs_split"))


@registered(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, CAST(ceil(CASE WHEN text = '' THEN 0 ELSE {WORDS.format('text')} END * 1.7::DOUBLE) AS BIGINT) AS token_estimate, md5(text) AS text_md5 FROM chunked")
def sc8_chunks(spark, sf_dir):
    out = I.chunk_table(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_index", "token_estimate", F.md5("text").alias("text_md5"))


@registered(f"SELECT doc_id, CAST(len({SENTENCES}) AS BIGINT) AS n_sentences FROM (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)")
def sc7_sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@registered("SELECT page_id, coalesce(nullif(regexp_extract(name, '^(.+)v[0-9]+$', 1), ''), name) AS base, coalesce(TRY_CAST(nullif(regexp_extract(name, '^.+v([0-9]+)$', 1), '') AS BIGINT), 1) AS version FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE concat(url, 'v', page_id % 5 + 1) END AS name FROM pages)")
def sc2_versions(spark, sf_dir):
    page_id = F.col("page_id")
    name = F.when(page_id % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("v"), (page_id % 5 + 1).cast("string")))
    return read(spark, sf_dir, "pages").select("page_id", T.versioned(name).alias("v")).select("page_id", "v.base", "v.version")


@registered(f"SELECT doc_id, substr({TITLE.format('text')}, 1, 70) AS title, substr({HASH.format('text')}, 1, 12) AS short_hash FROM documents WHERE source IN ('src0', 'src3', 'src5', 'src8') AND contains(lower(text), 'licen')")
def flt15_browse(spark, sf_dir):
    found = read(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src3", "src5", "src8") & F.contains(F.lower("text"), F.lit("licen")))
    return found.select("doc_id", F.substring(T.title_of(F.col("text")), 1, 70).alias("title"), F.substring(T.content_hash(F.col("text")), 1, 12).alias("short_hash"))


@registered("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE concat(regexp_replace(substr(text, 1, 300), ' [^ ]*$', ''), '...') END AS snippet FROM documents")
def prj2_snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@registered(f"WITH {_embed_sql('e', 'doc_id', 'documents')} SELECT k AS doc_id, bucket, round(weight, 6) AS weight FROM e")
def em1_hash_embed(spark, sf_dir):
    return R.hash_embedding(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@registered("SELECT page_id, title, coalesce(nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), ''), 'und') AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM (SELECT *, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages) WHERE title <> ''")
def src7_feed_entry(spark, sf_dir):
    return feed_entries(read(spark, sf_dir, "pages"))


@registered("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def src14_page_listing(spark, sf_dir):
    return page(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 3)


# retrieval

_INDEXES: dict[tuple[str, str, str], tuple[int, Index]] = {}


def stored_index(spark, sf_dir, name: str = "text", texts: Callable[[DataFrame], DataFrame] | None = None, analysis: Analysis = PLAIN) -> Index:
    """The session's index of ``documents``, or of what ``texts`` makes of them, while their files are the same."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.bit_xor(F.xxhash64("*"))).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if _INDEXES.get(key, (None,))[0] != state:
        _INDEXES[key] = state, Index.build(texts(docs) if texts else docs.select("doc_id", "text"), staging_path(spark, f"index-{name}"), analysis)
    return _INDEXES[key][1]


def lexical(spark, sf_dir):
    return R.bm25(read(spark, sf_dir, "benchmark"), stored_index(spark, sf_dir))


def relevant_documents(spark, sf_dir):
    """(item_id, doc_id) of documents that hold the item's text."""
    return E.containing(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), stored_index(spark, sf_dir))


def dense_hits(spark, sf_dir):
    return R.dense(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


def both_fused(spark, sf_dir, **more):
    return R.fused({"bm25": lexical(spark, sf_dir), "dense": dense_hits(spark, sf_dir)}, **more)


@registered(f"SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def ag21_corpus_stats(spark, sf_dir):
    return stored_index(spark, sf_dir).vocabulary()


@registered(f"WITH {BM} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def rt1_bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).where("rank <= 10")


def _field_sql(name: str, expr: str, boost: float) -> str:
    return f"""
{name}_d AS (SELECT doc_id, {expr.format('text')} AS text FROM documents),
{name}_p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM {name}_d) GROUP BY 1, 2),
{name}_l AS (SELECT doc_id, len({TOK}) AS dl FROM {name}_d),
{name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name} AS (SELECT item_id, doc_id, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS score, '{name}' AS field
  FROM asked JOIN {name}_p USING (term) JOIN {name}_f USING (term) JOIN {name}_l USING (doc_id), {name}_c GROUP BY 1, 2)"""


@registered(f"WITH asked AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),{_field_sql('title', TITLE, 2.0)},{_field_sql('abstract', ABSTRACT, 1.0)}, best AS (SELECT item_id, doc_id, round(max(score), 6) AS score, first(field ORDER BY round(score, 6) DESC, field) AS best_field FROM (SELECT * FROM title UNION ALL SELECT * FROM abstract) GROUP BY 1, 2) SELECT item_id, doc_id, score, best_field, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 10")
def rt1_bm25_best_fields(spark, sf_dir):
    of = {"title": T.title_of, "abstract": T.abstract_of}
    index = {name: stored_index(spark, sf_dir, name, lambda docs, f=f: docs.select("doc_id", f(F.col("text")).alias("text"))) for name, f in of.items()}
    fields = {"title": (index["title"], 2.0), "abstract": (index["abstract"], 1.0)}
    return R.bm25_best_fields(read(spark, sf_dir, "benchmark"), fields, 10).select("item_id", "doc_id", "score", "best_field", "rank")


@registered(f"WITH {DN} SELECT item_id, doc_id, score AS similarity, rank FROM dn WHERE rank <= 10")
def rt3_dense_hash(spark, sf_dir):
    return dense_hits(spark, sf_dir).where("rank <= 10").select("item_id", "doc_id", F.col("score").alias("similarity"), "rank")


@registered("WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def rt4_knn_exact(spark, sf_dir):
    return R.knn(read(spark, sf_dir, "embeddings"), 50, 10)


@registered("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.label IN (1, 4, 7) AND v.vec_id <> q.vec_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def rt4_knn_filtered(spark, sf_dir):
    """Neighbours among the rows of three labels, through cells; the filter runs where rows are read."""
    vectors = read(spark, sf_dir, "embeddings")
    index = VectorIndex.build(vectors, staging_path(spark, "vectors"), keep=("label",))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = index.search(asked, 10, F.col("label").isin(1, 4, 7), but_own=True)
    hits = found.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    return R.ranked(hits, 10).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("vec_id"), F.col("score").alias("similarity"), "rank")


@registered(f"WITH {BM},{DN},{HY} SELECT item_id, doc_id, score, rank, bm25_rank, dense_rank FROM hy")
def rt6_rrf_fusion(spark, sf_dir):
    return both_fused(spark, sf_dir).select("item_id", "doc_id", "score", "rank", "bm25_rank", "dense_rank")


@registered(f"WITH {BM} SELECT item_id, doc_id, rank, true AS degraded FROM bm WHERE rank <= {R.TOP_K}")
def rt7_hybrid_degraded(spark, sf_dir):
    return R.hybrid({"bm25": lexical(spark, sf_dir), "dense": None}).select("item_id", "doc_id", "rank", "degraded")


_PASSAGES = "passages AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS number, doc_id, substr(text, 1, 2000) AS passage FROM bm JOIN documents USING (doc_id) WHERE rank <= 5)"


@registered(f"WITH {BM}, {_PASSAGES} SELECT item_id, number, doc_id, md5(passage) AS passage_md5 FROM passages")
def an1_passages(spark, sf_dir):
    found = R.passages(lexical(spark, sf_dir), read(spark, sf_dir, "documents"))
    return found.select("item_id", "number", "doc_id", F.md5("passage").alias("passage_md5"))


@registered(f"WITH {BM}, {_PASSAGES}, body AS (SELECT item_id, string_agg(concat('[', number, '] ', passage), concat(chr(10), chr(10)) ORDER BY number) AS body FROM passages GROUP BY 1) SELECT item_id, md5(concat(body, chr(10), chr(10), 'Question: ', text)) AS prompt_md5 FROM body JOIN benchmark USING (item_id)")
def sc14_prompts(spark, sf_dir):
    found = R.passages(lexical(spark, sf_dir), read(spark, sf_dir, "documents"))
    return R.prompts(found, read(spark, sf_dir, "benchmark")).select("item_id", F.md5("prompt").alias("prompt_md5"))


@registered(f"WITH {BM},{DN},{TRUTH}, ks AS (SELECT unnest([{', '.join(map(str, SWEEP))}]) AS k), s AS (SELECT k, item_id, doc_id, round(sum(1.0 / (k + rank)), 9) AS score FROM (SELECT * FROM bm UNION ALL SELECT * FROM dn), ks GROUP BY 1, 2, 3), runs AS (SELECT k AS mode, item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10),{_metric_sql()} SELECT CAST(mode AS BIGINT) AS k, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr FROM scored GROUP BY 1")
def rt9_rrf_k_sweep(spark, sf_dir):
    lists = lexical(spark, sf_dir).unionByName(dense_hits(spark, sf_dir))
    every = lists.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in SWEEP])))
    s = every.groupBy("k", "item_id", "doc_id").agg(F.sum(1 / (F.col("k") + F.col("rank"))).alias("score"))
    runs = R.ranked(s.withColumn("by", F.struct("k", "item_id")), 10, "by", 9).withColumnRenamed("k", "mode")
    scored = E.scores(runs, relevant_documents(spark, sf_dir))
    return E.averages(scored, ["mode"], ["recall_10", "ndcg_10", "mrr"]).withColumnRenamed("mode", "k")


@registered(f"WITH {BM},{DN} SELECT item_id, doc_id, CAST(min(rank) AS BIGINT) AS best_rank FROM (SELECT * FROM bm WHERE rank <= 12 UNION ALL SELECT * FROM dn WHERE rank <= 12) GROUP BY 1, 2")
def rt10_pool(spark, sf_dir):
    both = lexical(spark, sf_dir).unionByName(dense_hits(spark, sf_dir)).where("rank <= 12")
    return both.groupBy("item_id", "doc_id").agg(F.min("rank").alias("best_rank"))


@registered(f"WITH {BM},{DN} SELECT item_id, CAST(count(d.doc_id) AS BIGINT) AS overlap FROM bm b LEFT JOIN (SELECT * FROM dn WHERE rank <= 3) d USING (item_id, doc_id) WHERE b.rank <= 3 GROUP BY 1")
def st2_mode_overlap(spark, sf_dir):
    top = [df.where("rank <= 3").groupBy("item_id").agg(F.collect_set("doc_id").alias(n)) for n, df in (("b", lexical(spark, sf_dir)), ("d", dense_hits(spark, sf_dir)))]
    both = top[0].join(top[1], "item_id", "left")
    return both.select("item_id", F.coalesce(F.size(F.array_intersect("b", F.coalesce("d", F.array().cast("array<bigint>")))), F.lit(0)).cast("long").alias("overlap"))


@registered(f"WITH {BM} SELECT item_id, doc_id, lang, source, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 10 AND source <> 'src0'")
def prj5_hydrate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("source <> 'src0'")
    return R.hydrated(lexical(spark, sf_dir).where("rank <= 10"), docs, ["lang", "source"]).select("item_id", "doc_id", "lang", "source", "rank")


_CHUNK_HITS = f"""
asked AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
keyed AS (SELECT doc_id * 1000000 + chunk_index AS key, doc_id, chunk_index, text FROM chunked),
ck_p AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({TOK}) AS term FROM keyed) GROUP BY 1, 2),
ck_l AS (SELECT key, len({TOK}) AS dl FROM keyed),
ck_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ck_l),
ck_f AS (SELECT term, count(*) AS df FROM ck_p GROUP BY 1),
ck_s AS (SELECT item_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM asked JOIN ck_p USING (term) JOIN ck_f USING (term) JOIN ck_l USING (key), ck_c GROUP BY 1, 2),
ck_r AS (SELECT item_id, doc_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS rank FROM ck_s JOIN keyed USING (key)),
best AS (SELECT item_id, doc_id, first(chunk_index ORDER BY rank) AS best_chunk, nullif(count(*) - 1, 0) AS extra_hits, min(rank) AS first_rank FROM ck_r WHERE rank <= {R.DEPTH} GROUP BY 1, 2)"""


@registered(f"WITH RECURSIVE {CHUNKS},{_CHUNK_HITS} SELECT * FROM (SELECT item_id, doc_id, best_chunk, CAST(extra_hits AS BIGINT) AS extra_hits, row_number() OVER (PARTITION BY item_id ORDER BY first_rank) AS rank FROM best) WHERE rank <= {R.TOP_K}")
def wn3_collapse_chunks(spark, sf_dir):
    index = stored_index(spark, sf_dir, "chunks", lambda docs: I.chunk_table(docs).withColumnRenamed("chunk_index", "chunk"))
    hits = R.bm25_parts(read(spark, sf_dir, "benchmark"), index)
    return R.collapsed(hits, R.TOP_K)


@registered(f"WITH RECURSIVE {CHUNKS},{_CHUNK_HITS.replace(f'rank <= {R.DEPTH}', 'rank <= 20')} SELECT * FROM (SELECT item_id, doc_id, best_chunk, row_number() OVER (PARTITION BY item_id ORDER BY first_rank) AS rank FROM best) WHERE rank <= 4")
def tk8_overfetch(spark, sf_dir):
    """Five times as many chunks as documents are asked for, collapsed and cut."""
    index = stored_index(spark, sf_dir, "chunks", lambda docs: I.chunk_table(docs).withColumnRenamed("chunk_index", "chunk"))
    return R.collapsed(R.bm25_parts(read(spark, sf_dir, "benchmark"), index, 5 * 4), 4).drop("extra_hits")


# evaluation

def all_scores(spark, sf_dir):
    b, d = staged(lexical(spark, sf_dir), "bm25"), staged(dense_hits(spark, sf_dir), "dense")
    runs = {"bm25": b.where("rank <= 10"), "dense": d.where("rank <= 10"), "hybrid": R.fused({"bm25": b, "dense": d})}
    every = None
    for name, df in runs.items():
        one = df.select(F.lit(name).alias("mode"), "item_id", "doc_id", "rank")
        every = one if every is None else every.unionByName(one)
    every, truth = staged(every, "runs"), relevant_documents(spark, sf_dir)
    return staged(E.scores(every, staged(truth, "truth")), "scores")


@registered(f"WITH {ALL} SELECT * FROM scored")
def ev5_score_query(spark, sf_dir):
    return all_scores(spark, sf_dir)


@registered(f"WITH {TRUTH} SELECT * FROM truth")
def ev6_relevance(spark, sf_dir):
    return relevant_documents(spark, sf_dir)


@registered(f"WITH {BM},{TRUTH}, u AS (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM truth)), c AS (SELECT u.item_id, count(doc_id) AS n FROM u LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) USING (item_id) GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS queries, CAST(sum(n) AS BIGINT) AS returned, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty FROM c")
def ev7_unanswerable(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    none = items.join(relevant_documents(spark, sf_dir), "item_id", "left_anti").select("item_id")
    hits = lexical(spark, sf_dir).where("rank <= 10").groupBy("item_id").agg(F.count("*").alias("n"))
    out = none.join(hits, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.agg(F.count("*").alias("queries"), F.sum("n").cast("long").alias("returned"), F.count_if(F.col("n") == 0).alias("empty"))


@registered(f"WITH {ALL} SELECT mode, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.HEADLINE)} FROM scored GROUP BY 1")
def ev9_headline(spark, sf_dir):
    return E.averages(all_scores(spark, sf_dir), ["mode"])


@registered(f"WITH {ALL}, c AS (SELECT item_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS class FROM benchmark) SELECT class, {', '.join(f'round(avg(CASE WHEN mode = {chr(39)}{m}{chr(39)} THEN ndcg_10 END), 6) AS {m}' for m in ('bm25', 'dense', 'hybrid'))} FROM scored JOIN c USING (item_id) GROUP BY 1")
def ag4_per_class(spark, sf_dir):
    classes = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.char_length("text") < 200, "short").otherwise("long").alias("class"))
    wide = all_scores(spark, sf_dir).join(classes, "item_id").groupBy("class").pivot("mode", ["bm25", "dense", "hybrid"]).agg(F.round(F.avg("ndcg_10"), 6))
    return wide


@registered(f"WITH {ALL}, o AS (SELECT item_id, ndcg_10 AS own FROM scored WHERE mode = 'hybrid'), r AS (SELECT item_id, max(ndcg_10) AS rival, first(mode ORDER BY ndcg_10 DESC, mode) AS beaten_by FROM scored WHERE mode <> 'hybrid' GROUP BY 1) SELECT item_id, beaten_by, round(rival - own, 6) AS deficit FROM o JOIN r USING (item_id) WHERE rival > own")
def ev10_hybrid_losses(spark, sf_dir):
    return E.losses(all_scores(spark, sf_dir), "hybrid")


def unit_sql(tag: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{tag}', 20260910, draw, i)), 1, 8)) AS BIGINT)"


@registered(f"""WITH {ALL},
diffs AS (SELECT row_number() OVER (ORDER BY item_id) AS i, y.ndcg_10 - x.ndcg_10 AS d FROM (SELECT * FROM scored WHERE mode = 'bm25') x JOIN (SELECT * FROM scored WHERE mode = 'hybrid') y USING (item_id)),
size AS (SELECT count(*) AS n_items, round(avg(d), 6) AS difference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM diffs),
draws AS (SELECT i, d, draw, n_items FROM diffs, (SELECT unnest(range(1, 10001)) AS draw), size),
means AS (SELECT p.draw, round(avg(f.d), 9) AS mean FROM (SELECT draw, {unit_sql('b')} % n_items + 1 AS i FROM draws) p JOIN diffs f USING (i) GROUP BY 1),
ordered AS (SELECT mean, row_number() OVER (ORDER BY mean) AS r FROM means),
flips AS (SELECT draw, round(avg(CASE WHEN {unit_sql('f')} % 2 = 0 THEN d ELSE -d END), 6) AS f FROM draws GROUP BY 1)
SELECT difference, round((SELECT mean FROM ordered WHERE r = 251), 6) AS ci_low, round((SELECT mean FROM ordered WHERE r = 9751), 6) AS ci_high,
  round(((SELECT count(*) FROM flips WHERE abs(f) >= abs(difference)) + 1) / 10001, 6) AS p, wins, losses, ties FROM size""")
def ev11_bootstrap(spark, sf_dir):
    return E.paired(all_scores(spark, sf_dir), "bm25", "hybrid", "ndcg_10", 10000, 20260910)


_GATE = ", ".join(f"('{m}', (SELECT {m} FROM a WHERE mode = 'bm25'), (SELECT {m} FROM a WHERE mode = 'hybrid'))" for m in E.HEADLINE)


@registered(f"WITH {ALL}, a AS (SELECT mode, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.HEADLINE)} FROM scored GROUP BY 1) SELECT metric, before, after, after < before - 0.02 AS failed FROM (VALUES {_GATE}) t(metric, before, after)")
def ev15_gate(spark, sf_dir):
    avg = E.averages(all_scores(spark, sf_dir), ["mode"])
    return E.gate(avg.where("mode = 'bm25'").drop("mode"), avg.where("mode = 'hybrid'").drop("mode"), E.HEADLINE)


@registered(f"WITH {ALL} SELECT item_id, b.ndcg_10 AS before, a.ndcg_10 AS after FROM (SELECT * FROM scored WHERE mode = 'bm25') b JOIN (SELECT * FROM scored WHERE mode = 'dense') a USING (item_id) WHERE a.ndcg_10 < b.ndcg_10 - 1e-9")
def ev16_regressed(spark, sf_dir):
    s = all_scores(spark, sf_dir)
    one = lambda mode, name: s.where(F.col("mode") == mode).select("item_id", F.col("ndcg_10").alias(name))
    return one("bm25", "before").join(one("dense", "after"), "item_id").where("after < before - 1e-9")


@registered(f"WITH {ALL} SELECT concat(b.mode, '-', a.mode) AS pair, round(avg(b.ndcg_10 - a.ndcg_10), 6) AS difference, CAST(count(*) FILTER (b.ndcg_10 > a.ndcg_10) AS BIGINT) AS wins, CAST(count(*) FILTER (b.ndcg_10 < a.ndcg_10) AS BIGINT) AS losses, CAST(count(*) FILTER (b.ndcg_10 = a.ndcg_10) AS BIGINT) AS ties FROM scored a JOIN scored b ON a.item_id = b.item_id AND a.mode < b.mode GROUP BY 1")
def ev14_mode_pairs(spark, sf_dir):
    return E.mode_pairs(all_scores(spark, sf_dir), "ndcg_10")


@registered(f"WITH {ALL}, a AS (SELECT mode, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.HEADLINE)} FROM scored GROUP BY 1), t AS (UNPIVOT a ON {', '.join(E.HEADLINE)} INTO NAME metric VALUE value) SELECT metric, best, string_agg(mode, ',' ORDER BY mode) AS leaders FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS best FROM t) WHERE value = best GROUP BY 1, 2")
def ag17_leaders(spark, sf_dir):
    return E.leaders(E.averages(all_scores(spark, sf_dir), ["mode"]))


@registered(f"WITH {BM},{DN},{HY},{TRUTH} SELECT item_id, CAST(count(rank) AS BIGINT) AS hits, CAST(count(*) FILTER (rank IS NULL) AS BIGINT) AS misses, min(rank) AS first_hit FROM truth LEFT JOIN hy USING (item_id, doc_id) GROUP BY 1")
def jn7_hits_and_misses(spark, sf_dir):
    return E.hits_and_misses(both_fused(spark, sf_dir), relevant_documents(spark, sf_dir))


# the golden set: benchmark items, some blanked, repeated or of a class that isn't known

_GOLDEN = "SELECT item_id, CASE WHEN item_id % 13 = 0 THEN '  ' ELSE text END AS query, CASE WHEN item_id % 17 = 0 THEN 'other' WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS class FROM benchmark"


@registered(f"WITH g AS ({_GOLDEN} UNION ALL {_GOLDEN} WHERE item_id % 11 = 0) SELECT 'blank query' AS rule, CAST(item_id AS VARCHAR) AS subject FROM g WHERE trim(query) = '' UNION ALL SELECT 'long query', CAST(item_id AS VARCHAR) FROM g WHERE length(query) > 512 UNION ALL SELECT 'unknown class', CAST(item_id AS VARCHAR) FROM g WHERE class NOT IN ('short', 'long') UNION ALL SELECT 'repeated id', CAST(item_id AS VARCHAR) FROM g GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'class size', class FROM g WHERE class IN ('short', 'long') GROUP BY class HAVING count(*) <> 10")
def ev18_golden_violations(spark, sf_dir):
    item = F.col("item_id")
    kind = F.when(item % 17 == 0, "other").when(F.char_length("text") < 200, "short").otherwise("long")
    golden = read(spark, sf_dir, "benchmark").select("item_id", F.when(item % 13 == 0, "  ").otherwise(F.col("text")).alias("query"), kind.alias("class"))
    return E.violations(golden.unionByName(golden.where(item % 11 == 0)), ["short", "long"], 10)


# ingestion: every seventh document comes again with another text, every eleventh id is new

_INCOMING = "SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' Revised.') ELSE text END AS text FROM documents"
_CLASSIFIED = f"SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN {HASH.format('o.text')} = {HASH.format('n.text')} THEN 'skipped' ELSE 'updated' END AS action FROM ({_INCOMING}) n LEFT JOIN documents o ON o.doc_id = n.doc_id"


def _incoming(docs: DataFrame) -> DataFrame:
    new_id = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id"))
    return docs.select(new_id.alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" Revised."))).otherwise(F.col("text")).alias("text"))


@registered(_CLASSIFIED)
def jn5_upsert_classify(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return I.classified(_incoming(docs), docs)


@registered(f"SELECT doc_id, md5(text) AS text_md5 FROM ({_INCOMING}) UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_INCOMING}))")
def snk2_upsert(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return I.upserted(docs, _incoming(docs)).select("doc_id", F.md5("text").alias("text_md5"))


@registered(f"SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (action = 'created') AS BIGINT) AS created, CAST(count(*) FILTER (action = 'updated') AS BIGINT) AS updated, CAST(count(*) FILTER (action = 'skipped') AS BIGINT) AS skipped FROM ({_CLASSIFIED})")
def ag7_run_counters(spark, sf_dir):
    return I.counters(jn5_upsert_classify(spark, sf_dir))


def _chunk_state(spark, sf_dir) -> DataFrame:
    """Chunks as if a pass had stopped: some aren't indexed yet, some have no vector."""
    doc, chunk = F.col("doc_id"), F.col("chunk_index")
    out = I.chunk_table(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_index", ((doc % 3 != 0) | (chunk == 0)).alias("indexed"), ((doc + chunk) % 5 != 0).alias("embedded"))


@registered(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index FROM chunk_state WHERE NOT indexed OR NOT embedded")
def src11_stale_chunks(spark, sf_dir):
    return I.stale(_chunk_state(spark, sf_dir)).select("doc_id", "chunk_index")


@registered(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(count(*) AS BIGINT) AS chunk_count, bool_and(indexed) AS complete FROM chunk_state GROUP BY 1")
def snk7_fully_indexed(spark, sf_dir):
    return I.completeness(_chunk_state(spark, sf_dir))


@registered(f"WITH RECURSIVE {CHUNKS} SELECT 'documents' AS check, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunk_state UNION ALL SELECT 'indexed', count(*) FROM chunk_state WHERE indexed UNION ALL SELECT 'unembedded', count(*) FROM chunk_state WHERE NOT embedded UNION ALL SELECT 'without_chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunk_state)")
def ev21_integrity(spark, sf_dir):
    return I.integrity(read(spark, sf_dir, "documents"), _chunk_state(spark, sf_dir))


@registered("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 250))")
def snk13_fixture_export(spark, sf_dir):
    return I.fixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 250)


@registered("SELECT doc_id + CASE WHEN doc_id % 5 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM labels WHERE doc_id % 5 = 0 OR doc_id NOT IN (SELECT doc_id FROM documents)")
def jn6_missing_labels(spark, sf_dir):
    shifted = F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1000000000).otherwise(0)
    return read(spark, sf_dir, "labels").select(shifted.alias("doc_id")).join(read(spark, sf_dir, "documents"), "doc_id", "left_anti")


@registered("SELECT event_type AS category, max(ts) AS watermark FROM events WHERE value >= 5 GROUP BY 1")
def ag9_watermark(spark, sf_dir):
    runs = read(spark, sf_dir, "events").where("value >= 5")
    return runs.groupBy(F.col("event_type").alias("category")).agg(F.max("ts").alias("watermark"))


@registered("SELECT event_type AS mode, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(value ORDER BY ts DESC, event_id DESC) AS value FROM events GROUP BY 1")
def ag10_latest_run_per_mode(spark, sf_dir):
    last = F.max(F.struct("ts", "event_id", "value")).alias("x")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(last).select("mode", "x.event_id", "x.value")


@registered("SELECT event_type, CAST(count(*) AS BIGINT) AS n, median(value) AS middle, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_middle FROM events GROUP BY 1")
def ag5_medians(spark, sf_dir):
    return E.medians(read(spark, sf_dir, "events"), "event_type", "value")


@registered("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert_replay(spark, sf_dir):
    files = staging_path(spark, "event-files")
    read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(files)  # a micro-batch each
    out = replay(spark, files, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "ts", "value")


# answers: assistant turns get citation marks and abstentions from their own ids

_ANSWERS = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN concat(' ', chr(10), chr(160), '**`INSUFFICIENT_CONTEXT`.**', chr(10), text) ELSE concat(text, ' [', conv_id % 4 + 1, '] [', turn % 7, '] [', conv_id % 4 + 1, ']') END AS answer FROM conversations WHERE role = 'assistant'"
_CITED = f"SELECT conv_id, turn, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(answer, '\\[(\\d+)\\]', 1)] AS cited, upper(regexp_replace(regexp_replace(split_part(regexp_replace(answer, '^{T.SPACES}+|{T.SPACES}+$', '', 'g'), chr(10), 1), '^{T.SPACES}+|{T.SPACES}+$', '', 'g'), '^[`*. ]+|[`*. ]+$', '', 'g')) = '{T.ABSTAIN}' AS abstained FROM ({_ANSWERS})"


def _answers(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    mark = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    first, second = mark(F.col("conv_id") % 4 + 1), mark(F.col("turn") % 7)
    answer = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.concat(F.lit(" \n\u00a0**`INSUFFICIENT_CONTEXT`.**\n"), "text")).otherwise(F.concat("text", first, second, first))
    out = said.select("conv_id", "turn", answer.alias("answer"))
    return out.select("conv_id", "turn", T.citations(F.col("answer")).alias("cited"), T.abstained(F.col("answer")).alias("abstained"))


@registered(f"SELECT conv_id, turn, array_to_string(cited, ',') AS cited, CAST(len([x FOR x IN cited IF x < 1 OR x > 5]) AS BIGINT) AS n_invalid FROM ({_CITED})")
def sc11_citations(spark, sf_dir):
    bad = F.filter("cited", lambda x: (x < 1) | (x > 5))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join("cited", ",").alias("cited"), F.size(bad).cast("long").alias("n_invalid"))


@registered(f"SELECT conv_id, turn, abstained FROM ({_CITED})")
def sc13_abstention(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", "abstained")


@registered(f"SELECT CAST(count(*) AS BIGINT) AS answers, round(avg(CAST(abstained AS INT)), 6) AS abstention, round(avg(CASE WHEN NOT abstained AND len(cited) > 0 THEN len([x FOR x IN cited IF x BETWEEN 1 AND 5]) / len(cited) END), 6) AS precision, CAST(count(*) FILTER (NOT abstained AND len(cited) = 0) AS BIGINT) AS uncited, CAST(coalesce(sum(len([x FOR x IN cited IF x < 1 OR x > 5])) FILTER (NOT abstained), 0) AS BIGINT) AS hallucinated FROM ({_CITED})")
def ag11_answer_rates(spark, sf_dir):
    df = _answers(spark, sf_dir)
    good = F.size(F.filter("cited", lambda x: x.between(1, 5)))
    spoke, n = ~F.col("abstained"), F.size("cited")
    return df.agg(
        F.count("*").alias("answers"),
        F.round(F.avg(F.col("abstained").cast("int")), 6).alias("abstention"),
        F.round(F.avg(F.when(spoke & (n > 0), good / n)), 6).alias("precision"),
        F.count_if(spoke & (n == 0)).alias("uncited"),
        F.coalesce(F.sum(F.when(spoke, n - good)), F.lit(0)).cast("long").alias("hallucinated"),
    )


FLAGSHIP = rt6_rrf_fusion


def _loaded() -> None:
    for name in ("answering", "explaining", "ingesting", "storing"):
        importlib.import_module(f"loomspan.jobs.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
