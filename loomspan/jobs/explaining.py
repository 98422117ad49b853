"""Queries on requests, fused lists in detail, explanations, envelopes and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions.stemming import stem_sql, stemmed
from loomspan.jobs.catalogue import ABSTRACT, ALL, APART, BM, CHUNKS, DN, HY, TITLE, TRUTH, all_scores, both_fused, dense_hits, lexical, registered, relevant_documents, stored_index, unit_sql
from loomspan.operators import evaluation as E
from loomspan.operators import explaining as X
from loomspan.operators import ingest as I
from loomspan.operators import retrieval as R
from loomspan.operators.lexicon import ENGLISH
from loomspan.sources.staging import staging_path
from loomspan.sources.tables import read

# requests: turns of conversations, whose modes and sizes come from their ids

_REQUESTS = f"SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 6 = 1 THEN concat(chr(160), ' ', text, chr(8195), chr(10)) WHEN turn % 6 = 3 THEN concat(chr(12288), chr(9)) ELSE text END, '^{T.SPACES}+|{T.SPACES}+$', '', 'g') AS query, CASE turn % 5 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'fuzzy' END AS mode, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 60 END AS top_k FROM conversations"


@registered(f"SELECT conv_id, turn, CAST(length(query) AS BIGINT) AS n_chars, coalesce(mode, 'hybrid') AS mode, coalesce(top_k, 10) AS top_k, CASE WHEN query = '' THEN 'blank query' WHEN length(query) > 512 THEN 'long query' WHEN mode = 'fuzzy' THEN 'unknown mode' WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k' END AS error FROM ({_REQUESTS})")
def flt7_requests(spark, sf_dir):
    turn, conv = F.col("turn") % 5, F.col("conv_id")
    mode = F.when(turn == 0, "bm25").when(turn == 1, "dense").when(turn == 2, "hybrid").when(turn == 3, "fuzzy")
    padded = F.when(F.col("turn") % 6 == 1, F.concat(F.lit("\u00a0 "), "text", F.lit("\u2003\n"))).when(F.col("turn") % 6 == 3, "\u3000\t").otherwise(F.col("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", padded.alias("query"), mode.alias("mode"), F.when(conv % 7 != 0, conv % 60).alias("top_k"))
    return R.requests(rows).select("conv_id", "turn", F.char_length("query").cast("long").alias("n_chars"), "mode", "top_k", "error")


_BLANKED = "blanked AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN concat(' ', chr(160)) ELSE text END AS text FROM benchmark)"
_OF = lambda sql: sql.replace("FROM benchmark WHERE trim(text) <> ''", "FROM blanked WHERE item_id % 3 <> 0").replace("FROM benchmark", "FROM blanked")


@registered(f"WITH {_BLANKED},{_OF(BM)},{_OF(DN)} SELECT item_id, (SELECT count(*) FROM bm WHERE bm.item_id = b.item_id) AS bm25_hits, (SELECT count(*) FROM dn WHERE dn.item_id = b.item_id) AS dense_hits FROM blanked b")
def flt8_blank_queries(spark, sf_dir):
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    items = items.select("item_id", F.when(F.col("item_id") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"))
    hits = lambda df, name: df.groupBy("item_id").agg(F.count("*").alias(name))
    out = items.select("item_id").join(hits(R.bm25(items, docs), "bm25_hits"), "item_id", "left").join(hits(R.dense(items, docs), "dense_hits"), "item_id", "left")
    return out.select("item_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bm25_hits", "dense_hits")])


# lexical search over titles, abstracts and chunks, with English analysis

_SQL_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _en(text: str) -> str:
    joined = T.JOINED.replace("'", "''")
    return f"[x FOR x IN [regexp_replace(w, '[''\u2019]s$', '') FOR w IN regexp_extract_all(lower({APART.format(text)}), '{joined}')] IF NOT list_contains([{_SQL_STOPS}], x)]"


_FIELDS = {"title": 2.0, "abstract": 1.0, "chunk": 1.0}
#: Stems of all words of queries, titles, abstracts and chunks, then the queries' terms.
_STEMS = f"""
asked_words AS (SELECT item_id, unnest({_en('text')}) AS word FROM benchmark),
{", ".join(f"{n}_words AS (SELECT key, unnest({_en(n + '_text')}) AS word FROM keyed)" for n in _FIELDS)},
all_words AS (SELECT word FROM asked_words {" ".join(f"UNION SELECT word FROM {n}_words" for n in _FIELDS)}),{stem_sql('all_words')},
asked AS (SELECT DISTINCT item_id, stem AS term FROM asked_words JOIN stems USING (word))"""


def _english_sql(name: str, boost: float) -> str:
    return f"""
{name}_p AS (SELECT key, stem AS term, count(*) AS tf FROM {name}_words JOIN stems USING (word) GROUP BY 1, 2),
{name}_l AS (SELECT key, len({_en(name + "_text")}) AS dl FROM keyed),
{name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name} AS (SELECT item_id, key, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM asked JOIN {name}_p USING (term) JOIN {name}_f USING (term) JOIN {name}_l USING (key), {name}_c GROUP BY 1, 2)"""


@registered(f"""WITH RECURSIVE {CHUNKS},
keyed AS (SELECT c.doc_id * 1000000 + chunk_index AS key, c.doc_id, chunk_index, {TITLE.format('d.text')} AS title_text, {ABSTRACT.format('d.text')} AS abstract_text, c.text AS chunk_text FROM chunked c JOIN documents d USING (doc_id)),{_STEMS},
{','.join(_english_sql(n, boost) for n, boost in _FIELDS.items())},
s AS (SELECT item_id, key, round(max(score), 6) AS score FROM (SELECT * FROM title UNION ALL SELECT * FROM abstract UNION ALL SELECT * FROM chunk) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS rank FROM s JOIN keyed USING (key)),
best AS (SELECT item_id, doc_id, first(chunk_index ORDER BY rank) AS best_chunk, min(rank) AS first_rank FROM r WHERE rank <= {R.DEPTH} GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id, best_chunk, row_number() OVER (PARTITION BY item_id ORDER BY first_rank) AS rank FROM best) WHERE rank <= {R.TOP_K}""")
def rt1_bm25_multi_field(spark, sf_dir):
    def of(name: str):
        def texts(docs):
            chunks = I.chunk_table(docs).select("doc_id", F.col("chunk_index").alias("chunk"), F.col("text").alias("chunk_text"))
            whole = docs.select("doc_id", T.title_of(F.col("text")).alias("title_text"), T.abstract_of(F.col("text")).alias("abstract_text"))
            return chunks.join(whole, "doc_id").select("doc_id", "chunk", F.col(f"{name}_text").alias("text"))

        return texts

    fields = {name: (stored_index(spark, sf_dir, f"english-{name}", of(name), ENGLISH), boost) for name, boost in _FIELDS.items()}
    return R.collapsed(R.bm25_best_fields(read(spark, sf_dir, "benchmark"), fields), R.TOP_K).drop("extra_hits")


@registered(f"WITH w AS (SELECT doc_id, unnest({_en('text')}) AS word FROM documents),{stem_sql('w')} SELECT stem AS term, count(*) AS cf, count(DISTINCT doc_id) AS df, count(DISTINCT word) AS forms FROM w JOIN stems USING (word) GROUP BY 1")
def rt2_english_vocabulary(spark, sf_dir):
    """Stems of the corpus with the word forms behind them; forms are stemmed once each."""
    docs = read(spark, sf_dir, "documents")
    forms = docs.select(F.explode(T.english_words(F.col("text"))).alias("word")).distinct()
    forms = forms.select(F.get(stemmed(F.array("word")), 0).alias("term")).groupBy("term").agg(F.count("*").alias("forms"))
    return stored_index(spark, sf_dir, "english", lambda d: d.select("doc_id", "text"), ENGLISH).vocabulary().join(forms, "term")


# fused lists in detail

_DETAIL = f"WITH {BM},{DN},{HY}, detail AS (SELECT hy.*, bm.score AS bm25_score, dn.score AS dense_score, 1.0::DOUBLE / ({R.RRF_K} + bm25_rank) AS bm25_contribution, 1.0::DOUBLE / ({R.RRF_K} + dense_rank) AS dense_contribution FROM hy LEFT JOIN bm ON bm.item_id = hy.item_id AND bm.doc_id = hy.doc_id LEFT JOIN dn ON dn.item_id = hy.item_id AND dn.doc_id = hy.doc_id)"
_FIX = lambda x, digits, exact: f"CAST(CAST(round(CAST({x} AS DECIMAL(18,{exact})), {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"
_TOLD = lambda n: f"CASE WHEN {n}_rank IS NOT NULL THEN concat('{n} ranked it #', {n}_rank, ', score ', {_FIX(n + '_score', 4, 6)}, ', contributing ', {_FIX(n + '_contribution', 5, 9)}) END"


@registered(f"{_DETAIL} SELECT item_id, doc_id, rank, bm25_score, dense_score, round(bm25_contribution, 9) AS bm25_contribution, round(dense_contribution, 9) AS dense_contribution FROM detail")
def rt6_fusion_detail(spark, sf_dir):
    share = [F.round(f"{n}_contribution", 9).alias(f"{n}_contribution") for n in ("bm25", "dense")]
    return both_fused(spark, sf_dir).select("item_id", "doc_id", "rank", "bm25_score", "dense_score", *share)


@registered(f"{_DETAIL} SELECT item_id, doc_id, concat('Fused from ', concat_ws('; ', {_TOLD('bm25')}, {_TOLD('dense')}), '. Reciprocal rank fusion with k={R.RRF_K}.', CASE WHEN bm25_rank IS NULL OR dense_rank IS NULL THEN '{X.ALONE}' ELSE '' END) AS explanation FROM detail")
def rt12_explain(spark, sf_dir):
    return both_fused(spark, sf_dir).select("item_id", "doc_id", X.fused_sentence(["bm25", "dense"], R.RRF_K).alias("explanation"))


@registered(f"""WITH {BM},{DN} SELECT item_id, doc_id, 'bm25' AS mode, concat('Retrieved by bm25, BM25 score ', {_FIX('score', 4, 6)}, '.') AS explanation FROM bm WHERE rank <= 10 UNION ALL
SELECT item_id, doc_id, 'dense', concat('Retrieved by dense, cosine similarity ', {_FIX('score', 4, 6)}, '.') FROM dn WHERE rank <= 10 UNION ALL
SELECT item_id, doc_id, 'degraded', concat('Fused from bm25 ranked it #', rank, ', score ', {_FIX('score', 4, 6)}, ', contributing ', {_FIX(f'(1.0::DOUBLE / ({R.RRF_K} + rank))', 5, 9)}, '. Reciprocal rank fusion with k={R.RRF_K}.{X.ALONE}{X.FAILED.format('dense')}') FROM bm WHERE rank <= 10""")
def rt12_explain_modes(spark, sf_dir):
    b, d = lexical(spark, sf_dir), dense_hits(spark, sf_dir)
    half = R.hybrid({"bm25": b, "dense": None})
    said = lambda df, mode, s: df.where("rank <= 10").select("item_id", "doc_id", F.lit(mode).alias("mode"), s.alias("explanation"))
    out = said(b, "bm25", X.single_sentence("bm25", F.col("score"))).unionByName(said(d, "dense", X.single_sentence("dense", F.col("score"))))
    return out.unionByName(said(half, "degraded", X.fused_sentence(["bm25"], R.RRF_K, ["dense"])))


@registered(f"{_DETAIL} SELECT item_id, doc_id, CASE WHEN dense_rank IS NULL THEN concat('bm25@', bm25_rank) WHEN bm25_rank IS NULL THEN concat('dense@', dense_rank) WHEN bm25_rank <= dense_rank THEN concat('bm25@', bm25_rank, ',dense@', dense_rank) ELSE concat('dense@', dense_rank, ',bm25@', bm25_rank) END AS runs, CASE WHEN dense_rank IS NULL THEN 'dense' WHEN bm25_rank IS NULL THEN 'bm25' ELSE '' END AS missing FROM detail")
def rt13_contributions(spark, sf_dir):
    return X.contributions(both_fused(spark, sf_dir), ["bm25", "dense"])


@registered(f"{_DETAIL} SELECT item_id, doc_id, concat_ws(', ', CASE WHEN bm25_rank IS NOT NULL THEN concat('bm25@', bm25_rank) END, CASE WHEN dense_rank IS NOT NULL THEN concat('dense@', dense_rank) END) AS found_by FROM detail WHERE rank = 1")
def rt11_found_by(spark, sf_dir):
    at = lambda n: F.concat(F.lit(f"{n}@"), F.col(f"{n}_rank"))
    return both_fused(spark, sf_dir).where("rank = 1").select("item_id", "doc_id", F.concat_ws(", ", at("bm25"), at("dense")).alias("found_by"))


@registered(f"WITH {BM},{DN},{HY}, kept AS (SELECT item_id, doc_id, rank FROM hy JOIN documents USING (doc_id) WHERE source <> 'src0') SELECT b.item_id, 'hybrid' AS mode, {R.TOP_K} AS top_k, count(k.doc_id) AS n, {R.RRF_K} AS rrf_k, {R.DEPTH} AS fusion_depth, '' AS failed, coalesce(string_agg(k.doc_id, ',' ORDER BY k.rank), '') AS ids FROM benchmark b LEFT JOIN kept k USING (item_id) GROUP BY 1")
def rt15_envelope(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("source <> 'src0'")
    runs = {"bm25": lexical(spark, sf_dir), "dense": dense_hits(spark, sf_dir)}
    return R.envelopes(read(spark, sf_dir, "benchmark"), R.hybrid(runs), docs, "hybrid", R.TOP_K)


@registered(f"{_DETAIL} SELECT item_id, x.doc_id, rank, {TITLE.format('text')} AS title, source, concat('Fused from ', concat_ws('; ', {_TOLD('bm25')}, {_TOLD('dense')}), '. Reciprocal rank fusion with k={R.RRF_K}.', CASE WHEN bm25_rank IS NULL OR dense_rank IS NULL THEN '{X.ALONE}' ELSE '' END) AS explanation FROM detail x JOIN documents d ON d.doc_id = x.doc_id")
def prj6_tool_results(spark, sf_dir):
    """Results with what they are and why they are there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"), "source")
    why = X.fused_sentence(["bm25", "dense"], R.RRF_K).alias("explanation")
    return both_fused(spark, sf_dir).select("item_id", "doc_id", "rank", why).join(docs, "doc_id")


# comparisons and gates

_PAIRS = [("bm25", "dense"), ("bm25", "hybrid"), ("dense", "hybrid")]


def _pair_sql(n: int, a: str, b: str) -> str:
    return f"""
diffs{n} AS (SELECT row_number() OVER (ORDER BY item_id) AS i, y.ndcg_10 - x.ndcg_10 AS d, x.ndcg_10 AS x, y.ndcg_10 AS y FROM (SELECT * FROM scored WHERE mode = '{a}') x JOIN (SELECT * FROM scored WHERE mode = '{b}') y USING (item_id)),
size{n} AS (SELECT count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(d), 6) AS difference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM diffs{n}),
draws{n} AS (SELECT i, d, draw, n FROM diffs{n}, (SELECT unnest(range(1, 10001)) AS draw), size{n}),
means{n} AS (SELECT p.draw, round(avg(f.d), 9) AS mean FROM (SELECT draw, {unit_sql('b')} % n + 1 AS i FROM draws{n}) p JOIN diffs{n} f USING (i) GROUP BY 1),
ordered{n} AS (SELECT mean, row_number() OVER (ORDER BY mean) AS r FROM means{n}),
flips{n} AS (SELECT draw, round(avg(CASE WHEN {unit_sql('f')} % 2 = 0 THEN d ELSE -d END), 6) AS f FROM draws{n} GROUP BY 1),
pair{n} AS (SELECT '{a}' AS a, '{b}' AS b, n, mean_a, mean_b, difference, round((SELECT mean FROM ordered{n} WHERE r = 251), 6) AS ci_low, round((SELECT mean FROM ordered{n} WHERE r = 9751), 6) AS ci_high,
  round(((SELECT count(*) FROM flips{n} WHERE abs(f) >= abs(difference)) + 1) / 10001, 6) AS p, wins, losses, ties FROM size{n})"""


_COMPARED = f"WITH {ALL},{','.join(_pair_sql(n, a, b) for n, (a, b) in enumerate(_PAIRS))}, c AS (SELECT *, ci_low > 0 OR ci_high < 0 AS significant FROM ({' UNION ALL '.join(f'SELECT * FROM pair{n}' for n in range(3))}))"
_SIGNED = lambda x: f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '+' END, {_FIX(f'abs({x})', 3, 6)})"


def _compared(spark, sf_dir):
    return E.comparisons(all_scores(spark, sf_dir), _PAIRS, "ndcg_10", 10000, 20260910)


@registered(f"{_COMPARED} SELECT * FROM c")
def ev13_comparisons(spark, sf_dir):
    return _compared(spark, sf_dir)


@registered(f"{_COMPARED} SELECT a, b, concat(b, ' - ', a, ' = ', {_SIGNED('difference')}, ' 95% CI [', {_SIGNED('ci_low')}, ', ', {_SIGNED('ci_high')}, '], p=', {_FIX('p', 3, 6)}, ' (', CASE WHEN significant THEN '{X.VERDICTS[0]}' ELSE '{X.VERDICTS[1]}' END, '; ', wins, ' wins / ', losses, ' losses / ', ties, ' ties over n=', n, ')') AS sentence FROM c")
def sc23_comparison_sentences(spark, sf_dir):
    return _compared(spark, sf_dir).select("a", "b", X.comparison_sentence(F.col("a"), F.col("b")).alias("sentence"))


_ABLATION = ["recall_1", "recall_5", "recall_10", "precision_10", "mrr", "ndcg_10"]


#: Times of queries: each event is a measurement of the mode that its id names.
_TIMES = "SELECT CASE event_id % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS mode, value AS ms FROM events"


@registered(f"WITH {ALL}, m AS (SELECT mode, round(median(ms), 6) AS median_ms FROM ({_TIMES}) GROUP BY 1) SELECT mode, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _ABLATION)}, coalesce(any_value(median_ms), 0) AS median_ms FROM scored LEFT JOIN m USING (mode) GROUP BY 1")
def ev9_ablation(spark, sf_dir):
    scored, i = all_scores(spark, sf_dir), F.col("event_id") % 3
    times = read(spark, sf_dir, "events").select(F.when(i == 0, "bm25").when(i == 1, "dense").otherwise("hybrid").alias("mode"), F.col("value").alias("ms"))
    medians = E.medians(times, "mode", "ms").select("mode", F.round("middle", 6).alias("median_ms"))
    table = scored.groupBy("mode").agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in _ABLATION])
    return table.join(medians, "mode", "left").withColumn("median_ms", F.coalesce("median_ms", F.lit(0.0)))


@registered(f"WITH {ALL}, o AS (SELECT item_id, ndcg_10 AS own FROM scored WHERE mode = 'hybrid'), r AS (SELECT item_id, max(ndcg_10) AS rival, first(mode ORDER BY ndcg_10 DESC, mode) AS beaten_by FROM scored WHERE mode <> 'hybrid' GROUP BY 1), h AS (SELECT item_id, min(rank) AS first_hit, count(*) FILTER (rank IS NULL) AS missed FROM truth LEFT JOIN hy USING (item_id, doc_id) GROUP BY 1) SELECT item_id, beaten_by, round(rival - own, 6) AS deficit, first_hit, missed, row_number() OVER (ORDER BY round(rival - own, 6) DESC, item_id) AS place FROM o JOIN r USING (item_id) JOIN h USING (item_id) WHERE rival > own")
def ev10_losses_detail(spark, sf_dir):
    from pyspark.sql import Window

    truth = relevant_documents(spark, sf_dir)
    hits = E.hits_and_misses(both_fused(spark, sf_dir), truth).select("item_id", "first_hit", F.col("misses").alias("missed"))
    place = F.row_number().over(Window.orderBy(F.desc("deficit"), "item_id")).cast("long")  # a report of lost queries
    return E.losses(all_scores(spark, sf_dir), "hybrid").join(hits, "item_id").withColumn("place", place)


_KEYS = ["papers", "chunks", "golden_set_version", "queries", "top_k"]


@registered(f"""WITH RECURSIVE {CHUNKS},{ALL}, a AS (SELECT mode, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.HEADLINE)} FROM scored GROUP BY 1),
k AS (SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM chunked) AS chunks, 1 AS golden_set_version, (SELECT count(*) FROM benchmark) AS queries, 10 AS top_k)
SELECT subject, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CASE WHEN prov THEN before <> after ELSE coalesce(after < before - 0.02, true) END AS failed FROM (
{' UNION ALL '.join(f"SELECT '{c}' AS subject, true AS prov, CAST({c} AS DOUBLE) AS before, CAST({c} {'+ 1' if c == 'queries' else ''} AS DOUBLE) AS after FROM k" for c in _KEYS)} UNION ALL
{' UNION ALL '.join(f"SELECT '{m}', false, (SELECT {m} FROM a WHERE mode = 'hybrid'), {'NULL' if m == 'mrr' else f'''(SELECT {m} FROM a WHERE mode = 'bm25')'''}" for m in E.HEADLINE)})""")
def ev15_provenance_gate(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    counts = docs.agg(F.count("*").alias("papers")).crossJoin(I.chunk_table(docs).agg(F.count("*").alias("chunks"))).crossJoin(items.agg(F.count("*").alias("queries")))
    counts = counts.withColumns({"golden_set_version": F.lit(1), "top_k": F.lit(10)})
    means = E.averages(all_scores(spark, sf_dir), ["mode"])
    before = counts.crossJoin(means.where("mode = 'hybrid'").drop("mode"))  # one row each
    after = counts.withColumn("queries", F.col("queries") + 1).crossJoin(means.where("mode = 'bm25'").drop("mode"))
    return E.provenance_gate(before, after.withColumn("mrr", F.lit(None).cast("double")), _KEYS, E.HEADLINE)


@registered(f"WITH {ALL}, c AS (SELECT item_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS class FROM benchmark) SELECT {', '.join(f'round(coalesce(avg({m}), 0), 6) AS {m}' for m in E.HEADLINE)}, count(*) AS queries FROM scored JOIN c USING (item_id) WHERE class IN ('long') AND mode = 'hybrid'")
def ag22_gated_classes(spark, sf_dir):
    classes = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.char_length("text") < 200, "short").otherwise("long").alias("class"))
    gated = all_scores(spark, sf_dir).where("mode = 'hybrid'").join(classes.where(F.col("class").isin("long")), "item_id")
    return gated.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in E.HEADLINE], F.count("*").alias("queries"))


@registered(f"WITH {TRUTH} SELECT count(DISTINCT doc_id) AS labelled, count(DISTINCT item_id) AS answerable, (SELECT count(*) FROM benchmark) - count(DISTINCT item_id) AS unanswerable FROM truth")
def ag20_labelled(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    truth = relevant_documents(spark, sf_dir)
    row = truth.agg(F.count_distinct("doc_id").alias("labelled"), F.count_distinct("item_id").alias("answerable"))
    return row.crossJoin(items.agg(F.count("*").alias("n"))).select("labelled", "answerable", (F.col("n") - F.col("answerable")).alias("unanswerable"))


_LABELS = """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'unanswerable' ELSE 'short' END AS class, CASE WHEN item_id % 4 = 0 AND item_id % 3 <> 0 THEN [] WHEN item_id % 9 = 5 THEN []
  ELSE [concat(lpad(CAST(item_id % 10000 AS VARCHAR), 4, '0'), '.', lpad(CAST(item_id AS VARCHAR), CASE WHEN item_id % 7 = 1 THEN 3 ELSE 5 END, '0')), concat(lpad(CAST((item_id + item_id % 5) % 10000 AS VARCHAR), 4, '0'), '.', lpad(CAST(item_id AS VARCHAR), CASE WHEN item_id % 7 = 1 THEN 3 ELSE 5 END, '0'))] END AS labels FROM benchmark"""
ID_PATTERN = r"^\d{4}\.\d{4,5}$"


@registered(f"WITH g AS ({_LABELS}) SELECT 'repeated label' AS rule, CAST(item_id AS VARCHAR) AS subject FROM g WHERE len(list_distinct(labels)) < len(labels) UNION ALL SELECT 'label of an unanswerable query', CAST(item_id AS VARCHAR) FROM g WHERE class = 'unanswerable' AND len(labels) > 0 UNION ALL SELECT 'no label', CAST(item_id AS VARCHAR) FROM g WHERE class <> 'unanswerable' AND len(labels) = 0 UNION ALL SELECT 'malformed label', CAST(item_id AS VARCHAR) FROM g WHERE len([x FOR x IN labels IF NOT regexp_matches(x, '{ID_PATTERN}')]) > 0")
def ev18_label_violations(spark, sf_dir):
    i = F.col("item_id")
    width = F.when(i % 7 == 1, 3).otherwise(5)
    label = lambda n: F.concat(F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(i.cast("string"), width, F.lit("0")))
    none = ((i % 4 == 0) & (i % 3 != 0)) | (i % 9 == 5)
    labels = F.when(none, F.array().cast("array<string>")).otherwise(F.array(label(i), label(i + i % 5)))
    golden = read(spark, sf_dir, "benchmark").select("item_id", F.when(i % 4 == 0, "unanswerable").otherwise("short").alias("class"), labels.alias("labels"))
    path = staging_path(spark, "golden-set")
    golden.write.json(path)  # ids are strings there, which no reader takes for numbers
    return E.label_violations(spark.read.schema("item_id long, class string, labels array<string>").json(path), ID_PATTERN)


@registered(f"WITH {BM},{TRUTH}, run AS (SELECT item_id, CASE WHEN item_id % 5 = 0 AND rank = 2 THEN first_value(doc_id) OVER (PARTITION BY item_id ORDER BY rank) ELSE doc_id END AS doc_id FROM bm WHERE rank <= 10) SELECT 'repeated hit' AS rule, item_id FROM (SELECT item_id, doc_id FROM run GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY item_id UNION ALL SELECT DISTINCT 'nothing relevant', item_id FROM run WHERE item_id NOT IN (SELECT item_id FROM truth)")
def ev6_broken_runs(spark, sf_dir):
    from pyspark.sql import Window

    first = F.first("doc_id").over(Window.partitionBy("item_id").orderBy("rank"))
    run = lexical(spark, sf_dir).where("rank <= 10").withColumn("first", first)
    run = run.select("item_id", F.when((F.col("item_id") % 5 == 0) & (F.col("rank") == 2), F.col("first")).otherwise(F.col("doc_id")).alias("doc_id"))
    return E.broken_runs(run, relevant_documents(spark, sf_dir))


@registered(f"WITH {TRUTH} SELECT item_id, doc_id FROM truth JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE length({TITLE.format('d.text')}) > 20 AND contains(lower(concat(b.text, CASE WHEN item_id % 2 = 0 THEN {TITLE.format('d.text')} ELSE '' END)), lower({TITLE.format('d.text')}))")
def flt11_title_quotes(spark, sf_dir):
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    titles = docs.select("doc_id", T.title_of(F.col("text")).alias("title"))
    both = relevant_documents(spark, sf_dir).join(titles, "doc_id").join(items, "item_id")
    query = F.concat("text", F.when(F.col("item_id") % 2 == 0, F.col("title")).otherwise(""))
    return both.where((F.char_length("title") > 20) & F.contains(F.lower(query), F.lower("title"))).select("item_id", "doc_id")


@registered(f"WITH {ALL} SELECT mode, item_id, ndcg_10, mrr FROM scored UNION ALL SELECT mode, NULL, round(avg(ndcg_10), 6), round(avg(mrr), 6) FROM scored GROUP BY 1")
def snk10_evaluation(spark, sf_dir):
    """Evaluation rows of every mode and query, written as JSON and read back."""
    scored = all_scores(spark, sf_dir).select("mode", "item_id", "ndcg_10", "mrr")
    whole = E.averages(scored, ["mode"], ["ndcg_10", "mrr"]).withColumn("item_id", F.lit(None).cast("long"))
    path = staging_path(spark, "evaluation")
    scored.unionByName(whole).write.json(path)
    return spark.read.schema("mode string, item_id long, ndcg_10 double, mrr double").json(path)
