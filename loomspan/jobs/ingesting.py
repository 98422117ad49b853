"""Queries of ingestion: feeds, re-ingested chunks, ledgers, vector checks, seeds and projections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.jobs.catalogue import ABSTRACT, CHUNKS, HASH, SQUEEZE, TITLE, WORDS, _embed_sql, registered
from loomspan.operators import ingest as I
from loomspan.operators import retrieval as R
from loomspan.sources import feeds
from loomspan.sources.staging import staged, staging_path
from loomspan.sources.tables import read

MODEL, OLD_MODEL = "hashed-384", "hashed-256"

# a second harvest: every seventh document comes again cut short, every eleventh id is new

_AGAIN = "SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 1500) ELSE text END AS text FROM documents"
_ACTIONS = f"again AS ({_AGAIN}), actions AS (SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN {HASH.format('o.text')} = {HASH.format('n.text')} THEN 'skipped' ELSE 'updated' END AS action FROM again n LEFT JOIN documents o ON o.doc_id = n.doc_id)"


def _chunks_of(source: str, suffix: str) -> str:
    """The chunk CTEs over another table, all under names of their own."""
    out = CHUNKS.replace("FROM documents", f"FROM {source}")
    for name in ("chunk_state", "chunked", "spans", "walk", "pre", "sen", "sq"):
        for before, after in ((f"\n{name} AS", f"\n{name}{suffix} AS"), (f"FROM {name}", f"FROM {name}{suffix}"), (f"JOIN {name}", f"JOIN {name}{suffix}")):
            out = out.replace(f"{before} ", f"{after} ").replace(f"{before})", f"{after})")
    return out


_STATE = f"WITH RECURSIVE {CHUNKS}, {_ACTIONS},{_chunks_of('again', '2')}, changed AS (SELECT doc_id FROM actions WHERE action <> 'skipped'), whole AS (SELECT doc_id, count(*) > 1 AS was_split FROM chunked2 GROUP BY 1), old AS (SELECT doc_id, count(*) > 1 AS was_split FROM chunked GROUP BY 1), state AS (SELECT doc_id, chunk_index, text, '{OLD_MODEL}' AS model, doc_id % 3 <> 0 AS indexed, was_split FROM chunked JOIN old USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM changed) UNION ALL SELECT doc_id, chunk_index, text, '{MODEL}', false, was_split FROM chunked2 JOIN whole USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM changed))"


def _again(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return docs.select(F.when(i % 11 == 0, i + 1000000000).otherwise(i).alias("doc_id"), F.when(i % 7 == 0, F.substring("text", 1, 1500)).otherwise(F.col("text")).alias("text"))


def _rechunked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk state before and after the second harvest, and the documents' actions."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    again = _again(docs)
    actions = staged(I.classified(again, docs), "actions")
    before = I.chunk_table(docs)
    split = before.groupBy("doc_id").agg((F.count("*") > 1).alias("was_split"))
    before = before.join(split, "doc_id").select("doc_id", "chunk_index", "text", F.lit(OLD_MODEL).alias("model"), (F.col("doc_id") % 3 != 0).alias("indexed"), "was_split")
    before = staged(before, "chunk-state")
    changed = actions.where("action <> 'skipped'").select("doc_id")
    return before, staged(I.rechunked(before, again, changed, MODEL), "chunk-state"), actions


@registered(f"{_STATE} SELECT doc_id, chunk_index, md5(text) AS text_md5, model, indexed, was_split FROM state")
def snk2_rechunked(spark, sf_dir):
    return _rechunked(spark, sf_dir)[1].select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "model", "indexed", "was_split")


@registered(f"{_STATE} SELECT doc_id, chunk_index FROM chunked WHERE (doc_id, chunk_index) NOT IN (SELECT (doc_id, chunk_index) FROM state)")
def snk5_vanished_chunks(spark, sf_dir):
    before, after, _ = _rechunked(spark, sf_dir)
    return I.vanished(before, after)


@registered(f"{_STATE} SELECT count(*) AS seen, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped, (SELECT count(*) FROM state WHERE doc_id IN (SELECT doc_id FROM changed)) AS chunks, (SELECT count(*) FROM state WHERE doc_id IN (SELECT doc_id FROM changed) AND was_split AND chunk_index = 0) AS split, count(*) FILTER (action <> 'skipped') AS changed, true AS succeeded FROM actions")
def ag7_chunk_counters(spark, sf_dir):
    _, after, actions = _rechunked(spark, sf_dir)
    out = I.run_counters(actions, after)
    return out.withColumns({"changed": F.col("created") + F.col("updated"), "succeeded": F.col("created") + F.col("updated") + F.col("skipped") == F.col("seen")})


@registered(f"{_STATE} SELECT count(*) AS chunks, count(*) FILTER (model <> '{MODEL}') AS stale_model, count(*) FILTER (NOT indexed) AS unindexed, count(*) FILTER (chunk_index >= 1) AS later_chunks FROM state")
def flt10_stale_model(spark, sf_dir):
    after = _rechunked(spark, sf_dir)[1]
    return after.agg(F.count("*").alias("chunks"), F.count_if(F.col("model") != MODEL).alias("stale_model"), F.count_if(~F.col("indexed")).alias("unindexed"), F.count_if(F.col("chunk_index") >= 1).alias("later_chunks"))


# runs: the events of a user are one, those of low value its errors

_RUN_EVENTS = "SELECT user_id AS run, ts AS at_, event_id AS item, event_type, CASE WHEN value < 0.4 OR user_id % 9 = 0 THEN concat(event_type, ' ', event_id, ' failed') END AS error FROM events"


def _run_events(spark, sf_dir) -> DataFrame:
    kind, bad = F.col("event_type"), (F.col("value") < 0.4) | (F.col("user_id") % 9 == 0)
    error = F.when(bad, F.concat(kind, F.lit(" "), F.col("event_id"), F.lit(" failed")))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("item"), kind, error.alias("error"))


@registered(f"WITH e AS ({_RUN_EVENTS}), t AS (SELECT run, count(*) AS seen, count(error) AS failed, max(at_) AS last, list(error ORDER BY item) FILTER (error IS NOT NULL) AS errors FROM e GROUP BY 1) SELECT run, CASE WHEN failed = 0 THEN 'success' ELSE 'failed' END AS status, seen, failed, CASE WHEN failed = 0 THEN last END AS watermark, coalesce(array_to_string(list_slice(errors, 1, 20), chr(10)), '') AS errors FROM t")
def snk9_run_ledger(spark, sf_dir):
    return I.ledger(_run_events(spark, sf_dir))


@registered(f"WITH e AS ({_RUN_EVENTS}), r AS (SELECT run, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS categories, min(at_) AS started, count(error) AS failed, max(at_) AS last FROM e GROUP BY 1) SELECT categories, first(last ORDER BY started DESC, run DESC) AS watermark FROM r WHERE failed = 0 GROUP BY 1")
def ag9_category_watermarks(spark, sf_dir):
    events = _run_events(spark, sf_dir)
    sets = events.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("categories"), F.min("at").alias("started"))
    return I.watermarks(I.ledger(events).join(sets, "run"))


@registered("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN user_id % 5 <> 0 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) END AS seconds FROM events GROUP BY 1")
def sc22_durations(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    took = (us(F.max("ts")) - us(F.min("ts"))) / 1e6
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.when(F.col("user_id") % 5 != 0, F.round(took, 6)).alias("seconds"))


_STAMPS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 3 THEN '' ELSE strftime(ts, 'on %d/%m/%Y') END AS stamp FROM events"


@registered(f"SELECT event_id, CAST(epoch(TRY_CAST(nullif(stamp, '') AS TIMESTAMPTZ)) AS BIGINT) AS seconds FROM ({_STAMPS})")
def sc3_timestamps(spark, sf_dir):
    i = F.col("event_id") % 5
    at = lambda pattern: F.date_format(F.col("ts").cast("timestamp"), pattern)
    stamp = F.when(i == 0, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, at("yyyy-MM-dd'T'HH:mm:ss")).when(i == 2, at("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(i == 3, "").otherwise(at("'on' dd/MM/yyyy"))
    return read(spark, sf_dir, "events").select("event_id", F.unix_seconds(T.timestamp_of(stamp)).alias("seconds"))


# vectors

_BENT = "SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings"


@registered(f"SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'width' WHEN len([x FOR x IN embedding IF x IS NULL OR isnan(x)]) > 0 THEN 'component' END AS problem FROM ({_BENT}) WHERE problem IS NOT NULL")
def em4_vector_problems(spark, sf_dir):
    i = F.col("vec_id")
    bent = F.when(i % 17 == 0, F.lit(None)).when(i % 13 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return I.vector_problems(read(spark, sf_dir, "embeddings").select("vec_id", bent.alias("embedding")), 64)


@registered(f"WITH RECURSIVE {CHUNKS}, c AS (SELECT concat(doc_id, '#', chunk_index) AS id, text FROM chunked), {_embed_sql('e', 'id', 'c')} SELECT k AS id, count(*) AS n_buckets, round(sum(weight * weight), 6) AS norm FROM e GROUP BY 1")
def snk14_seed_vectors(spark, sf_dir):
    """Every chunk's hashed embedding, as a seeded corpus stores it beside the chunk."""
    chunks = I.chunk_table(read(spark, sf_dir, "documents")).select(F.concat_ws("#", "doc_id", "chunk_index").alias("id"), "text")
    return R.hash_embedding(chunks, "id").groupBy("id").agg(F.count("*").alias("n_buckets"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


# projections; authors are the first line's words, dates come from ids

_PAPER = f"SELECT *, [x FOR x IN string_split({TITLE.format('text')}, ' ') IF x <> ''] AS authors, CAST(DATE '2024-01-01' + CAST(doc_id % 700 AS INT) AS DATE) AS published FROM documents"


def _papers(spark, sf_dir) -> DataFrame:
    authors = F.filter(F.split(T.title_of(F.col("text")), " "), lambda x: x != "")
    published = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))
    return read(spark, sf_dir, "documents").withColumns({"authors": authors, "published": published})


@registered(f"WITH RECURSIVE {CHUNKS}, p AS ({_PAPER}) SELECT concat(doc_id, '#', chunk_index) AS id, source, array_to_string(authors[1:20], '|') AS authors, strftime(published, '%Y-%m-%d') AS published, md5(c.text) AS text_md5 FROM chunked c JOIN p USING (doc_id)")
def prj1_search_documents(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    own = papers.select("doc_id", "source", F.array_join(F.slice("authors", 1, 20), "|").alias("authors"), F.date_format("published", "yyyy-MM-dd").alias("published"))
    return I.chunk_table(papers).join(own, "doc_id").select(F.concat_ws("#", "doc_id", "chunk_index").alias("id"), "source", "authors", "published", F.md5("text").alias("text_md5"))


@registered(f"WITH RECURSIVE {CHUNKS}, p AS ({_PAPER}), n AS (SELECT doc_id, count(*) AS chunk_count, bool_and(indexed) AS whole FROM chunk_state GROUP BY 1) SELECT doc_id, {TITLE.format('text')} AS title, CASE WHEN len(authors) = 0 THEN 'Unknown authors' WHEN len(authors) > 3 THEN concat(array_to_string(authors[1:3], ', '), ' +', len(authors) - 3) ELSE array_to_string(authors, ', ') END AS byline, coalesce(chunk_count, 0) AS chunk_count, NOT coalesce(whole, false) AS needs_indexing FROM p LEFT JOIN n USING (doc_id)")
def prj3_details(spark, sf_dir):
    doc, chunk = F.col("doc_id"), F.col("chunk_index")
    papers = _papers(spark, sf_dir)
    state = I.chunk_table(papers).withColumn("indexed", (doc % 3 != 0) | (chunk == 0))
    out = papers.join(I.completeness(state), "doc_id", "left")
    return out.select("doc_id", T.title_of(F.col("text")).alias("title"), T.byline(F.col("authors")).alias("byline"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), (~F.coalesce("complete", F.lit(False))).alias("needs_indexing"))


@registered(f"WITH p AS ({_PAPER}) SELECT strftime(published, '%Y-%m') AS month, source, count(*) AS n FROM p WHERE published BETWEEN DATE '2024-03-01' AND DATE '2025-06-30' GROUP BY 1, 2")
def flt15_by_month(spark, sf_dir):
    within = _papers(spark, sf_dir).where(F.col("published").between("2024-03-01", "2025-06-30"))
    return within.groupBy(F.date_format("published", "yyyy-MM").alias("month"), "source").agg(F.count("*").alias("n"))


# feeds: documents written as Atom pages and parsed again; some entries lack what they need

@registered(f"""WITH p AS ({_PAPER}) SELECT concat('24', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), '.', lpad(CAST(doc_id AS VARCHAR), 5, '0')) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 + 1 ELSE 1 END AS version, {TITLE.format('text')} AS title, md5({ABSTRACT.format('text')}) AS abstract_md5, CAST(epoch(published) AS BIGINT) AS published,
CAST(epoch(CASE WHEN doc_id % 4 = 0 THEN published + 1 ELSE published END) AS BIGINT) AS updated, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS primary_category, CAST(least(len(authors), 2) AS BIGINT) AS n_authors
FROM p WHERE doc_id % 8 <> 0 AND {TITLE.format('text')} <> '' AND {ABSTRACT.format('text')} <> ''""")
def src6_feed_pages(spark, sf_dir):
    papers = _papers(spark, sf_dir).select("doc_id", "text", "lang", "source", "authors", "published")
    path = staging_path(spark, "feed")
    feeds.written(papers).write.text(path)
    return feeds.entries(spark.read.text(path)).select("paper_id", "version", "title", F.md5("abstract").alias("abstract_md5"), F.unix_seconds("published").alias("published"), F.unix_seconds("updated").alias("updated"), "primary_category", F.size("authors").cast("long").alias("n_authors"))


_SINCE, _UNTIL = datetime(2024, 3, 5), datetime(2025, 6, 20)


@registered(f"""WITH p AS ({_PAPER}), x AS (SELECT *, concat('24', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), '.', lpad(CAST(doc_id AS VARCHAR), 5, '0')) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 + 1 ELSE 1 END AS version FROM p)
SELECT paper_id, version, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS primary_category, concat(source, ',', lang) AS categories, (SELECT count(*) FROM documents) AS total, strftime(published, '%Y-%m-%d') AS published,
  CASE WHEN doc_id % 2 = 0 THEN concat('{feeds.SITE}/page?a=1&id=', doc_id) ELSE concat('{feeds.SITE}/abs/', paper_id, 'v', version) END AS abs_url,
  CASE WHEN doc_id % 3 = 0 THEN concat('{feeds.SITE}/file?a=1&id=', doc_id) ELSE concat('{feeds.SITE}/pdf/', paper_id, 'v', version) END AS pdf_url
FROM x WHERE doc_id % 8 <> 0 AND {TITLE.format('text')} <> '' AND {ABSTRACT.format('text')} <> '' AND published BETWEEN DATE '{_SINCE:%Y-%m-%d}' AND DATE '{_UNTIL:%Y-%m-%d}'""")
def src6_feed_archive(spark, sf_dir):
    """Documents as Atom pages with namespaces, parsed, kept by month, and read for a window."""
    papers = _papers(spark, sf_dir).select("doc_id", "text", "lang", "source", "authors", "published")
    path, root = staging_path(spark, "feed"), staging_path(spark, "feed-archive")
    feeds.written(papers, namespaced=True).write.text(path)
    feeds.archived(feeds.entries(spark.read.text(path)), root)
    found = feeds.published_within(spark, root, _SINCE, _UNTIL)
    return found.select("paper_id", "version", "primary_category", F.array_join("categories", ",").alias("categories"), "total", F.date_format("published", "yyyy-MM-dd").alias("published"), "abs_url", "pdf_url")


@registered(f"""WITH e AS ({_RUN_EVENTS}), r AS (SELECT run, list_sort(list(DISTINCT event_type)) AS categories, min(at_) AS started, count(error) AS failed, max(at_) AS last FROM e GROUP BY 1),
w AS (SELECT categories, first(last ORDER BY started DESC, run DESC) FILTER (failed = 0) AS mark, (SELECT max(ts) FROM events) AS until FROM r GROUP BY 1)
SELECT array_to_string(categories, ',') AS categories, concat('(', array_to_string([concat('cat:', x) FOR x IN categories], ' OR '), ')', CASE WHEN mark IS NOT NULL THEN concat(' AND submittedDate:[', strftime(mark, '%Y%m%d%H%M'), ' TO ', strftime(until, '%Y%m%d%H%M'), ']') END) AS search_text FROM w""")
def src5_search_texts(spark, sf_dir):
    """What each set of categories is asked for next: from its watermark to the last event."""
    events = _run_events(spark, sf_dir)
    sets = events.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("categories"), F.min("at").alias("started"))
    marks = I.watermarks(I.ledger(events).join(sets, "run"))
    out = sets.select("categories").distinct().join(marks, "categories", "left").crossJoin(F.broadcast(events.agg(F.max("at").alias("until"))))  # one row
    return out.select("categories", feeds.search_text(F.split("categories", ","), F.col("watermark").cast("timestamp"), F.col("until").cast("timestamp")).alias("search_text"))


@registered(f"SELECT doc_id, source, md5(text) AS text_md5, CAST({WORDS.format(SQUEEZE.format('text'))} AS BIGINT) AS n_words FROM documents")
def src9_json_corpus(spark, sf_dir):
    """The corpus as JSON lines and back."""
    path = staging_path(spark, "corpus")
    read(spark, sf_dir, "documents").select("doc_id", "source", "text").write.json(path)
    back = spark.read.schema("doc_id long, source string, text string").json(path)
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"), F.size(F.split(T.squeezed(F.col("text")), " ")).cast("long").alias("n_words"))
