"""Queries of what is stored: bucketed tables, published evaluation runs, listings.

The store takes documents, then a harvest that has lost some abstracts or texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.jobs.catalogue import ABSTRACT, ALL, CHUNKS, HASH, TITLE, _embed_sql, all_scores, registered
from loomspan.jobs.ingesting import _AGAIN, _again
from loomspan.operators import ingest as I
from loomspan.operators import retrieval as R
from loomspan.operators.evaluation import HEADLINE
from loomspan.operators.runs import RunLog
from loomspan.operators.store import Store
from loomspan.sources.listing import Listing
from loomspan.sources.staging import staging_path
from loomspan.sources.tables import read

_HARVEST = f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN split_part(text, chr(10), 1) WHEN doc_id % 29 = 0 THEN NULL ELSE text END AS text FROM ({_AGAIN})"
_WHY = f"CASE WHEN text IS NULL THEN 'no text' WHEN {TITLE.format('text')} = '' THEN 'no title' WHEN {ABSTRACT.format('text')} = '' THEN 'no abstract' END"
_STORED = f"""harvest AS ({_HARVEST}), first_run AS (SELECT doc_id, text, {_WHY} AS error FROM documents), old AS (SELECT doc_id, text FROM first_run WHERE error IS NULL),
second_run AS (SELECT n.doc_id, n.text, n.error, CASE WHEN n.error IS NOT NULL THEN 'failed' WHEN o.doc_id IS NULL THEN 'created' WHEN {HASH.format('o.text')} = {HASH.format('n.text')} THEN 'skipped' ELSE 'updated' END AS action FROM (SELECT *, {_WHY} AS error FROM harvest) n LEFT JOIN old o USING (doc_id)),
papers AS (SELECT doc_id, text FROM second_run WHERE action IN ('created', 'updated') UNION ALL SELECT doc_id, text FROM old WHERE doc_id NOT IN (SELECT doc_id FROM second_run WHERE action IN ('created', 'updated')))"""


def _stored(spark, sf_dir) -> Store:
    i = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lost = F.when(i % 13 == 0, F.split_part("text", F.lit("\n"), F.lit(1))).when(i % 29 == 0, F.lit(None)).otherwise(F.col("text"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Store(spark, staging_path(spark, "store"), buckets).ingest(docs).ingest(_again(docs).withColumn("text", lost))


@registered(f"WITH {_STORED} SELECT doc_id, md5(text) AS text_md5, {HASH.format('text')} AS content_hash FROM papers")
def snk1_bucketed_papers(spark, sf_dir):
    return _stored(spark, sf_dir).table("papers").select("doc_id", F.md5("text").alias("text_md5"), "content_hash")


def _counted(run: int, table: str, created: str, updated: str, skipped: str) -> str:
    return f"""SELECT {run} AS version, CASE WHEN count(error) > 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS seen, count(*) FILTER ({created}) AS created, count(*) FILTER ({updated}) AS updated, count(*) FILTER ({skipped}) AS skipped, count(error) AS failed,
coalesce(array_to_string(list_slice(list(concat(doc_id, ': ', error) ORDER BY doc_id) FILTER (error IS NOT NULL), 1, 20), chr(10)), '') AS errors FROM {table}"""


@registered(f"WITH {_STORED} {_counted(0, 'first_run', 'error IS NULL', 'false', 'false')} UNION ALL {_counted(1, 'second_run', *[f'''action = '{a}' ''' for a in ('created', 'updated', 'skipped')])}")
def snk9_observed_ledger(spark, sf_dir):
    """Ledger rows of two ingests, counted while they wrote."""
    return _stored(spark, sf_dir).ledger().select("version", "status", "seen", "created", "updated", "skipped", "failed", "errors")


_WHOLE = CHUNKS.replace("FROM documents", "FROM old")


@registered(f"WITH RECURSIVE {_STORED},{_WHOLE}, c AS (SELECT concat(doc_id, '#', chunk_index) AS id, text FROM chunked), {_embed_sql('e', 'id', 'c')} SELECT k AS id, {R.BUCKETS} AS width, count(*) AS n_buckets, round(sum(weight * weight), 6) AS norm FROM e GROUP BY 1")
def snk14_stored_vectors(spark, sf_dir):
    """Hashed embeddings of a store's chunks, written beside them and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store = Store(spark, staging_path(spark, "store"), buckets).ingest(docs)
    store.store_vectors(R.embedding_arrays(store.table("chunks"), ["doc_id", "chunk_index"]), R.BUCKETS)
    kept = F.filter("vector", lambda x: x != 0)
    norm = F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * x), 6)
    return store.table("vectors").select(F.concat_ws("#", "doc_id", "chunk_index").alias("id"), F.size("vector").cast("long").alias("width"), F.size(kept).cast("long").alias("n_buckets"), norm.alias("norm"))


# evaluation runs, published one after the other; the second is held to the first's baseline


def _published(spark, sf_dir) -> tuple[RunLog, int]:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    scored = all_scores(spark, sf_dir)
    known = {"papers": docs.count(), "chunks": I.chunk_table(docs).count(), "golden_set_version": 1, "top_k": 10}
    log = RunLog(spark, staging_path(spark, "runs"))
    first = log.publish(scored, known, "first")
    log.write_baseline("gate", first, "hybrid")
    seen = scored.join(items.where("item_id % 2 = 0").select("item_id"), "item_id", "left_semi")
    return log, log.publish(seen, known, "second")


_MEANS = lambda mode, where: f"(SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in HEADLINE)}, count(*) AS queries FROM scored WHERE mode = '{mode}' AND {where})"
_GATED = ["queries", *HEADLINE]


@registered(f"""WITH RECURSIVE {CHUNKS},{ALL}, b AS {_MEANS('hybrid', 'true')}, a AS {_MEANS('bm25', 'item_id % 2 = 0')},
k AS (SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM chunked) AS chunks)
{' UNION ALL '.join(f"SELECT '{c}' AS subject, CAST(b.{c} AS DOUBLE) AS before, CAST(a.{c} AS DOUBLE) AS after, {'b.queries <> a.queries' if c == 'queries' else f'a.{c} < b.{c} - 0.02'} AS failed FROM a, b" for c in _GATED)}
UNION ALL SELECT 'papers', papers, papers, false FROM k UNION ALL SELECT 'chunks', chunks, chunks, false FROM k UNION ALL SELECT 'golden_set_version', 1, 1, false UNION ALL SELECT 'top_k', 10, 10, false""")
def ev15_stored_gate(spark, sf_dir):
    """The gate of a published run against a stored baseline."""
    log, run = _published(spark, sf_dir)
    return log.gate("gate", run, "bm25")


@registered(f"""WITH {ALL} SELECT run, "commit", mode, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in HEADLINE)} FROM (SELECT 0 AS run, 'first' AS "commit", * FROM scored UNION ALL SELECT 1, 'second', * FROM scored WHERE item_id % 2 = 0) GROUP BY ALL""")
def snk10_published_runs(spark, sf_dir):
    return _published(spark, sf_dir)[0].runs().select("run", "commit", "mode", "queries", *HEADLINE)


# listings: every row has its place, and a page reads its own range

_PLACED = "SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents"


@registered(f"SELECT * FROM ({_PLACED})")
def src14_places(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return Listing.write(docs, [F.desc("n_chars"), F.asc("doc_id")], staging_path(spark, "listing")).rows()


@registered(f"SELECT * FROM ({_PLACED}) WHERE place BETWEEN 121 AND 140")
def src14_page(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return Listing.write(docs, [F.desc("n_chars"), F.asc("doc_id")], staging_path(spark, "listing")).page(7)
