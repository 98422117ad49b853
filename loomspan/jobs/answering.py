"""Queries of answer evaluation: a sweep of the benchmark with responses made from its items.

Each item's response cites passages of its lexical hits; some abstain, some providers fail,
some items have no hit, some citations name no passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.jobs.catalogue import BM, SQUEEZE, TRUTH, lexical, registered, relevant_documents
from loomspan.operators import answering as A
from loomspan.sources.staging import staged
from loomspan.sources.tables import read

_SWEEP = f"""WITH {BM}, {TRUTH},
shelf AS (SELECT item_id, rank AS number, doc_id FROM bm WHERE rank <= 5 AND item_id % 13 <> 0),
resp AS (SELECT item_id, text AS query, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS class,
  CASE WHEN item_id % 5 = 0 THEN concat('**', '{T.ABSTAIN}', '**', chr(10), text) WHEN item_id % 7 = 0 THEN text ELSE concat(text, ' [', item_id % 6 + 1, '] [2] [', item_id % 6 + 1, ']') END AS text,
  CASE WHEN item_id % 11 = 0 THEN 'timed out' END AS failure FROM benchmark),
held AS (SELECT item_id, map_from_entries(list({{'k': number, 'v': doc_id}})) AS shelf FROM shelf GROUP BY 1),
base AS (SELECT r.*, shelf, shelf IS NULL AS bare, shelf IS NOT NULL AND failure IS NOT NULL AS degraded FROM resp r LEFT JOIN held USING (item_id)),
said AS (SELECT *, bare OR (NOT degraded AND item_id % 5 = 0) AS abstained FROM base),
cites AS (SELECT *, CASE WHEN abstained OR degraded THEN [] ELSE [CAST(x AS BIGINT) FOR x IN regexp_extract_all(text, '\\[(\\d+)\\]', 1)] END AS cited FROM said),
known AS (SELECT *, CASE WHEN len(cited) = 0 THEN [] ELSE [x FOR x IN cited IF NOT list_contains(map_keys(shelf), x)] END AS invalid,
  CASE WHEN len(cited) = 0 THEN [] ELSE [shelf[x] FOR x IN cited IF list_contains(map_keys(shelf), x)] END AS found FROM cites),
ids AS (SELECT *, [found[i] FOR i IN range(1, len(found) + 1) IF list_position(found, found[i]) = i] AS cited_ids FROM known),
labels AS (SELECT item_id, list(doc_id) AS relevant FROM truth GROUP BY 1),
swept AS (SELECT i.*, relevant IS NOT NULL AS answerable, abstained <> (relevant IS NOT NULL) AS correct,
  CASE WHEN len(cited_ids) > 0 THEN len([x FOR x IN cited_ids IF list_contains(coalesce(relevant, []), x)]) / len(cited_ids) END AS grounding FROM ids i LEFT JOIN labels USING (item_id))"""

_TOKENS = "CAST(ceil(CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END * 1.7::DOUBLE) AS BIGINT)"


def _sweep(spark, sf_dir) -> DataFrame:
    items, item = read(spark, sf_dir, "benchmark"), F.col("item_id")
    hits = lexical(spark, sf_dir).where((F.col("rank") <= 5) & (item % 13 != 0))
    number = F.concat(F.lit(" ["), (item % 6 + 1).cast("string"), F.lit("]"))
    said = F.when(item % 5 == 0, F.concat(F.lit(f"**{T.ABSTAIN}**\n"), "text")).when(item % 7 == 0, F.col("text")).otherwise(F.concat("text", number, F.lit(" [2]"), number))
    kind = F.when(F.char_length("text") < 200, "short").otherwise("long")
    responses = items.select("item_id", F.col("text").alias("query"), kind.alias("class"), said.alias("text"), F.when(item % 11 == 0, "timed out").alias("failure"))
    answered = A.answers(responses, hits.select("item_id", F.col("rank").alias("number"), "doc_id"))
    return staged(A.outcomes(answered, relevant_documents(spark, sf_dir)), "sweep")


@registered(f"{_SWEEP} SELECT item_id, abstained, degraded, CASE WHEN bare THEN 'no results to ground an answer in' WHEN degraded THEN failure END AS reason, CAST(len(cited) AS BIGINT) AS n_cited, CAST(len(invalid) AS BIGINT) AS n_invalid, len(cited) > 0 AND len(invalid) = 0 AS grounded FROM swept")
def an2_answers(spark, sf_dir):
    n = lambda c: F.size(c).cast("long")
    return _sweep(spark, sf_dir).select("item_id", "abstained", "degraded", "reason", n("cited").alias("n_cited"), n("invalid").alias("n_invalid"), "grounded")


@registered(f"{_SWEEP} SELECT item_id, array_to_string(cited_ids, ',') AS cited_ids FROM swept")
def sc12_cited_ids(spark, sf_dir):
    return _sweep(spark, sf_dir).select("item_id", F.array_join("cited_ids", ",").alias("cited_ids"))


@registered(f"{_SWEEP} SELECT item_id, answerable, correct, round(grounding, 6) AS grounding FROM swept")
def ev19_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("item_id", "answerable", "correct", F.round("grounding", 6).alias("grounding"))


@registered(f"""{_SWEEP} SELECT count(*) AS queries, round(coalesce(avg(CASE WHEN NOT answerable THEN abstained::INT END), 0), 6) AS abstention_rate, round(coalesce(avg(CASE WHEN answerable THEN abstained::INT END), 0), 6) AS false_abstention_rate,
  round(avg(CASE WHEN NOT abstained AND NOT degraded AND len(cited) > 0 THEN (len(cited) - len(invalid)) / len(cited) END), 6) AS citation_precision, round(avg(CASE WHEN answerable THEN grounding END), 6) AS citation_grounding,
  count(*) FILTER (NOT abstained AND NOT degraded AND len(cited) = 0) AS uncited, CAST(sum(len(invalid)) AS BIGINT) AS hallucinated, count(*) FILTER (degraded) AS degraded FROM swept""")
def ag11_abstention_split(spark, sf_dir):
    return A.report(_sweep(spark, sf_dir))


@registered(f"{_SWEEP} SELECT class, answerable, round(avg(grounding), 6) AS grounding, count(grounding) AS n FROM swept GROUP BY 1, 2")
def ag13_grounding(spark, sf_dir):
    return _sweep(spark, sf_dir).groupBy("class", "answerable").agg(F.round(F.avg("grounding"), 6).alias("grounding"), F.count("grounding").alias("n"))


@registered(f"{_SWEEP} SELECT item_id, class, substr(query, 1, 52) AS query, CASE WHEN answerable THEN 'refused a real question' ELSE 'answered anyway' END AS problem FROM swept WHERE NOT correct")
def ev20_failures(spark, sf_dir):
    return A.failures(_sweep(spark, sf_dir))


@registered(f"{_SWEEP} SELECT CAST(sum(CASE WHEN NOT bare AND NOT degraded THEN {_TOKENS.format(SQUEEZE.format('query'))} END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN NOT bare AND NOT degraded THEN {_TOKENS.format(SQUEEZE.format('text'))} END) AS BIGINT) AS completion_tokens, array_to_string(list_sort(list(DISTINCT concat('model-', item_id % 3)) FILTER (NOT bare AND NOT degraded)), ',') AS models FROM swept")
def ag16_usage(spark, sf_dir):
    ran = _sweep(spark, sf_dir).where(~F.col("degraded") & (F.col("reason").isNull()))
    model = F.concat(F.lit("model-"), (F.col("item_id") % 3).cast("string"))
    total = lambda c: F.sum(T.token_estimate(F.col(c))).cast("long")
    return ran.agg(total("query").alias("prompt_tokens"), total("text").alias("completion_tokens"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models"))


@registered(f"{_SWEEP} SELECT count(*) FILTER (degraded) = 0 AS may_write, count(*) FILTER (degraded) AS degraded FROM swept")
def ev24_write_guard(spark, sf_dir):
    return _sweep(spark, sf_dir).agg((F.count_if("degraded") == 0).alias("may_write"), F.count_if("degraded").alias("degraded"))
