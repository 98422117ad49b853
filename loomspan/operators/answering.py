"""Answers over numbered passages: what was cited, abstained from, degraded and grounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import abstained, citations

# Fixed values of reports.
NOTHING_FOUND = "no results to ground an answer in"
PROBLEMS = ("refused a real question", "answered anyway")


def answers(responses: DataFrame, passages: DataFrame) -> DataFrame:
    """Reads responses (item_id, text, failure) against passages (item_id, number, doc_id).

    Without passages the answer abstains whatever the model says; a failure (null if there is
    none) makes it degraded, which is no abstention. Of the other answers those that don't
    abstain are parsed: ``cited`` numbers in order with repeats, ``invalid`` ones that name no
    passage, ``cited_ids`` distinct in order of citation. ``grounded``: at least one citation,
    none of them invalid.
    """
    shelf = passages.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "doc_id"))).alias("shelf"))
    rows = responses.join(shelf, "item_id", "left")
    none, failed = F.col("shelf").isNull(), F.col("shelf").isNotNull() & F.col("failure").isNotNull()
    rows = rows.withColumn("abstained", none | (~failed & F.coalesce(abstained(F.col("text")), F.lit(False)))).withColumn("degraded", failed)
    reason = F.when(none, NOTHING_FOUND).when(failed, F.col("failure"))
    silent = F.col("abstained") | F.col("degraded")
    empty = F.array().cast("array<bigint>")
    rows = rows.withColumn("reason", reason).withColumn("cited", F.when(silent, empty).otherwise(F.coalesce(citations(F.col("text")), empty)))
    known = lambda x: F.map_contains_key("shelf", x)
    rows = rows.withColumn("invalid", F.filter("cited", lambda x: ~known(x)))
    ids = F.array_distinct(F.transform(F.filter("cited", known), lambda x: F.element_at("shelf", x)))
    rows = rows.withColumn("cited_ids", F.when(F.size("cited") > 0, ids).otherwise(empty))
    return rows.withColumn("grounded", (F.size("cited") > 0) & (F.size("invalid") == 0)).drop("shelf")


def outcomes(answered: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``answerable``, ``correct`` and ``grounding``: the share of cited ids that are relevant."""
    labels = truth.groupBy("item_id").agg(F.collect_set("doc_id").alias("relevant"))
    rows = answered.join(labels, "item_id", "left").withColumn("answerable", F.col("relevant").isNotNull())
    hits = F.size(F.array_intersect("cited_ids", "relevant"))
    grounding = F.when(F.size("cited_ids") > 0, F.coalesce(F.when(F.col("answerable"), hits), F.lit(0)) / F.size("cited_ids"))
    return rows.withColumn("correct", F.col("abstained") != F.col("answerable")).withColumn("grounding", grounding).drop("relevant")


def report(swept: DataFrame) -> DataFrame:
    """One row of rates and counts of a sweep; rates of no rows are 0, averages null."""
    rate = lambda of: F.round(F.coalesce(F.avg(F.when(of, F.col("abstained").cast("int"))), F.lit(0.0)), 6)
    answerable, n = F.col("answerable"), F.size("cited")
    spoke = ~F.col("abstained") & ~F.col("degraded")
    return swept.agg(
        F.count("*").alias("queries"),
        rate(~answerable).alias("abstention_rate"),
        rate(answerable).alias("false_abstention_rate"),
        F.round(F.avg(F.when(spoke & (n > 0), (n - F.size("invalid")) / n)), 6).alias("citation_precision"),
        F.round(F.avg(F.when(answerable, F.col("grounding"))), 6).alias("citation_grounding"),
        F.count_if(spoke & (n == 0)).alias("uncited"),
        F.coalesce(F.sum(F.size("invalid")), F.lit(0)).cast("long").alias("hallucinated"),
        F.count_if("degraded").alias("degraded"),
    )


def failures(swept: DataFrame, chars: int = 52) -> DataFrame:
    """(item_id, class, query, problem) of every wrong decision to abstain."""
    problem = F.when(F.col("answerable"), PROBLEMS[0]).otherwise(PROBLEMS[1])
    return swept.where(~F.col("correct")).select("item_id", "class", F.substring("query", 1, chars).alias("query"), problem.alias("problem"))
