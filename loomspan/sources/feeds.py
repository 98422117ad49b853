"""Atom pages: written from papers, parsed to rows with what an entry may lack filled in, kept by month.

Prefixes of elements are ignored, so that a page reads alike with and without namespaces. A page
that isn't well-formed is an error, as an empty result would pass for a feed without news; an
entry that lacks what a paper needs is skipped.
"""

from __future__ import annotations

import posixpath
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T

ENTRY = "struct<id:string,title:string,summary:string,published:string,updated:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,primary_category:struct<_term:string>,link:array<struct<_href:string,_rel:string,_title:string>>>"
SCHEMA = f"totalResults string, entry array<{ENTRY}>"
#: Where addresses of papers lie that their entries don't give.
SITE = "https://feed.example"
NAMESPACES = 'xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:feed="http://feed.example/schemas/atom"'


def _escaped(value: Column) -> Column:
    """Text for an XML element, without the characters that XML has no way to hold."""
    plain = F.regexp_replace(value, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", " ")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    return F.regexp_replace(plain, "\n", "&#10;")


def written(papers: DataFrame, per_page: int = 25, namespaced: bool = False) -> DataFrame:
    """Pages, one a line, of ``per_page`` papers (doc_id, text, lang, source, authors, published).

    Every eighth has no date, some lack an update, a primary category or a version. With
    namespaces, pages tell the number of all papers, and papers have a second category and
    some of them links.
    """
    i, element = F.col("doc_id"), lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    paper_id = F.concat(F.lit("http://feed.example/abs/24"), F.lpad((i % 100).cast("string"), 2, "0"), F.lit("."), F.lpad(i.cast("string"), 5, "0"), F.when(i % 3 == 0, F.concat(F.lit("v"), (i % 9 + 1).cast("string"))).otherwise(""))
    day = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    term = lambda name, value: F.concat(F.lit(f'<{name} term="'), value, F.lit('"/>'))
    link = lambda rel, more, kind: F.concat(F.lit(f'<link rel="{rel}"{more} href="{SITE}/{kind}?a=1&amp;id='), i.cast("string"), F.lit('"/>'))
    entry = F.concat(
        F.lit("<entry>"),
        element("id", paper_id),
        element("title", _escaped(F.split_part("text", F.lit("\n"), F.lit(1)))),
        element("summary", _escaped(F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit("")))),
        F.when(i % 8 != 0, element("published", day("published"))).otherwise(""),
        F.when(i % 4 == 0, element("updated", day(F.date_add("published", 1)))).otherwise(""),
        F.array_join(F.transform(F.slice("authors", 1, 2), lambda a: F.concat(F.lit("<author><name>"), _escaped(a), F.lit("</name></author>"))), ""),
        F.when(i % 5 == 0, term("feed:primary_category" if namespaced else "primary_category", F.col("lang"))).otherwise(""),
        term("category", F.col("source")),
        *([term("category", F.col("lang")), F.when(i % 2 == 0, link("alternate", "", "page")).otherwise(""), F.when(i % 3 == 0, link("related", ' title="pdf"', "file")).otherwise("")] if namespaced else []),
        F.lit("</entry>"),
    )
    pages = papers.select(F.floor(i / per_page).alias("page"), entry.alias("entry")).groupBy("page").agg(F.collect_list("entry").alias("e"))
    if not namespaced:
        return pages.select(F.concat(F.lit("<feed><totalResults>"), F.size("e"), F.lit("</totalResults>"), F.array_join("e", ""), F.lit("</feed>")).alias("value"))
    total = F.broadcast(papers.agg(F.count("*").alias("total")))  # one row
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><feed {NAMESPACES}><opensearch:totalResults>'), F.col("total").cast("string"), F.lit("</opensearch:totalResults>"))
    return pages.crossJoin(total).select(F.concat(head, F.array_join("e", ""), F.lit("</feed>")).alias("value"))


def entries(pages: DataFrame, site: str = SITE) -> DataFrame:
    """The papers of pages (value), with the ``total`` that their page tells, 0 if it is no number.

    Entries without id, title, abstract or date are skipped. Without an update the date of
    publication stands, without a primary category the first one, without links addresses
    below ``site``. Of several links of a kind the last one counts.
    """
    feed = F.from_xml("value", SCHEMA, {"mode": "FAILFAST", "rowTag": "feed", "ignoreNamespace": "true"})
    e = pages.select(feed.alias("f")).select(F.coalesce(F.col("f.totalResults").try_cast("bigint"), F.lit(0)).alias("total"), F.explode("f.entry").alias("e")).select("total", "e.*")
    name = T.versioned(F.trim(F.element_at(F.split("id", "/abs/"), -1)))
    published = T.timestamp_of(F.col("published"))
    none = F.array().cast("array<string>")
    terms = F.filter(F.coalesce(F.transform("category", lambda c: c["_term"]), none), lambda t: F.coalesce(t, F.lit("")) != "")
    pdf = lambda x: F.coalesce(x["_title"] == "pdf", F.lit(False))
    last = lambda which: F.nullif(F.coalesce(F.get(F.reverse(F.filter("link", which)), F.lit(0))["_href"], F.lit("")), F.lit(""))
    place = lambda kind: F.concat(F.lit(f"{site}/{kind}/"), name["base"], F.lit("v"), name["version"].cast("string"))
    rows = e.select(
        name["base"].alias("paper_id"),
        name["version"].alias("version"),
        T.squeezed(F.coalesce("title", F.lit(""))).alias("title"),
        T.squeezed(F.coalesce("summary", F.lit(""))).alias("abstract"),
        published.alias("published"),
        F.coalesce(T.timestamp_of(F.col("updated")), published).alias("updated"),
        F.transform(F.filter(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(a["name"], F.lit("")) != ""), lambda a: T.squeezed(a["name"])).alias("authors"),
        terms.alias("categories"),
        F.coalesce(F.nullif(F.col("primary_category._term"), F.lit("")), F.get(terms, F.lit(0)), F.lit("")).alias("primary_category"),
        F.coalesce(last(lambda x: ~pdf(x) & F.coalesce(x["_rel"] == "alternate", F.lit(False))), place("abs")).alias("abs_url"),
        F.coalesce(last(pdf), place("pdf")).alias("pdf_url"),
        "total",
    )
    return rows.where("paper_id <> '' and title <> '' and abstract <> '' and published is not null")


def archived(papers: DataFrame, root: str) -> None:
    """Papers as files by month of publication."""
    by_month = papers.withColumn("month", F.date_format("published", "yyyy-MM"))
    by_month.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(posixpath.join(root, "papers"))


def published_within(spark: SparkSession, root: str, since: datetime, until: datetime) -> DataFrame:
    """Archived papers of a window, both ends included; other months' files aren't read."""
    month = lambda t: t.strftime("%Y-%m")
    papers = spark.read.option("basePath", posixpath.join(root, "papers")).parquet(posixpath.join(root, "papers"))
    return papers.where(F.col("month").cast("string").between(month(since), month(until)) & F.col("published").between(since, until)).drop("month")


def search_text(categories: Column, since: Column, until: Column) -> Column:
    """What asks a feed for categories in a window of submission, in minutes of UTC; without ``since`` for all time."""
    clause = F.concat(F.lit("("), F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR "), F.lit(")"))
    minute = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyyMMddHHmm")
    window = F.concat(F.lit(" AND submittedDate:["), minute(since), F.lit(" TO "), minute(until), F.lit("]"))
    return F.concat(clause, F.coalesce(window, F.lit("")))
