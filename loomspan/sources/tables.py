"""The tables that jobs read, and feed entries taken from raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_entries(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, n_links) of pages that have a title; others are skipped."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    return (
        pages.select(
            "page_id",
            title.alias("title"),
            F.coalesce(F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("")), F.lit("und")).alias("lang"),
            F.size(F.regexp_extract_all("html", F.lit("(<a href=)"), 1)).cast("long").alias("n_links"),
        )
        .where("title <> ''")
    )


def page(df: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """One page, from 1, of a listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
