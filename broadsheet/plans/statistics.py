"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host


def corpus_statistics(articles: DataFrame) -> DataFrame:
    """One row: article total, distinct scrape days, first and last day.

    Undated articles together count as one more day.
    """
    undated = F.coalesce(F.max(F.col("scrape_date").isNull()), F.lit(False))
    return articles.agg(
        F.count("*").alias("total_articles"),
        (F.count_distinct("scrape_date") + undated.cast("long")).alias("unique_scrape_days"),
        F.min("scrape_date").alias("from_date"),
        F.max("scrape_date").alias("to_date"),
    )


def articles_per_host(articles: DataFrame) -> DataFrame:
    """``host, count``."""
    return (
        articles.groupBy(host(F.col("url")).alias("host"))
        .agg(F.count("*").alias("count"))
        .orderBy("host")
    )


def distinct_dates(articles: DataFrame) -> DataFrame:
    return articles.select("scrape_date").distinct()


def anything_stored(articles: DataFrame) -> bool:
    """Whether there is anything to analyse; reads one row at most."""
    return not articles.isEmpty()
