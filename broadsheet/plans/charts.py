"""Chart-ready tables.  Drawing is left to the reader's own tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_keyword_bars(keyword_counts: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` bars, coloured by ``category``."""
    return keyword_counts.orderBy(F.desc("count"), "keyword").limit(top)


def category_shares(totals: DataFrame) -> DataFrame:
    """``category, count, share``; the window spans one row per category."""
    everything = Window.partitionBy()
    return totals.withColumn("share", F.col("count") / F.sum("count").over(everything)).orderBy(
        F.desc("count"), "category"
    )


def keyword_series(by_date: DataFrame, kw_1: str, kw_2: str | None = None) -> DataFrame:
    """Long form ``scrape_date, keyword, count`` of one or two series."""
    names = {"kw_1": kw_1} | ({"kw_2": kw_2} if kw_2 else {})
    return (
        by_date.unpivot("scrape_date", list(names), "series", "count")
        .withColumn("keyword", F.coalesce(*[F.when(F.col("series") == s, F.lit(n)) for s, n in names.items()]))
        .select("scrape_date", "keyword", "count")
        .orderBy("scrape_date", "keyword")
    )


OTHER = "other"


def domain_matrix(by_domain: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per domain, one column per category and ``other`` for all else, zeros filled in."""
    if OTHER in categories:
        raise ValueError(f"{OTHER!r} is the column of what is not listed")
    listed = F.coalesce(F.col("category").isin(list(categories)), F.lit(False))
    return (
        by_domain.withColumn("category", F.when(listed, F.col("category")).otherwise(OTHER))
        .groupBy("domain")
        .pivot("category", [*categories, OTHER])
        .agg(F.sum("count"))
        .na.fill(0)
        .orderBy("domain")
    )


def iso3_heat(mentions: DataFrame) -> DataFrame:
    """``iso3_country_code, country, count`` for a world map."""
    return mentions.select("iso3_country_code", "country", "count")
