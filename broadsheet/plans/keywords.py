"""Keyword reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counting import count_term
from ..operators.matching import is_phrase
from ..operators.words import term_count


def keyword_totals(articles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``keyword, category, count``, unsorted.

    One scan serves words and phrases.  A phrase that never occurs stays with
    zero, a single word that never occurs is left out, and an empty corpus
    gives no rows.
    """
    counted = term_count(articles, dictionary.select(F.col("keyword").alias("term")))
    any_article = articles.select(F.lit(1)).limit(1).agg(F.count("*") > 0).scalar()
    kept_zero = is_phrase(F.col("keyword")) & any_article
    return (
        dictionary.join(counted, dictionary["keyword"] == counted["term"], "left")
        .where(F.col("count").isNotNull() | kept_zero)
        .select("keyword", "category", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    )


def top_keywords(articles: DataFrame, dictionary: DataFrame, top: int | None = None) -> DataFrame:
    """Keywords by falling count, ties by name; only the first ``top`` if given."""
    ordered = keyword_totals(articles, dictionary).orderBy(F.desc("count"), "keyword")
    return ordered if top is None else ordered.limit(top)


def typed(term: str) -> str:
    """A typed term as texts have it: stripped and in lower case.

    One without a letter, or with anything but letters, hyphens and white
    space, is an error.
    """
    stripped = term.strip().lower()
    if not any(c.isalpha() for c in stripped) or not all(c.isalpha() or c.isspace() or c == "-" for c in stripped):
        raise ValueError(f"not a term: {term!r}")
    return stripped


def keywords_by_date(articles: DataFrame, kw_1: str, kw_2: str | None = None) -> DataFrame:
    """``scrape_date, kw_1[, kw_2]``: occurrences per day of typed terms, zero days kept."""
    counts = {"kw_1": count_term(F.col("content"), typed(kw_1))}
    if kw_2:
        counts["kw_2"] = count_term(F.col("content"), typed(kw_2))
    return (
        articles.where(F.col("scrape_date").isNotNull())
        .select("scrape_date", *[value.alias(name) for name, value in counts.items()])
        .groupBy("scrape_date")
        .agg(*[F.sum(name).alias(name) for name in counts])
        .orderBy("scrape_date")
    )
