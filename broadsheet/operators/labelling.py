"""Label each article with the category whose terms occur most often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .matching import (
    INLINE_PHRASES,
    INLINE_WORDS,
    is_phrase,
    known_phrases,
    known_tokens,
    split_terms,
    term_hits,
)
from .sizing import broadcast_if_small, rows_if_at_most

INLINE_CATEGORIES = 64


def keyword_categories(keywords: DataFrame, categories: DataFrame) -> DataFrame:
    """Keywords with their category name: ``keyword, category, load_pos``."""
    return keywords.join(categories, keywords["category_id"] == categories["id"]).select(
        "keyword", "category", "load_pos"
    )


def category_order(dictionary: DataFrame) -> DataFrame:
    """Sort keys that break ties: ``category, no_phrase, first_pos``.

    Categories come in the order of their first phrase, then those with
    single words only in the order of their first word.
    """
    phrase = is_phrase(F.col("keyword"))
    return dictionary.groupBy("category").agg(
        (~F.max(phrase)).alias("no_phrase"),
        F.coalesce(F.min(F.when(phrase, F.col("load_pos"))), F.min("load_pos")).alias("first_pos"),
    )


def category_hits(articles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Hits per article and category: ``url, category, hits`` with hits > 0.

    Only matched terms are shuffled, never a text.
    """
    terms = dictionary.select(F.col("keyword").alias("term"), "category")
    hits = term_hits(articles, terms, keep=["url"])
    summed = hits.groupBy("url", "category").agg(F.sum("hits").alias("hits"))
    return summed.where(F.col("hits") > 0)


def usable_terms(dictionary: DataFrame) -> DataFrame:
    """``keyword, category, load_pos``: each pair once, at its first place, without empty or NULL ones."""
    return (
        dictionary.where((F.col("keyword") != "") & F.col("category").isNotNull())
        .groupBy("keyword", "category")
        .agg(F.min("load_pos").alias("load_pos"))
    )


def ranked_categories(terms: DataFrame) -> DataFrame:
    """``category, rank`` from 1 on: by ``category_order``, then by name; missing places come last.

    The window runs over one row per category.
    """
    order = Window.orderBy("no_phrase", F.col("first_pos").asc_nulls_last(), "category")
    return category_order(terms).select("category", F.row_number().over(order).alias("rank"))


def label_articles(
    articles: DataFrame, dictionary: DataFrame, zero_hit: str = "first", inline: bool = True
) -> DataFrame:
    """``url, scrape_date, label``, one row for each row of ``articles``.

    The label is the category with most hits, ties going to the category of
    lowest rank (``ranked_categories``).  Articles without any hit take the
    first category too, or NULL with ``zero_hit="null"``.  A keyword counts
    once for each of its categories, however often it is listed; NULL and
    empty keywords and NULL categories do not count.  ``inline=False`` takes the
    joined plan for a small dictionary too; the rows are the same.
    """
    if zero_hit not in ("first", "null"):
        raise ValueError("zero_hit is 'first' or 'null'")
    rows = rows_if_at_most(dictionary.select("keyword", "category", "load_pos"), INLINE_WORDS + INLINE_PHRASES) if inline else None
    if rows is not None:
        rows = [r for r in rows if r["keyword"] and r["category"] is not None]
        words, phrases = split_terms({r["keyword"] for r in rows})
        order = listed_order(rows)
        if len(words) <= INLINE_WORDS and len(phrases) <= INLINE_PHRASES and len(order) <= INLINE_CATEGORIES:
            return _label_in_place(articles, rows, order, zero_hit)
    terms = cut_lineage(usable_terms(dictionary))
    ranks = cut_lineage(ranked_categories(terms))
    return _label_by_grouping(articles, terms, ranks, zero_hit)


def listed_order(rows: list[Row]) -> list[str]:
    """The categories of a small dictionary by rank, as ``ranked_categories`` has them."""

    def key(category: str) -> tuple:
        own = [r for r in rows if r["category"] == category]
        places = lambda found: [r["load_pos"] for r in found if r["load_pos"] is not None]
        phrases = [r for r in own if " " in r["keyword"]]
        first = min(places(phrases) or places(own), default=None)
        return not phrases, first is None, first or 0, category.encode()

    return sorted({r["category"] for r in rows}, key=key)


def _label_in_place(articles: DataFrame, terms: list[Row], order: list[str], zero_hit: str) -> DataFrame:
    """The label as a column of the scan: no join, no shuffle."""
    if not terms:
        return articles.select("url", "scrape_date", F.lit(None).cast("string").alias("label"))
    words, phrases = split_terms(sorted({row["keyword"] for row in terms}))
    found = articles.select(
        "url",
        "scrape_date",
        known_tokens(F.col("content"), words).alias("words"),
        known_phrases(F.col("content"), phrases, bounded=False).alias("phrases"),
    )

    def score(category: str) -> Column:
        own = sorted({row["keyword"] for row in terms if row["category"] == category})
        own_words, own_phrases = split_terms(own)
        total = F.lit(0).cast("long")
        if own_words:
            total += F.size(F.filter("words", lambda t: t.isin(own_words)))
        if own_phrases:
            total += F.aggregate(
                F.filter("phrases", lambda p: p["term"].isin(own_phrases)),
                F.lit(0).cast("long"),
                lambda acc, p: acc + p["hits"],
            )
        return total

    best = F.array_max(
        F.array(
            *[
                F.struct(
                    F.coalesce(score(name), F.lit(0).cast("long")).alias("hits"),
                    F.lit(-place).alias("place"),
                    F.lit(name).alias("category"),
                )
                for place, name in enumerate(order)
            ]
        )
    )
    scored = found.select("url", "scrape_date", best.alias("best"))
    label = F.col("best.category")
    if zero_hit == "null":
        label = F.when(F.col("best.hits") > 0, label)
    return scored.select("url", "scrape_date", label.alias("label"))


ARTICLE = ("url", "scrape_date", "_text")


def _told_apart(articles: DataFrame) -> DataFrame:
    """Articles with ``_text``: a hash of the content where url and date repeat, else 0.

    Repeats are found without reading a text.
    """
    repeated = cut_lineage(
        articles.groupBy("url", "scrape_date")
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > 1)
        .select(F.col("url").alias("_url"), F.col("scrape_date").alias("_date"), F.lit(True).alias("_repeated"))
    )
    if repeated.isEmpty():
        return articles.withColumn("_text", F.lit(0).cast("long"))
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("scrape_date").eqNullSafe(F.col("_date"))
    return articles.join(broadcast_if_small(repeated, "_url"), same, "left").select(
        *articles.columns, F.when(F.col("_repeated"), F.xxhash64("content")).otherwise(F.lit(0)).alias("_text")
    )


def _label_by_grouping(articles: DataFrame, terms: DataFrame, ranks: DataFrame, zero_hit: str) -> DataFrame:
    """The label from grouped hits, for dictionaries of any size.

    Hits carry the rank of their category, a number.  Every article adds one
    zero-hit row, so articles without a match keep a label without joining back
    to the corpus; that second scan reads no text but of repeated urls.
    """
    keyed = _told_apart(articles)
    listed = terms.join(ranks, "category").select(F.col("keyword").alias("term"), "rank")
    matched = term_hits(keyed, listed, keep=list(ARTICLE)).drop("term")
    fallback = 1 if zero_hit == "first" else None
    zero = keyed.select(
        *ARTICLE, F.lit(fallback).cast("int").alias("rank"), F.lit(0).cast("long").alias("hits"), F.lit(1).alias("_rows")
    )
    summed = (
        matched.withColumn("_rows", F.lit(0))
        .unionByName(zero)
        .groupBy(*ARTICLE, "rank")
        .agg(F.sum("hits").alias("hits"), F.sum("_rows").alias("_rows"))
    )
    # Without a rank the row can only win while it is the only one.
    best = F.max_by("rank", F.struct(F.col("hits"), -F.coalesce("rank", F.lit(2**31 - 1))))
    labelled = summed.where((F.col("hits") > 0) | (F.col("_rows") > 0)).groupBy(*ARTICLE).agg(
        best.alias("rank"), F.sum("_rows").cast("int").alias("_rows")
    )
    named = labelled.join(broadcast_if_small(ranks, "category"), "rank", "left")
    return named.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(
        "url", "scrape_date", F.col("category").alias("label")
    )
