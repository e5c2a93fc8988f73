"""Counts of words and phrases over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counting import tokens
from .matching import distinct_terms, is_phrase, term_hits


def word_count(articles: DataFrame) -> DataFrame:
    """``word, count`` over all tokens of all articles."""
    return (
        articles.select(F.explode(tokens(F.col("content"))).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("count"))
    )


def term_count(articles: DataFrame, terms: DataFrame, bounded: bool = False) -> DataFrame:
    """``term, count`` for each term found.

    Tokens meet the dictionary before they are counted, so only dictionary
    terms are shuffled and not the vocabulary of the corpus.
    """
    counted = term_hits(articles, terms, bounded=bounded).groupBy("term").agg(F.sum("hits").alias("count"))
    return counted.where(F.col("count") > 0)


def phrase_count(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """``phrase, count`` for every phrase among ``terms``, zeros kept.

    Without any article there is no row at all.
    """
    phrases = distinct_terms(terms).where(is_phrase(F.col("term")))
    any_article = articles.select(F.lit(1)).limit(1).agg(F.count("*") > 0).scalar()
    return (
        phrases.join(term_count(articles, phrases), "term", "left")
        .where(any_article)
        .select(F.col("term").alias("phrase"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    )
