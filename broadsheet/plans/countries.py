"""Country mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import typed_term
from ..operators.matching import is_phrase
from ..operators.words import term_count
from ..session import cut_lineage


def lowered_names(gazetteer: DataFrame) -> DataFrame:
    """``country, iso3, canonical`` with names as they appear in clean text."""
    return gazetteer.select(
        typed_term(F.col("name")).alias("country"),
        "iso3",
        typed_term(F.coalesce("canonical", "name")).alias("canonical"),
    )


def multi_word_by_iso3(names: DataFrame, mentions: DataFrame) -> DataFrame:
    """``iso3, count`` over the names with a space, zeros kept."""
    return (
        names.where(is_phrase(F.col("country")))
        .join(mentions, F.col("country") == F.col("term"), "left")
        .groupBy("iso3")
        .agg(F.sum(F.coalesce("count", F.lit(0))).cast("long").alias("count"))
    )


def country_mentions(articles: DataFrame, gazetteer: DataFrame, per_name: bool = False) -> DataFrame:
    """``country, iso3_country_code, count`` by falling count.

    Names with a space count bounded matches, pooled per code and given to
    every such name of the code (``per_name=True`` keeps each name's own
    count).  Other names count equal tokens.  Alias names are added to their
    canonical country.  The corpus is scanned once.
    """
    names = lowered_names(gazetteer)
    # At most one row per name: kept, so that both uses share one corpus scan.
    mentions = cut_lineage(
        term_count(articles, names.select(F.col("country").alias("term")), bounded=True)
    )
    any_article = articles.select(F.lit(1)).limit(1).agg(F.count("*") > 0).scalar()
    multi_names = names.where(is_phrase(F.col("country")))
    if per_name:
        multi = multi_names.join(mentions, F.col("country") == F.col("term"), "left").select(
            "canonical", "iso3", F.coalesce("count", F.lit(0)).alias("count")
        )
    else:
        multi = multi_names.join(multi_word_by_iso3(names, mentions), "iso3").select(
            "canonical", "iso3", "count"
        )
    single = (
        names.where(~is_phrase(F.col("country")))
        .join(mentions, F.col("country") == F.col("term"))
        .select("canonical", "iso3", "count")
    )
    return (
        single.unionByName(multi.where(any_article))
        .where(F.col("iso3").isNotNull())
        .groupBy(F.col("canonical").alias("country"), F.col("iso3").alias("iso3_country_code"))
        .agg(F.sum("count").cast("long").alias("count"))
        .orderBy(F.desc("count"), "country", "iso3_country_code")
    )
