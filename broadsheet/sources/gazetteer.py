"""Country names with their codes and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Alias names and their country, then names added by hand, and
# the marker for a country without a three-letter code.
ALIASES = [
    ("America", "United States"),
    ("USA", "United States"),
    ("England", "United Kingdom"),
    ("UK", "United Kingdom"),
]
EXTRA_NAMES = [
    ("Macedonia", "MK", "MKD"),
    ("Somalia", "SO", "SOM"),
    ("Timor-Leste", "TL", "TLS"),
]
NO_ISO3 = "NULL"


def alias_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, name string")


def extra_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTRA_NAMES, "name string, iso2 string, iso3 string")


def build_gazetteer(names: DataFrame, iso3_codes: DataFrame, aliases: DataFrame, extras: DataFrame) -> DataFrame:
    """``name, iso2, iso3, canonical``.

    ``names`` is ``pos, iso2, name``: a name listed under several codes keeps
    the first.  ``iso3_codes`` is ``iso2, iso3``.  An extra name replaces a
    listed one; an alias takes the codes of its country.
    """
    by_name = names.groupBy("name").agg(F.min_by("iso2", F.struct("pos", "iso2")).alias("iso2"))
    coded = by_name.join(iso3_codes, "iso2", "left").select(
        "name", "iso2", F.coalesce("iso3", F.lit(NO_ISO3)).alias("iso3")
    )
    listed = coded.join(extras, "name", "left_anti").unionByName(extras.select("name", "iso2", "iso3"))
    alias_rows = aliases.join(coded, "name").select(
        F.col("alias").alias("name"), "iso2", "iso3", F.col("name").alias("canonical")
    )
    return (
        listed.join(aliases.select(F.col("alias").alias("name")), "name", "left_anti")
        .withColumn("canonical", F.col("name"))
        .unionByName(alias_rows)
    )


def world_gazetteer(codes: DataFrame) -> DataFrame:
    """The gazetteer over a table ``pos, iso2, name, iso3`` of all countries, with the fixed aliases."""
    spark = codes.sparkSession
    return build_gazetteer(
        codes.select("pos", "iso2", "name"),
        codes.select("iso2", "iso3"),
        alias_frame(spark),
        extra_frame(spark),
    )
