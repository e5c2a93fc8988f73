"""Category reports over labelled articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain


def category_cube(labelled: DataFrame) -> DataFrame:
    """``scrape_date, domain, category, count``.

    Classify once, keep this small table (``cut_lineage`` or a written table)
    and take all three reports from it.
    """
    return labelled.groupBy(
        "scrape_date", domain(F.col("url")).alias("domain"), F.col("label").alias("category")
    ).agg(F.count("*").alias("count"))


def _rolled_up(cube: DataFrame, *by: str) -> DataFrame:
    return cube.groupBy(*by).agg(F.sum("count").alias("count"))


def category_totals(cube: DataFrame) -> DataFrame:
    """``category, count`` by falling count."""
    return _rolled_up(cube, "category").orderBy(F.desc("count"), "category")


def categories_by_date(cube: DataFrame) -> DataFrame:
    """``scrape_date, category, count``; undated articles drop out."""
    dated = cube.where(F.col("scrape_date").isNotNull())
    return _rolled_up(dated, "scrape_date", "category").orderBy("scrape_date", F.desc("count"), "category")


def categories_by_domain(cube: DataFrame) -> DataFrame:
    """``domain, category, count``."""
    return _rolled_up(cube, "domain", "category").orderBy("domain", F.desc("count"), "category")
