"""Reports from stored sums: a new day is read once and added, and old days are not read again.

Each call publishes the partial sums of the days it found new: the category
cube, and keyword hits by day.  Sums of several runs merge by adding, so every
report is the same as over all articles at once.  Undated articles are a day
of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labelling import label_articles
from ..operators.matching import distinct_terms, term_hits
from ..session import cut_lineage
from ..sources.runs import next_run, publish, read_runs
from .categories import category_cube

DAYS = "scrape_date date"
HITS = "scrape_date date, term string, hits bigint"
CUBE = "scrape_date date, domain string, category string, count bigint"


def new_days(spark: SparkSession, root: str, articles: DataFrame) -> DataFrame:
    """The scrape dates of ``articles`` whose sums are not stored yet; no text is read."""
    days = articles.select("scrape_date").distinct()
    done = read_runs(spark, root, "days", DAYS).select(F.col("scrape_date").alias("_done"))
    return days.join(F.broadcast(done), F.col("scrape_date").eqNullSafe(F.col("_done")), "left_anti")


def add_days(spark: SparkSession, root: str, articles: DataFrame, dictionary: DataFrame) -> int:
    """Publish the sums of all days that are new, and give their number.

    A day must be complete when it is added.  Where articles lie in folders by
    scrape date, only the folders of these days are read.
    """
    days = cut_lineage(new_days(spark, root, articles))
    dates = [r["scrape_date"] for r in days.collect()]  # one row per day
    if not dates:
        return 0
    dated = F.col("scrape_date").isin([d for d in dates if d is not None])
    own = articles.where(dated | F.col("scrape_date").isNull() if None in dates else dated)
    cube = category_cube(label_articles(own, dictionary))
    terms = cut_lineage(distinct_terms(dictionary, "keyword"))
    hits = term_hits(own, terms, keep=["scrape_date"]).groupBy("scrape_date", "term").agg(F.sum("hits").alias("hits"))
    publish(spark, root, next_run(spark, root), {"cube": cube, "hits": hits.where("hits > 0"), "days": days})
    return len(dates)


def stored_cube(spark: SparkSession, root: str) -> DataFrame:
    """The category cube of all days so far, as the category reports take it."""
    return read_runs(spark, root, "cube", CUBE).drop("run")


def stored_hits(spark: SparkSession, root: str) -> DataFrame:
    """``scrape_date, term, hits``, words as equal tokens and phrases wherever they stand."""
    return read_runs(spark, root, "hits", HITS).groupBy("scrape_date", "term").agg(F.sum("hits").alias("hits"))


def stored_keyword_totals(spark: SparkSession, root: str, dictionary: DataFrame) -> DataFrame:
    """``keyword, category, count`` over all days: words with hits, and every phrase."""
    totals = stored_hits(spark, root).groupBy(F.col("term").alias("keyword")).agg(F.sum("hits").alias("count"))
    listed = dictionary.select("keyword", "category").join(totals, "keyword", "left")
    phrase = F.contains("keyword", F.lit(" "))
    return listed.withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).where(phrase | (F.col("count") > 0))
