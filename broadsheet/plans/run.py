"""One run as one call: refresh the queue if it is stale, work it off, publish what came of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import refresh_needed
from ..operators.postings import POSTINGS, laid_out, postings
from ..operators.queue_log import LOG, attempt_rows, compacted, open_queue, queued_rows, settled_rows
from ..schemas import ARTICLES, EXCLUDED, RUN_LOG
from ..session import cut_lineage
from ..sources.runs import next_run, publish, read_runs
from .discover import discover
from .ingest import excluded_rows, frontier_outcomes, run_log_row, stored_rows

SCHEMAS = {"articles": ARTICLES, "exclude_articles": EXCLUDED, "run_log": RUN_LOG, "queue_log": LOG, "postings": POSTINGS}
PARTITIONED = {"articles": ["scrape_date"], "postings": ["bucket"]}


@dataclass
class Crawl:
    """What a run reads: landed pages, the listings to look at, and the rules of the sites."""

    pages: DataFrame
    listings: DataFrame
    link_rules: DataFrame
    sites: DataFrame


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published table; ``queue_log`` is the log, ``frontier`` the queue that it leaves."""
    if name == "frontier":
        return open_queue(read_runs(spark, root, "queue_log", LOG)).drop("opened")
    return read_runs(spark, root, name, SCHEMAS[name]).drop("run")


def full_run(
    spark: SparkSession,
    root: str,
    crawl: Crawl,
    now: Column,
    hours: int = 1,
    levels: int = 1,
    stop_words: Sequence[str] | None = None,
    compact: bool = False,
) -> int:
    """Do a run over the published tables under ``root`` and publish it; its number.

    New links are looked for only where the queue is empty or its newest url
    older than ``hours``.  Every queued url is tried once.  A run that dies
    has published nothing, and the next call does its work again under the
    same number.  With ``compact`` the log is rewritten to the open urls.
    """
    run = next_run(spark, root)
    log = read_runs(spark, root, "queue_log", LOG).drop("run")
    articles, excluded = stored(spark, root, "articles"), stored(spark, root, "exclude_articles")
    queue = cut_lineage(open_queue(log))
    fresh = spark.createDataFrame([], LOG)
    if refresh_needed(queue, now, hours).first()["stale"]:
        found = discover(crawl.pages, crawl.listings, crawl.link_rules, queue, articles, excluded, levels)
        fresh = cut_lineage(queued_rows(found, now, run))
    # Urls that another way has stored or rejected meanwhile leave the queue untried.
    known = articles.select("url").unionByName(excluded.select("url"))
    gone = cut_lineage(settled_rows(queue, known.join(queue.select("url"), "url", "left_semi").distinct()))
    opened = cut_lineage(open_queue(snapshot(queue).unionByName(fresh).unionByName(gone)))
    day = now.cast("date")
    outcomes = cut_lineage(frontier_outcomes(opened, crawl.pages, crawl.sites, day, stop_words))
    kept = stored_rows(outcomes)
    events = fresh.unionByName(gone).unionByName(attempt_rows(opened, outcomes))
    tables = {
        "articles": kept,
        "exclude_articles": excluded_rows(outcomes),
        "postings": laid_out(postings(kept)),
        "run_log": run_log_row(outcomes, now.cast("timestamp_ntz")),
        "queue_log": compacted(log.unionByName(events)) if compact else events,
    }
    publish(spark, root, run, tables, PARTITIONED, bases=["queue_log"] if compact else [])
    return run


def snapshot(queue: DataFrame) -> DataFrame:
    """An open queue as log rows of the stays it has."""
    return queue.select(
        "url", "opened", "scrape_time", F.col("scrape_retries").alias("attempts"), F.lit(False).alias("settled")
    )
