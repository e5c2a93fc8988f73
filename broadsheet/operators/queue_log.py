"""The queue of urls as a log that is only appended to.

A row says what happened to a url once: it was queued, tried, or settled.  Its
stay in the queue is named by the run that queued it, so that a url that comes
back later starts anew.  The state is a sum over the log, in any order, and
partial sums merge: a run adds one row for each attempt and rewrites nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "url string, opened bigint, scrape_time timestamp_ntz, attempts int, settled boolean"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def queued_rows(links: DataFrame, now: Column, run: int) -> DataFrame:
    """Log rows that queue ``links``, distinct urls, at ``now``."""
    return links.select(
        "url",
        F.lit(run).cast("bigint").alias("opened"),
        now.cast("timestamp_ntz").alias("scrape_time"),
        F.lit(0).cast("int").alias("attempts"),
        F.lit(False).alias("settled"),
    )


def snapshot_rows(frontier: DataFrame, run: int) -> DataFrame:
    """Log rows for a queue that was kept as a table until now."""
    return frontier.select(
        "url",
        F.lit(run).cast("bigint").alias("opened"),
        "scrape_time",
        F.col("scrape_retries").alias("attempts"),
        F.lit(False).alias("settled"),
    )


def _event(opened: DataFrame, events: DataFrame, attempts: int, settled: Column) -> DataFrame:
    """One row for each event of an open url; ``opened`` has ``url, opened``."""
    return events.join(opened.select("url", "opened"), "url").select(
        "url",
        "opened",
        F.lit(None).cast("timestamp_ntz").alias("scrape_time"),
        F.lit(attempts).cast("int").alias("attempts"),
        settled.alias("settled"),
    )


def attempt_rows(opened: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each attempt; all but failed fetches settle their url."""
    return _event(opened, outcomes.select("url", "status"), 1, F.col("status") != "fetch_error")


def settled_rows(opened: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that take urls known elsewhere out of the queue."""
    return _event(opened, known.select("url"), 0, F.lit(True))


def open_queue(log: DataFrame) -> DataFrame:
    """The queue that the log leaves: ``url, opened, scrape_time, scrape_retries``."""
    return (
        log.groupBy("url", "opened")
        .agg(F.max("scrape_time").alias("scrape_time"), F.sum("attempts").alias("_attempts"), F.max("settled").alias("_settled"))
        .where(~F.col("_settled"))
        .select("url", "opened", "scrape_time", F.col("_attempts").cast("int").alias("scrape_retries"))
    )


def compacted(log: DataFrame) -> DataFrame:
    """A log with one row for each url still queued, to be published as a new base."""
    return open_queue(log).select(
        "url", "opened", "scrape_time", F.col("scrape_retries").alias("attempts"), F.lit(False).alias("settled")
    )
