"""The table of urls still to be read, and the order to read them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain, same_host
from ..session import cut_lineage
from .keys import without_known, without_stored
from .ranking import number_rows
from .sizing import broadcast_if_small


def new_links(found: DataFrame, frontier: DataFrame, articles: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct found urls that no table holds yet."""
    return without_known(found.select("url"), frontier, articles, excluded)


def enqueue(frontier: DataFrame, links: DataFrame, now: Column | None = None) -> DataFrame:
    """The frontier with new links at ``now`` and no attempts yet."""
    moment = F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz") if now is None else now
    fresh = links.select(
        "url", moment.alias("scrape_time"), F.lit(0).cast("int").alias("scrape_retries")
    )
    return frontier.unionByName(fresh)


def purge(frontier: DataFrame, articles: DataFrame, excluded: DataFrame) -> DataFrame:
    """The frontier without urls already stored or rejected.

    The stored urls are first reduced to those of the frontier.
    """
    known = articles.select("url").unionByName(excluded.select("url"))
    return without_stored(frontier, known)


def count_attempts(frontier: DataFrame, attempted: DataFrame) -> DataFrame:
    """Add one to the attempts of each url per row in ``attempted``."""
    attempts = attempted.groupBy("url").agg(F.count("*").alias("_attempts"))
    return frontier.join(attempts, "url", "left").select(
        "url",
        "scrape_time",
        (F.col("scrape_retries") + F.coalesce("_attempts", F.lit(0))).cast("int").alias("scrape_retries"),
    )


def dequeue(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Drop urls that were stored or rejected; failed fetches stay."""
    settled = outcomes.where(F.col("status") != "fetch_error").select("url")
    return frontier.join(settled, "url", "left_anti")


def refresh_needed(frontier: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """One row ``stale``: the frontier is empty, or its newest url too old."""
    limit = as_of - F.make_dt_interval(hours=F.lit(hours))
    return frontier.agg(F.coalesce(F.max("scrape_time") < limit, F.lit(True)).alias("stale"))


def urls_by_domain(frontier: DataFrame) -> DataFrame:
    """``domain, url`` rows; grouped by whoever reads them."""
    return frontier.select(domain(F.col("url")).alias("domain"), "url")


def round_robin(frontier: DataFrame, previous: str | None = None) -> DataFrame:
    """``position, round, domain, url``: one url of each domain per round.

    Within a domain urls go by time and name; within a round domains go by
    their first url.  No domain and no round is ever sorted in one task.  With
    ``previous`` the url before is added under that name.
    """
    queued = frontier.select(domain(F.col("url")).alias("domain"), "scrape_time", "url")
    first_seen = queued.groupBy("domain").agg(F.min(F.struct("scrape_time", "url")).alias("_first"))
    firsts = cut_lineage(
        first_seen.select("domain", F.col("_first.scrape_time").alias("first_time"), F.col("_first.url").alias("first_url"))
    )
    numbered = number_rows(
        queued.join(broadcast_if_small(firsts, "first_url"), "domain"), ["scrape_time", "url"], "round", keys=["domain"]
    )
    named = numbered.select("round", "domain", "url", "first_time", "first_url")
    handed = ("url", previous) if previous else None
    placed = number_rows(named, ["round", "first_time", "first_url"], "position", previous=handed)
    return placed.select("position", "round", "domain", "url", *([previous] if previous else []))


def host_pauses(frontier: DataFrame) -> DataFrame:
    """The round-robin plan of a queue with ``previous_url`` and ``pause``.

    A pause is due where a url begins like the one before it.
    """
    plan = round_robin(frontier, "previous_url")
    return plan.withColumn("pause", same_host(F.col("url"), F.col("previous_url")))
