"""Turn landed pages into stored articles, rejects and queue changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import (
    FETCH_ERROR,
    NOT_FETCHED,
    REJECTED,
    STORED,
    clean_outcomes,
    extract_articles,
    first_pages,
    outcome_counts,
)
from ..operators.frontier import count_attempts, dequeue, purge
from ..operators.keys import without_stored
from ..operators.sizing import broadcast_if_small
from ..session import cut_lineage
from ..sources.tables import append_rows, read_if_there


def page_outcomes(
    pages: DataFrame, sites: DataFrame, scrape_date: Column, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """``url, status, reason, scrape_date, content``, one row per landed url.

    Extraction and cleaning run inside the scan of the pages; neither html
    nor text is shuffled, but for the outcomes of pages that landed in exact
    copies, of which one stays.
    """

    def settled(some: DataFrame) -> DataFrame:
        return clean_outcomes(extract_articles(some, sites), scrape_date, stop_words).drop("page_id")

    chosen, copied = first_pages(pages)
    if copied.isEmpty():
        return settled(chosen)
    listed = broadcast_if_small(copied, "url")
    same = chosen["url"].eqNullSafe(listed["url"])
    once = settled(chosen.join(listed, same, "left_semi")).dropDuplicates(["url"])
    return settled(chosen.join(listed, same, "left_anti")).unionByName(once)


def frontier_outcomes(
    queue: DataFrame,
    pages: DataFrame,
    sites: DataFrame,
    scrape_date: Column,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """One outcome per queued url; urls without a landed page failed to fetch.

    Pages nobody asked for are left out before the parse.  A queue of checked
    small size does that where the pages are read, a larger one by a join that
    can split hot keys.  ``queue`` is read several times; hand in a written one.
    """
    wanted = broadcast_if_small(queue.select("url").distinct(), "url")
    settled = page_outcomes(pages.join(wanted, "url", "left_semi"), sites, scrape_date, stop_words)
    missing = wanted.join(pages.select("url"), "url", "left_anti").select(
        "url",
        F.lit(FETCH_ERROR).alias("status"),
        F.lit(NOT_FETCHED).alias("reason"),
        scrape_date.alias("scrape_date"),
        F.lit(None).cast("string").alias("content"),
    )
    return settled.unionByName(missing)


def stored_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == STORED).select("url", "scrape_date", "content")


def excluded_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == REJECTED).select("url", "reason")


def run_log_row(outcomes: DataFrame, run_at: Column) -> DataFrame:
    return outcome_counts(outcomes).select(run_at.alias("run_at"), "stored", "omitted")


@dataclass
class IngestResult:
    """The rows to append and the frontier that remains."""

    articles: DataFrame
    excluded: DataFrame
    frontier: DataFrame
    run_log: DataFrame


def ingest(
    frontier: DataFrame,
    pages: DataFrame,
    sites: DataFrame,
    articles: DataFrame,
    excluded: DataFrame,
    run_at: Column | None = None,
    stop_words: Sequence[str] | None = None,
) -> IngestResult:
    """Work off the frontier over the landed pages.

    The queue and the outcomes are computed once and written to the shared
    folder; every result below is a narrow read of those copies.  Without
    ``run_at`` the moment of this call is the moment of the run, whenever the
    results are read.
    """
    moment = F.lit(frontier.sparkSession.range(1).select(F.localtimestamp()).first()[0]) if run_at is None else run_at
    day = moment.cast("date")
    queue = cut_lineage(purge(frontier, articles, excluded))
    outcomes = cut_lineage(frontier_outcomes(queue, pages, sites, day, stop_words))
    return IngestResult(
        articles=stored_rows(outcomes),
        excluded=excluded_rows(outcomes),
        frontier=dequeue(count_attempts(queue, outcomes.select("url")), outcomes),
        run_log=run_log_row(outcomes, moment),
    )


def append_result(result: IngestResult, root: str, snapshot: str | None = None) -> None:
    """Add the rows of a run to the stored tables; ``snapshot`` gets the frontier that remains.

    Rows whose key is stored already are left out, so a call that failed
    half-way can be made again.
    """
    keyed = {"articles": (result.articles, "url"), "exclude_articles": (result.excluded, "url"), "run_log": (result.run_log, "run_at")}
    for name, (rows, key) in keyed.items():
        stored = read_if_there(rows.sparkSession, root, name)
        append_rows(rows if stored is None else without_stored(rows, stored, key), root, name)
    if snapshot is not None:
        result.frontier.write.mode("overwrite").parquet(snapshot)
