"""Registered queries over stored layouts: published runs, the queue log, the word index, buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from broadsheet.operators import postings, queue_log
from broadsheet.plans import categories, report_state, run
from broadsheet.session import cut_lineage, shared_dir
from broadsheet.sources import buckets, runs
from broadsheet.sources import documents as landed

from . import fixtures as fx
from .spark_queries import QUERIES, RUN_AT, _register, canonical_links, extract_links


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- the word index ----------------------------------------------------------


def _index(spark, sf_dir):
    """The index of the corpus, published in two batches."""
    root = _root(spark, "index")
    articles = fx.articles(spark, sf_dir)
    late = F.dayofmonth("scrape_date") > 15
    for number, batch in enumerate([articles.where(~late), articles.where(late)], 1):
        rows = postings.laid_out(postings.postings(batch))
        runs.publish(spark, root, number, {"postings": rows}, run.PARTITIONED)
    return runs.read_runs(spark, root, "postings", postings.POSTINGS).drop("run")


def _listed_terms(spark, sf_dir):
    """The terms of both dictionaries, and some that come close to others."""
    more = spark.createDataFrame([(t,) for t in fx.CLOSE_TERMS], "term string")
    named = fx.benchmark_dictionary(spark, sf_dir).select(F.col("keyword").alias("term"))
    own = fx.dictionary(spark).select(F.col("keyword").alias("term"))
    return cut_lineage(named.unionByName(own).unionByName(more).distinct())


@_register
def indexed_terms(spark, sf_dir):
    """Hits of every listed term in every article, from the index alone."""
    return postings.indexed_hits(_index(spark, sf_dir), _listed_terms(spark, sf_dir)).select("term", "url", "hits")


@_register
def indexed_keywords_by_date(spark, sf_dir):
    """Two terms per day; the texts are not read."""
    wanted = [fx.KEYWORD_A, fx.KEYWORD_B]
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")
    days = fx.articles(spark, sf_dir, "scrape_date").distinct()
    return postings.hits_by_date(postings.indexed_hits(_index(spark, sf_dir), terms), days, wanted)


# -- the queue as a log ------------------------------------------------------


def _queue_log(spark, sf_dir):
    return cut_lineage(queue_log.snapshot_rows(fx.frontier(spark, sf_dir), 0))


@_register
def logged_attempts(spark, sf_dir):
    """The queue after attempts that all failed, as one log row each."""
    log = _queue_log(spark, sf_dir)
    tried = fx.stored_urls(spark, sf_dir).unionByName(fx.excluded_urls(spark, sf_dir).select("url"))
    events = queue_log.attempt_rows(queue_log.open_queue(log), tried.withColumn("status", F.lit("fetch_error")))
    return queue_log.open_queue(log.unionByName(events)).drop("opened")


@_register
def logged_purge(spark, sf_dir):
    """The queue after known urls were settled, compacted on the way."""
    log = _queue_log(spark, sf_dir)
    known = fx.stored_urls(spark, sf_dir).unionByName(fx.excluded_urls(spark, sf_dir).select("url")).distinct()
    events = queue_log.settled_rows(queue_log.open_queue(log), known)
    return queue_log.open_queue(queue_log.compacted(log.unionByName(events))).drop("opened")


# -- stored urls by bucket ---------------------------------------------------


@_register
def new_links_bucketed(spark, sf_dir):
    """New links against stored tables that lie in buckets; only the links are shuffled."""
    root, tag = _root(spark, "buckets"), uuid.uuid4().hex
    tables = {
        "queued": fx.frontier(spark, sf_dir),
        "stored": fx.stored_urls(spark, sf_dir),
        "excluded": fx.excluded_urls(spark, sf_dir),
    }
    for name, rows in tables.items():
        buckets.write_bucketed(rows.select("url"), f"{name}_{tag}", f"{root}/{name}", buckets=16)
    found = canonical_links(spark, sf_dir).unionByName(extract_links(spark, sf_dir)).select("url")
    known = [buckets.read_bucketed(spark, f"{name}_{tag}") for name in tables]
    return buckets.without_bucketed(found, *known)


# -- a whole run -------------------------------------------------------------


def _run(spark, sf_dir):
    """Two runs from nothing: every page links to its own url; http pages fail and stay queued.

    The second run finds the queue fresh, tries what is left and compacts the log.
    """
    root = _root(spark, "run")
    html = F.when(
        F.startswith("url", F.lit("https")), F.concat("html", F.lit('<a href="'), "url", F.lit('">self</a>'))
    )
    pages = landed.pages(spark, sf_dir).withColumn("html", html)
    listed = fx.listings(spark, sf_dir).withColumn("page", F.lit("/"))
    rules = fx.link_rules(spark, sf_dir).withColumn("url_filter", F.lit("."))
    crawl = run.Crawl(pages, listed, rules, fx.sites(spark, sf_dir))
    first = F.to_timestamp_ntz(F.lit(RUN_AT))
    for minutes in (0, 30):
        now = first + F.make_dt_interval(mins=F.lit(minutes))
        run.full_run(spark, root, crawl, now, stop_words=fx.STOP_WORDS, compact=minutes > 0)
    return root


@_register
def run_articles(spark, sf_dir):
    return run.stored(spark, _run(spark, sf_dir), "articles")


@_register
def run_excluded(spark, sf_dir):
    return run.stored(spark, _run(spark, sf_dir), "exclude_articles")


@_register
def run_log(spark, sf_dir):
    return run.stored(spark, _run(spark, sf_dir), "run_log")


@_register
def run_frontier(spark, sf_dir):
    return run.stored(spark, _run(spark, sf_dir), "frontier")


# -- reports from stored sums ------------------------------------------------


def _state(spark, sf_dir):
    """Sums of the corpus, added in two calls; the second finds half of the days new, a third none."""
    root = _root(spark, "state")
    articles, dictionary = fx.articles(spark, sf_dir), fx.dictionary(spark)
    early = articles.where(F.dayofmonth("scrape_date") <= 15)
    for part in (early, articles, articles.select("url", "scrape_date", F.lit("tion").alias("content"))):
        report_state.add_days(spark, root, part, dictionary)
    return root


@_register
def state_categories_by_date(spark, sf_dir):
    return categories.categories_by_date(report_state.stored_cube(spark, _state(spark, sf_dir)))


@_register
def state_categories_by_domain(spark, sf_dir):
    return categories.categories_by_domain(report_state.stored_cube(spark, _state(spark, sf_dir)))


@_register
def state_top_keywords(spark, sf_dir):
    return report_state.stored_keyword_totals(spark, _state(spark, sf_dir), fx.dictionary(spark))


__all__ = ["QUERIES"]
