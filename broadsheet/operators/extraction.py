"""From landed pages to article text or a reason for rejecting the page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import article_container
from ..functions.patterns import first_error
from ..functions.text import clean_text, strip
from ..functions.urls import domain, site_domain
from ..session import cut_lineage
from .sizing import broadcast_if_small

# The shortest article worth keeping, and the reject reasons.
MIN_PARAGRAPHS = 7
NOT_FOUND = "Requested <div> was not found on this page."
EMPTY = "The content of the requested <div> was empty."
TOO_FEW = "The content of the requested <div> was not worth saving (too few paragraphs: %d)."
NO_RULE = "no site rule"
NOT_FETCHED = "fetch error"

#: Column of landed pages that tells their rows apart: file and row in it.
PLACE = "landing_place"

STORED, REJECTED, FETCH_ERROR = "stored", "rejected", "fetch_error"


def first_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The page that settles each url, and the urls whose page is there in exact copies.

    A page with html comes before one without, then the lowest ``page_id``
    counts, then the place in the landed files (``landing_place``, where the
    pages were read with it), then a hash of the html.  Ids may start anew in
    every landed file, so a page is known by url and id together.  Urls that
    repeat are found without reading html; only theirs is looked at, and only
    the choices meet the pages, where they are read, so no html is shuffled.
    The first result still holds every copy of the urls in the second.
    """
    columns = [c for c in pages.columns if c != PLACE]
    several = cut_lineage(pages.groupBy("url").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col("url").alias("_url")))
    none = several.select(F.col("_url").alias("url"))
    if several.isEmpty():
        return pages.select(*columns), none
    own = F.col("url").eqNullSafe(F.col("_url"))
    last = F.col(PLACE) if PLACE in pages.columns else F.xxhash64("html")
    this = F.struct(F.col("html").isNull().alias("unread"), F.col("page_id").alias("id"), last.alias("last"))
    choices = cut_lineage(
        pages.join(broadcast_if_small(several, "_url"), own, "left_semi")
        .select("url", this.alias("_this"))
        .groupBy("url", "_this")
        .agg(F.count("*").alias("_copies"))
        .groupBy(F.col("url").alias("_url"))
        .agg(F.min(F.struct("_this", "_copies")).alias("_best"))
        .select("_url", "_best._this", "_best._copies")
    )
    chosen = (
        pages.join(broadcast_if_small(choices, "_url"), own, "left")
        .where(F.col("_this").isNull() | (F.col("_this") == this))
        .select(*columns)
    )
    return chosen, choices.where(F.col("_copies") > 1).select(F.col("_url").alias("url"))


def with_site_rules(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with ``div_filter, p_attr_exclusion, has_rule, rule_error`` of their site.

    A page of an unknown domain stays, with ``has_rule`` false.  Patterns are
    judged once per site.
    """
    judged = cut_lineage(sites.withColumn("rule_error", first_error(F.array("div_filter"))))
    rules = broadcast_if_small(judged, "domain").select(
        site_domain(F.col("domain")).alias("_site"),
        "div_filter",
        "rule_error",
        "p_attr_exclusion",
        F.lit(True).alias("_ruled"),
    )
    return (
        pages.withColumn("_site", domain(F.col("url")))
        .join(rules, "_site", "left")
        .withColumn("has_rule", F.coalesce("_ruled", F.lit(False)))
        .drop("_site", "_ruled")
    )


def _used_paragraphs(container: Column) -> Column:
    paragraphs = container["paragraphs"]
    return F.when(F.size(paragraphs) < MIN_PARAGRAPHS, container["marked"]).otherwise(paragraphs)


def _kept_text(paragraphs: Column, exclusions: Column) -> Column:
    """Paragraph texts outside captions, exclusion tags and excluded attributes."""
    excluded = F.coalesce(exclusions, F.array().cast("array<string>"))

    def keep(p: Column) -> Column:
        in_caption = F.coalesce(p["parent"] == "figcaption", F.lit(False))
        unwanted = F.exists(p["values"], lambda v: F.exists(excluded, lambda e: F.contains(v, e)))
        return ~in_caption & ~p["has_exclude"] & ~unwanted

    return F.array_join(F.transform(F.filter(paragraphs, keep), lambda p: strip(p["text"])), " ")


def extract_articles(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``page_id, url, status, reason, raw_text`` for every page.

    One narrow pass: the html is parsed where it is read and only the text of
    the article goes on.
    A page without html counts as a failed fetch.  A stored page may have an
    empty text when all its paragraphs were filtered out.
    """
    ruled = with_site_rules(pages.select("page_id", "url", "html"), sites)
    readable = F.col("has_rule") & F.col("rule_error").isNull() & F.col("html").isNotNull()
    parsed = ruled.select(
        "page_id",
        "url",
        "has_rule",
        "rule_error",
        "p_attr_exclusion",
        F.col("html").isNull().alias("unfetched"),
        article_container(F.when(readable, F.col("html")), F.when(readable, F.col("div_filter"))).alias("container"),
    )
    container = F.col("container")
    used = _used_paragraphs(container)
    counted = F.greatest(F.size(container["paragraphs"]), F.size(used))
    reason = (
        F.when(F.col("unfetched"), NOT_FETCHED)
        .when(~F.col("has_rule"), NO_RULE)
        .when(F.col("rule_error").isNotNull(), F.col("rule_error"))
        .when(container.isNull(), NOT_FOUND)
        .when(~container["has_text"], EMPTY)
        .when(F.size(used) < MIN_PARAGRAPHS, F.format_string(TOO_FEW, counted))
    )
    status = (
        F.when(F.col("unfetched"), FETCH_ERROR)
        .when(F.col("reason").isNotNull(), REJECTED)
        .otherwise(STORED)
    )
    return parsed.withColumn("reason", reason).select(
        "page_id",
        "url",
        status.alias("status"),
        "reason",
        F.when(F.col("reason").isNull(), _kept_text(used, F.col("p_attr_exclusion"))).alias("raw_text"),
    )


def clean_outcomes(extracted: DataFrame, scrape_date: Column, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``page_id, url, status, reason, scrape_date, content``, the text cleaned."""
    return extracted.select(
        "page_id",
        "url",
        "status",
        "reason",
        scrape_date.alias("scrape_date"),
        clean_text(F.col("raw_text"), stop_words).alias("content"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row ``stored, omitted``; failed fetches and rejects are omitted."""
    stored = F.col("status") == STORED
    return outcomes.agg(F.count_if(stored).alias("stored"), F.count_if(~stored).alias("omitted"))
