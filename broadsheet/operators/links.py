"""From the hrefs on listing pages to distinct article links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import (
    canonical_link,
    excluded_link,
    listing_path,
    listing_url,
    next_page_suffix,
    off_domain,
    points_to_listing,
    wanted_link,
)
from .sizing import broadcast_if_small


def site_listings(sites: DataFrame) -> DataFrame:
    """``domain, page, url``: the listing pages each site rule names."""
    pages = sites.select("domain", F.explode("pages").alias("page"))
    return pages.select("domain", "page", listing_url(F.col("domain"), F.col("page")).alias("url"))


def own_links(hrefs: DataFrame) -> DataFrame:
    """``domain, url``, distinct, of the wanted hrefs (``domain, page, href``) that stay on their site.

    Repeats are dropped map-side before the one shuffle, so a link that is on
    every page costs no more than a rare one.
    """
    href, own = F.col("href"), F.col("domain")
    kept = hrefs.where(~points_to_listing(href, listing_path(own, F.col("page"))) & ~off_domain(href, own))
    return (
        kept.select("domain", canonical_link(href, own).alias("url"))
        .where(F.col("url").isNotNull())
        .dropDuplicates(["domain", "url"])
    )


def canonical_links(hrefs: DataFrame, rules: DataFrame) -> DataFrame:
    """``domain, url``, distinct.

    ``hrefs`` is ``domain, page, href``; ``rules`` has ``domain, url_filter,
    url_exclusion``.
    """
    href = F.col("href")
    ruled = hrefs.join(
        broadcast_if_small(rules.select("domain", "url_filter", "url_exclusion"), "domain"), "domain"
    )
    return own_links(
        ruled.where(wanted_link(href, F.col("url_filter")) & ~excluded_link(href, F.col("url_exclusion"))).select(
            "domain", "page", "href"
        )
    )


def _any_word(values: Column, *words: str) -> Column:
    def holds(value: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(value, F.lit(word))
        return found

    return F.exists(values, holds)


def _class_equals(classes: Column, name: Column) -> Column:
    return F.array_contains(classes, name) | ((F.size(classes) > 0) & (F.array_join(classes, " ") == name))


def next_page_href(tags: Column, rule: Column) -> Column:
    """The raw next-page link of a listing; NULL when there is none.

    ``tags`` is the array of parsed tags with ``name, classes, href, label,
    strings, values, hit``, the last by ``rule``.  Three tries: anchors by class (the last one that says
    next or more; if anchors match but none says so, there is no link),
    anchors by aria-label, any tag by class with a ``?`` in a string attribute.
    """
    by_class = F.filter(tags, lambda t: (t["name"] == "a") & t["hit"])
    says_next = F.filter(by_class, lambda t: _any_word(t["values"], "next", "more"))
    by_label = F.filter(tags, lambda t: (t["name"] == "a") & (t["label"] == rule))
    exact = F.filter(tags, lambda t: _class_equals(t["classes"], rule))
    queries = F.filter(F.get(exact, 0)["strings"], lambda s: F.contains(s, F.lit("?")))
    return F.when(
        F.length(rule) > 0,
        F.when(F.size(by_class) > 0, F.try_element_at(says_next, F.lit(-1))["href"])
        .when(F.size(by_label) > 0, F.get(by_label, 0)["href"])
        .otherwise(F.get(queries, 0)),
    )


def next_pages(listings: DataFrame) -> DataFrame:
    """``domain, page, next_href, next_url`` for listings with a next page.

    ``listings`` is ``domain, page, pagin_filter, tags``.
    """
    linked = listings.select(
        "domain", "page", next_page_href(F.col("tags"), F.col("pagin_filter")).alias("next_href")
    ).where(F.length("next_href") > 0)
    listing = listing_path(F.col("domain"), F.col("page"))
    suffix = next_page_suffix(F.col("next_href"), listing)
    return linked.select(
        "domain", "page", "next_href", suffix.alias("suffix")
    ).where(F.col("suffix") != "").select(
        "domain",
        "page",
        "next_href",
        listing_url(F.col("domain"), F.col("page"), F.col("suffix")).alias("next_url"),
    )
