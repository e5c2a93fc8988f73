"""Url forms, link filters and link canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_pattern_hit, pattern_hit

# The url shapes that decide domain, host and link identity.
DOMAIN_NOISE = r"^https://(www.)?|/.*"
SITE_NOISE = r"^https://|/.*"
HOST = r"https?://([A-Za-z_0-9.-]+)"
LISTING_START = "https://www."
SAME_HOST_PREFIX = 14


def domain(url: Column) -> Column:
    """Url without ``https://``, an optional ``www.`` and the path.

    An ``http://`` url gives ``http:`` - kept, see the README.
    """
    return F.regexp_replace(url, DOMAIN_NOISE, "")


def host(url: Column) -> Column:
    """Host name up to port or path; NULL where there is none."""
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def site_domain(name: Column) -> Column:
    """The same stripping for the domain given in a site rule."""
    return F.regexp_replace(name, SITE_NOISE, "")


def strip_query(link: Column) -> Column:
    return F.regexp_replace(link, r"\?.*", "")


def wanted_link(href: Column, url_filter: Column) -> Column:
    return pattern_hit(href, url_filter)


def excluded_link(href: Column, url_exclusion: Column) -> Column:
    return any_pattern_hit(href, url_exclusion)


def points_to_listing(href: Column, listing: Column) -> Column:
    """True when the link is just the listing page it was found on."""
    return F.rlike(href, F.concat(F.lit(r"^.*://\Q"), listing, F.lit(r"\E/?$")))


def off_domain(href: Column, own_domain: Column) -> Column:
    """True when the part before the first slash names something else."""
    head = F.substring_index(F.regexp_replace(href, r"^https://(www\.)?", ""), "/", 1)
    return (head != "") & (head != own_domain)


def canonical_link(href: Column, own_domain: Column) -> Column:
    """One spelling per article link; NULL for links that have none."""
    link = strip_query(href)
    own = F.concat(F.lit("https://"), own_domain)
    return (
        F.when(F.startswith(link, F.lit("/")), F.concat(own, link))
        .when(F.startswith(link, F.lit(LISTING_START)), F.regexp_replace(link, "www.", ""))
        .when(F.startswith(link, own), link)
    )


def listing_path(own_domain: Column, page: Column) -> Column:
    """Domain plus page, where ``/`` stands for the bare domain."""
    return F.concat(own_domain, F.when(page != "/", page).otherwise(F.lit("")))


def listing_url(own_domain: Column, page: Column, suffix: Column | None = None) -> Column:
    tail = F.lit("") if suffix is None else F.coalesce(suffix, F.lit(""))
    return F.concat(F.lit(LISTING_START), listing_path(own_domain, page), tail)


def same_host(url: Column, previous: Column) -> Column:
    """True when ``url`` starts with the first characters of ``previous``."""
    return F.coalesce(
        (previous != "") & F.startswith(url, F.left(previous, F.lit(SAME_HOST_PREFIX))),
        F.lit(False),
    )


def next_page_suffix(link: Column, listing: Column) -> Column:
    """What to append to a listing url to get its next page.

    Keep from the last ``?``, drop anything up to and including the listing
    itself, then drop the listing's own last path segment.
    """
    quoted = F.concat(F.lit(r"\Q"), listing, F.lit(r"\E"))
    last_segment = F.concat(F.lit(r"\Q"), F.regexp_replace(listing, r"^.*/", "/"), F.lit(r"\E"))
    from_query = F.regexp_replace(link, r"^.*\?", "?")
    relative = F.regexp_replace(from_query, F.concat(F.lit("^.*"), quoted), F.lit(""))
    return F.regexp_replace(relative, last_segment, F.lit(""))
