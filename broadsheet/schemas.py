"""Schemas of the stored relations."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


ARTICLES = _table(
    ("url", StringType(), False),
    ("scrape_date", DateType(), True),
    ("content", StringType(), True),
)
EXCLUDED = _table(("url", StringType(), False), ("reason", StringType(), True))
CATEGORIES = _table(("id", IntegerType(), False), ("category", StringType(), True))
KEYWORDS = _table(
    ("keyword", StringType(), False),
    ("category_id", IntegerType(), True),
    ("load_pos", LongType(), True),
)
FRONTIER = _table(
    ("url", StringType(), False),
    ("scrape_time", TimestampNTZType(), True),
    ("scrape_retries", IntegerType(), True),
)
SITES = _table(
    ("domain", StringType(), False),
    ("pages", ArrayType(StringType()), True),
    ("url_filter", StringType(), True),
    ("url_exclusion", ArrayType(StringType()), True),
    ("div_filter", StringType(), True),
    ("p_attr_exclusion", ArrayType(StringType()), True),
    ("pagin_filter", StringType(), True),
)
GAZETTEER = _table(
    ("name", StringType(), False),
    ("iso2", StringType(), True),
    ("iso3", StringType(), True),
    ("canonical", StringType(), True),
)
PAGES = _table(
    ("page_id", LongType(), True),
    ("url", StringType(), True),
    ("html", StringType(), True),
)
RUN_LOG = _table(
    ("run_at", TimestampNTZType(), True),
    ("stored", LongType(), True),
    ("omitted", LongType(), True),
)

TABLES = {
    "articles": ARTICLES,
    "exclude_articles": EXCLUDED,
    "categories": CATEGORIES,
    "keywords": KEYWORDS,
    "frontier": FRONTIER,
    "sites": SITES,
    "gazetteer": GAZETTEER,
    "pages": PAGES,
    "run_log": RUN_LOG,
}
