"""Registered queries for rules that the given tables as they are never meet, and for stored files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from broadsheet.functions import formatting
from broadsheet.functions import text as cleaning
from broadsheet.operators import extraction
from broadsheet.plans import charts, ingest, keywords, run, statistics
from broadsheet.session import cut_lineage
from broadsheet.sources import documents as landed
from broadsheet.sources import tables

from . import fixtures as fx
from .spark_queries import QUERIES, _register
from .stored_queries import _root, _run


@_register
def clean_links_and_apostrophes(spark, sf_dir):
    """Every text with links and apostrophes of both kinds put into it, cleaned."""
    docs = landed.spread_small_input(fx.documents(spark, sf_dir, "doc_id", "text"))
    put = F.col("text")
    for old, new in fx.PUT_INTO_TEXTS:
        put = F.replace(put, F.lit(old), F.lit(new))
    return docs.select("doc_id", cleaning.clean_text(put, fx.STOP_WORDS).alias("content"))


def _odd_pages(spark, sf_dir):
    return fx.odd_pages(spark, sf_dir), fx.odd_sites(spark, sf_dir)


@_register
def extract_odd_pages(spark, sf_dir):
    """Containers by class and id, captions, exclusions, marked paragraphs and empty containers."""
    return extraction.extract_articles(*_odd_pages(spark, sf_dir))


@_register
def landed_copies(spark, sf_dir):
    """All pages landed three times, told apart by file and row; one outcome per url, no hash of html."""
    root = _root(spark, "landed")
    for _ in range(3):
        landed.pages(spark, sf_dir).write.mode("append").parquet(root)
    day = F.lit("2024-02-01").cast("date")
    return ingest.page_outcomes(landed.landed_pages(spark, root), fx.sites(spark, sf_dir), day, fx.STOP_WORDS)


# -- stored files ------------------------------------------------------------


@_register
def created_tables(spark, sf_dir):
    """Articles put into tables that were created where they were missing, and read back."""
    database = f"news_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_root(spark, 'database')}'")
    missing = not tables.table_exists(spark, database, "articles")
    for _ in range(2):  # a second call leaves what is there
        tables.create_missing(spark, database)
    rows = fx.articles(spark, sf_dir)
    stored = spark.table(f"{database}.articles")
    rows.select(*stored.columns).write.insertInto(f"{database}.articles")
    there = missing and all(tables.table_exists(spark, database, name) for name in tables.TABLES)
    return spark.table(f"{database}.articles").select(
        "url", "scrape_date", F.length("content").cast("long").alias("chars"), F.lit(there).alias("created")
    )


@_register
def appended_articles(spark, sf_dir):
    """Articles appended in two parts to one folder per day, under the names that reports use."""
    root = _root(spark, "stored")
    rows = fx.articles(spark, sf_dir)
    late = F.dayofmonth("scrape_date") > 15
    for part in (rows.where(late), rows.where(~late)):
        tables.append_rows(part, root, "articles")
    return tables.read_articles(spark, root).select("url", "date", F.length("text").cast("long").alias("chars"))


@_register
def exported_urls(spark, sf_dir):
    """Stored urls, one a line."""
    folder = f"{_root(spark, 'export')}/urls"
    tables.export_urls(fx.articles(spark, sf_dir, "url"), folder)
    return spark.read.text(folder).select(F.col("value").alias("url"))


@_register
def chart_files(spark, sf_dir):
    """The keyword chart, written in both forms and read back."""
    folder, schema = _root(spark, "charts"), "keyword string, category string, count bigint"
    bars = cut_lineage(
        charts.top_keyword_bars(keywords.keyword_totals(fx.articles(spark, sf_dir, "content"), fx.dictionary(spark)), 5)
    )
    tables.write_chart_table(bars, f"{folder}/json")
    tables.write_chart_table(bars, f"{folder}/csv", "csv")
    json = spark.read.schema(schema).json(f"{folder}/json")
    csv = spark.read.schema(schema).option("header", True).csv(f"{folder}/csv")
    return json.withColumn("form", F.lit("json")).unionByName(csv.withColumn("form", F.lit("csv")))


@_register
def site_rules_read(spark, sf_dir):
    """Site rules as JSON lines, read under their fixed schema; what a line lacks is NULL."""
    folder = f"{_root(spark, 'sites')}/json"
    rules = fx.link_rules(spark, sf_dir).drop("pagin_filter")
    rules.withColumn("pages", F.array(F.lit("/"), F.lit("/world"))).write.json(folder)
    found = tables.read_sites(spark, folder)
    return found.select(
        "domain", F.size("pages").alias("n_pages"), "url_filter", F.size("url_exclusion").alias("n_exclusions"), "pagin_filter"
    )


@_register
def run_messages(spark, sf_dir):
    """The run log as text, to the minute."""
    return tables.run_messages(run.stored(spark, _run(spark, sf_dir), "run_log"))


@_register
def clock_formats(spark, sf_dir):
    """Queue times as text to the second and the minute, parsed back, and moved by hours."""
    moment = F.col("scrape_time")
    text = formatting.second_text(moment)
    return fx.frontier(spark, sf_dir).select(
        "url",
        text.alias("second"),
        formatting.minute_text(moment).alias("minute"),
        (formatting.parse_second(text) - F.make_dt_interval(hours=F.lit(1))).alias("hour_before"),
        moment.cast("date").alias("day"),
    )


@_register
def gated_statistics(spark, sf_dir):
    """Corpus statistics by language, of those languages that have anything stored."""
    docs = fx.documents(spark, sf_dir, "doc_id", "lang")
    dated = docs.select(F.concat(F.lit("https://a.com/"), "doc_id").alias("url"), "lang",
                        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("scrape_date"))
    found = None
    for lang in ("de", "en", "es", "fr", "xx"):
        own = dated.where(F.col("lang") == lang)
        if statistics.anything_stored(own):
            row = statistics.corpus_statistics(own).withColumn("lang", F.lit(lang))
            found = row if found is None else found.unionByName(row)
    return found


__all__ = ["QUERIES"]
