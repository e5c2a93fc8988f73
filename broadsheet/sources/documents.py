"""Adaptor: plain documents seen as stored articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..schemas import PAGES
from ..session import spread_small_input


def articles_from_documents(
    spark: SparkSession, sf_dir: str, stop_words: Sequence[str], columns: Sequence[str] = ("url", "scrape_date", "content")
) -> DataFrame:
    """``documents`` as ``url, scrape_date, content`` (the columns asked for).

    Url and date are derived from the id; the content is the cleaned text.
    """
    needed = ["doc_id", "source", "lang", "text"] if "content" in columns else ["doc_id", "source", "lang"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*needed)
    if "content" in columns:
        documents = spread_small_input(documents)
    doc_id = F.col("doc_id")
    derived = {
        "url": F.concat(
            F.lit("https://"),
            F.when(doc_id % 3 == 0, "www.").otherwise(""),
            F.col("source"),
            F.lit(".example.com/"),
            F.col("lang"),
            F.lit("/"),
            doc_id.cast("string"),
        ),
        "scrape_date": F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 30).cast("int")),
    }
    if "content" in columns:
        derived["content"] = clean_text(F.col("text"), stop_words)
    return documents.select(*[derived[name].alias(name) for name in columns])


def pages(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ("page_id", "url", "html")) -> DataFrame:
    """Landed pages, read with only the columns asked for."""
    landed = spark.read.parquet(f"{sf_dir}/pages.parquet").select(*columns)
    return spread_small_input(landed) if "html" in columns else landed


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files as ``page_id, url, html, landing_place``.

    The place is the file and the row in it, from the file metadata, so that
    exact copies of a page differ without a look at their html.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.schema(PAGES).parquet(path).select("page_id", "url", "html", place.alias("landing_place"))
