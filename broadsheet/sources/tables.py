"""Stored tables: create, read with a fixed schema, append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import minute_text
from ..schemas import SITES, TABLES

PARTITIONED_BY = {"articles": ["scrape_date"]}


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def create_missing(spark: SparkSession, database: str) -> None:
    """Create every table that the catalog database does not have yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        # A partition column is moved to the end, as the file layout has it.
        parts = PARTITIONED_BY.get(name, [])
        ordered = [f for f in schema if f.name not in parts] + [schema[p] for p in parts]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered)
        layout = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{layout}")


def table_exists(spark: SparkSession, database: str, name: str) -> bool:
    return spark.catalog.tableExists(f"{database}.{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table by its fixed schema; nothing is inferred."""
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(_folder(root, name)).select(*schema.fieldNames())


def read_if_there(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A stored table, or None when nothing was ever written."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles under the names the reports use: ``url, date, text``."""
    return read_table(spark, root, "articles").select(
        "url", F.col("scrape_date").alias("date"), F.col("content").alias("text")
    )


def read_urls(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Just the urls of a table; no other column is read."""
    return read_table(spark, root, name).select("url")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site rules from JSON lines."""
    return spark.read.schema(SITES).json(path)


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Append to a stored table; articles go to one folder per scrape date."""
    writer = df.select(*TABLES[name].fieldNames()).write.mode("append")
    writer.partitionBy(*PARTITIONED_BY.get(name, [])).parquet(_folder(root, name))


def write_snapshot(df: DataFrame, folder: str) -> None:
    """Write a changed table as a new snapshot in a folder of its own."""
    df.write.mode("errorifexists").parquet(folder)


def export_urls(articles: DataFrame, folder: str) -> None:
    """One stored url per line."""
    articles.select("url").write.mode("errorifexists").text(folder)


def write_chart_table(df: DataFrame, folder: str, form: str = "json") -> None:
    """A chart-ready table as JSON lines or CSV with a header."""
    writer = df.write.mode("errorifexists")
    if form == "json":
        writer.json(folder)
    elif form == "csv":
        writer.option("header", True).csv(folder)
    else:
        raise ValueError("form is 'json' or 'csv'")


def run_messages(run_log: DataFrame) -> DataFrame:
    """The text form of the run log: one ``value`` line per run."""
    return run_log.select(
        F.concat_ws(
            " ",
            minute_text(F.col("run_at")),
            F.format_string("stored %d, omitted %d", "stored", "omitted"),
        ).alias("value")
    )
