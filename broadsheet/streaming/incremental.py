"""Incremental ingest of newly landed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import FETCH_ERROR
from ..operators.keys import without_stored
from ..plans.ingest import page_outcomes
from ..schemas import PAGES
from ..session import cut_lineage

OUTCOMES = "url string, status string, reason string, scrape_date date, content string"
OUTCOME_SCHEMA = f"{OUTCOMES}, batch bigint, bucket int"
#: Folders by url hash inside a batch.  A batch reads the urls of its own folders only.
BUCKETS = 64


def bucket_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """One row per url: the outcome that settled it, else its last failed fetch."""
    outcomes = spark.read.schema(OUTCOME_SCHEMA).parquet(f"{root}/outcomes").drop("bucket")
    failed = F.col("status") == FETCH_ERROR
    settled = outcomes.where(~failed)
    # Failed fetches have no text, so only urls, dates and reasons move here.
    last = (
        outcomes.where(failed)
        .drop("content")
        .groupBy("url")
        .agg(F.max_by(F.struct("status", "reason", "scrape_date", "batch"), "batch").alias("_last"))
        .join(settled.select("url"), "url", "left_anti")
        .select("url", "_last.status", "_last.reason", "_last.scrape_date", F.lit(None).cast("string").alias("content"), "_last.batch")
    )
    return settled.unionByName(last)


def settled_before(spark: SparkSession, root: str, batch_id: int, outcomes: DataFrame) -> DataFrame:
    """Urls that earlier batches settled, from the folders that urls of ``outcomes`` fall into."""
    folders = [r["bucket"] for r in outcomes.select(bucket_of(F.col("url")).alias("bucket")).distinct().collect()]
    written = spark.read.schema(OUTCOME_SCHEMA).parquet(f"{root}/outcomes")
    # A failed fetch settles nothing: its url is read again when it lands.
    return written.where(
        F.col("bucket").isin(folders) & (F.col("batch") < batch_id) & (F.col("status") != FETCH_ERROR)
    ).select("url")


def ingest_new_pages(
    spark: SparkSession,
    landing: str,
    root: str,
    sites: DataFrame,
    scrape_date: Column | None = None,
    stop_words: Sequence[str] | None = None,
    name_filter: str = "*.parquet",
    files_per_batch: int = 1000,
) -> None:
    """Settle every page file that landed since the last run, then stop.

    Each micro-batch writes a folder of its own, so a replay after a failure
    overwrites the same folder and leaves no double rows.  Outcomes lie by url
    hash, so what a batch reads of earlier ones grows with the batch.  A url that
    an earlier batch stored or rejected is skipped; one that failed to fetch is
    read again.  Progress is kept under ``root``.
    """
    day = F.current_date() if scrape_date is None else scrape_date
    # An empty first folder, so that the first batch has something to read.
    spark.createDataFrame([], OUTCOMES).write.mode("ignore").parquet(f"{root}/outcomes/batch=-1/bucket=-1")

    def settle(batch: DataFrame, batch_id: int) -> None:
        outcomes = cut_lineage(page_outcomes(batch, sites, day, stop_words))
        new = without_stored(outcomes, settled_before(spark, root, batch_id, outcomes))
        dealt = new.withColumn("bucket", bucket_of(F.col("url"))).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/outcomes/batch={batch_id}")

    landed = (
        spark.readStream.schema(PAGES)
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )
    run = (
        landed.writeStream.foreachBatch(settle)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
