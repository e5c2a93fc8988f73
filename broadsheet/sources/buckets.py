"""Stored tables laid out by a hash of their key, so that joins on it move only the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Files per write are a multiple of this; take about one for each 128 MB of the stored keys.
BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "url", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write ``df`` as the catalog table ``name`` under ``path``, bucketed and sorted by ``key``.

    Each bucket is written by one task, after one shuffle of what is written.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode(mode).option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def without_bucketed(candidates: DataFrame, *stored: DataFrame, key: str = "url") -> DataFrame:
    """Candidates, once per key, whose key none of the bucketed tables holds.

    The candidates are shuffled once, into the buckets; the stored tables are
    read for the key only and where they lie.  They must share one number of
    buckets.  One join after the other keeps the layout, a union would not.
    """
    distinct = candidates.dropDuplicates([key])
    return reduce(lambda left, table: left.join(table.select(key).hint("merge"), key, "left_anti"), stored, distinct)
