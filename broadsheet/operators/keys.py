"""Primary-key and foreign-key checks, and key-safe appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import broadcast_if_small


def repeated_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    """``table, key, rows`` for each key value held by more than one row."""
    return (
        df.groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > 1)
        .select(F.lit(table).alias("table"), "key", "rows")
    )


def orphan_keywords(keywords: DataFrame, categories: DataFrame) -> DataFrame:
    """Keywords whose category does not exist."""
    return keywords.join(categories, keywords["category_id"] == categories["id"], "left_anti")


def key_violations(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All repeated keys of several tables, given as name -> (table, key)."""
    return reduce(
        DataFrame.unionByName, [repeated_keys(df, key, name) for name, (df, key) in tables.items()]
    )


def without_known(candidates: DataFrame, *known: DataFrame, key: str = "url") -> DataFrame:
    """Candidates, once per key, whose key no known table holds.

    The known tables are read for the key column only.
    """
    seen = reduce(DataFrame.unionByName, [table.select(key) for table in known])
    return candidates.dropDuplicates([key]).join(seen, key, "left_anti")


def without_stored(candidates: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose key is not stored, for a small batch against a big table.

    The stored keys are first reduced to those in the batch; with a batch of
    checked small size that is a map-side scan and the big table is never
    shuffled.  ``candidates`` should already be materialised.
    """
    batch_keys = broadcast_if_small(candidates.select(key).distinct(), key)
    seen = stored.select(key).join(batch_keys, key, "left_semi")
    return candidates.join(seen, key, "left_anti")
