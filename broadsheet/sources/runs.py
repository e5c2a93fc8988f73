"""What one run adds to several stored tables becomes visible at once.

A run writes a folder of its own in every table, ``<root>/<table>/run=<n>``,
and a row in ``<root>/published/run=<n>`` last.  Readers take only runs that
have that row, so one that died between two tables is not seen, and doing it
again overwrites its folders and nothing else.  A run may also rewrite a table
whole, as its new base; earlier runs are then left out when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PUBLISHED = "bases array<string>"


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The runs under ``path`` with their number; no rows when nothing was ever written."""
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    whole = StructType([*wanted.fields]).add("run", "long")
    try:
        return spark.read.schema(whole).parquet(path).select(*whole.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def published(spark: SparkSession, root: str) -> DataFrame:
    """``run, bases``: the runs that are complete."""
    return _read(spark, f"{root}/published", PUBLISHED)


def next_run(spark: SparkSession, root: str) -> int:
    return published(spark, root).agg(F.coalesce(F.max("run") + 1, F.lit(1)).alias("n")).first()["n"]


def read_runs(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """All rows of a table that complete runs have written, with ``run``."""
    runs = published(spark, root)
    base = runs.where(F.array_contains("bases", name)).agg(F.coalesce(F.max("run"), F.lit(-1)).alias("_base"))
    # One row per run.
    seen = F.broadcast(runs.select("run").where(F.col("run") >= base.scalar()))
    rows = _read(spark, f"{root}/{name}", schema)
    return rows.join(seen, "run", "left_semi").select(*rows.columns)


def publish(
    spark: SparkSession,
    root: str,
    run: int,
    tables: dict[str, DataFrame],
    partitioned: dict[str, Sequence[str]] | None = None,
    bases: Sequence[str] = (),
) -> None:
    """Write the rows of a run to every table and then make them visible.

    ``bases`` names the tables that this run rewrites whole.  The tables
    should be reads of written copies, as they may be written again.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy(*(partitioned or {}).get(name, ())).parquet(f"{root}/{name}/run={run}")
    row = spark.createDataFrame([(list(bases),)], PUBLISHED)
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/published/run={run}")
