"""Size checks that decide how a small table meets a large one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

# A broadcast slice holds at most this many rows and this many bytes, whatever
# the table grows to.
SLICE_ROWS = 500_000
SLICE_BYTES = 32 * 1024 * 1024


def rows_if_at_most(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows when there are at most ``limit``; None when there are more.

    Never brings more than ``limit + 1`` rows to the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _bytes(field: StructField) -> Column:
    """About what one value of a column takes."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        size = F.octet_length(column)
    elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
        size = F.octet_length(F.to_json(F.struct(column)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def _measure(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows and bytes of all columns that would travel; ``key`` is one of them."""
    width = reduce(lambda a, b: a + b, [_bytes(f) for f in df.schema], F.lit(0).cast("long"))
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"], size["bytes"]


def is_small(df: DataFrame, key: str) -> bool:
    """Whether ``df`` was measured to fit the bounds of one broadcast."""
    rows, size = _measure(df, key)
    return rows <= SLICE_ROWS and size <= SLICE_BYTES


def broadcast_if_small(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a broadcast hint when it was measured to be small.

    A larger table is joined by shuffle, where adaptive execution splits the
    partitions of hot keys.
    """
    return F.broadcast(df) if is_small(df, key) else df
