"""Row numbers and previous rows without a one-task window.

A window over the whole table, or over one hot key, would sort everything in
a single task.  Here the rows are range-partitioned by key and order, numbered
inside each range, and written once.  A range may only carry on the key that
the one before it ends with, so one number per range is all that is left to
add: no row is shuffled again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def number_rows(
    df: DataFrame, order: Sequence[str], into: str, keys: Sequence[str] = (), previous: tuple[str, str] | None = None
) -> DataFrame:
    """Add the 1-based row number of each row within ``keys`` by ``order``.

    ``order`` must decide the order fully.  Rows are shuffled once, into
    sorted ranges.  The ranges are written to the shared folder, so that both
    uses below see the same ones even when an executor is lost in between.
    ``previous`` names a column, and one to add with its value in the row
    before, NULL in the first of a key.
    """
    keys = list(keys)
    columns = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    if not keys and previous is None:
        return _numbered_whole(df, ranged, into)
    return _numbered_by_key(df, ranged, into, keys, previous)


def _numbered_whole(df: DataFrame, ranged: DataFrame, into: str) -> DataFrame:
    """Row numbers without keys, from the places that rows have in their ranges."""
    placed = cut_lineage(ranged.withColumn("_slot", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_slot", 33)
    )
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and no more.
    shifts = (
        placed.groupBy("_range")
        .agg(F.min("_slot").alias("_start"), F.count("*").alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_start") + 1)
        .drop("_size", "_start")
    )
    return placed.join(F.broadcast(shifts), "_range").select(*df.columns, (F.col("_slot") + F.col("_shift")).alias(into))


def _changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Whether each row's key differs from that of the row before, NULL equal to NULL."""
    n = len(columns[0]) if columns else 0
    changed = np.zeros(n, bool)
    for i, column in enumerate(columns):
        shifted = pa.concat_arrays([pa.array([None if last is None else last[i]], column.type), column.slice(0, n - 1)])
        same = pc.fill_null(pc.equal(column, shifted), False).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(column), pc.is_null(shifted)).to_numpy(zero_copy_only=False)
        changed |= ~(same | both)
    if n and last is None:
        changed[0] = True
    return changed


def _numbered_by_key(
    df: DataFrame, ranged: DataFrame, into: str, keys: list[str], previous: tuple[str, str] | None
) -> DataFrame:
    value = previous[0] if previous else None
    kind = df.schema[value].dataType if previous else BooleanType()
    names = [*df.columns, "_range", "_at", "_group", "_place", "_previous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        last, group, count, before = None, -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if keys:
                columns = [batch.column(k) for k in keys]
                changed = _changes(columns, last)
                last = [c[n - 1].as_py() for c in columns]
            else:
                changed = np.arange(n) + at == 0
            groups = group + np.cumsum(changed)
            starts = np.maximum.accumulate(np.where(changed, np.arange(n), -1))
            places = np.where(starts >= 0, np.arange(n) - starts + 1, count + np.arange(1, n + 1))
            out = [*batch.columns, pa.array(np.full(n, number, np.int32)), *map(pa.array, (np.arange(n) + at, groups, places))]
            group, count, at = int(groups[-1]), int(places[-1]), at + n
            if previous:
                column = batch.column(value)
                shifted = pa.concat_arrays([pa.array([before], column.type), column.slice(0, n - 1)])
                out.append(pc.if_else(pa.array(places > 1), shifted, pa.scalar(None, column.type)))
                before = column[n - 1].as_py()
            else:
                out.append(pa.nulls(n, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = StructType([*df.schema.fields])
    for name, type_ in (("_range", IntegerType()), ("_at", LongType()), ("_group", LongType()), ("_place", LongType()), ("_previous", kind)):
        schema = schema.add(name, type_)
    placed = cut_lineage(ranged.mapInArrow(run, schema))
    key = F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])
    end = F.struct(key.alias("key"), F.col("_place").alias("place"), (F.col(value) if previous else F.lit(None).cast("boolean")).alias("value"))
    ranges = (
        placed.groupBy("_range")
        .agg(F.min_by(key, "_at").alias("first"), F.max_by(end, "_at").alias("last"), F.max("_group").alias("group"))
        .collect()  # one row per range
    )
    carried, rows, before = 0, [], None
    for now in sorted(ranges, key=lambda r: r["_range"]):
        goes_on = before is not None and before["last"]["key"] == now["first"]
        # A range of one key hands on what it was handed itself.
        carried = before["last"]["place"] + (carried if before["group"] == 0 else 0) if goes_on else 0
        if goes_on:
            rows.append((now["_range"], carried, before["last"]["value"]))
        before = now
    whole = [F.col(c) for c in df.columns]
    if not rows:
        return placed.select(*whole, F.col("_place").alias(into), *([F.col("_previous").alias(previous[1])] if previous else []))
    handed = StructType().add("_range", IntegerType()).add("_shift", LongType()).add("_before", kind)
    shifted = placed.join(F.broadcast(df.sparkSession.createDataFrame(rows, handed)), "_range", "left")
    opens = F.col("_group") == 0
    numbered = F.col("_place") + F.when(opens, F.coalesce("_shift", F.lit(0))).otherwise(0)
    value_before = F.when(opens & (F.col("_place") == 1), F.col("_before")).otherwise(F.col("_previous"))
    return shifted.select(*whole, numbered.alias(into), *([value_before.alias(previous[1])] if previous else []))


def next_ids(candidates: DataFrame, existing: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Give ``candidates`` the ids that follow the largest existing one."""
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    numbered = number_rows(candidates, order, "_number")
    return numbered.withColumn(id_column, (F.col("_number") + top).cast("int")).drop("_number")
