"""What several operators of this folder share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space of the word rules: space and the five controls from tab to return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are Python objects at one time.
SLICE_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, or the named columns of it."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    The copy cuts the lineage, is compressed, keeps its rows as they were
    first made (row ids and ranks too), and is there for every executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def document_remainder(doc_id: str, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def map_batches(
    df: DataFrame, function: Callable[[Iterator[dict]], Iterable[dict]], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """``df.mapInArrow`` over plain dicts of column lists, of at most ``rows`` rows each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (
            batch.slice(start, rows).to_pydict()
            for batch in batches
            for start in range(0, batch.num_rows, rows)
        )
        for columns in function(slices):
            yield pa.RecordBatch.from_arrays(
                [
                    v if isinstance(v, pa.Array) else pa.array(v, type=field.type)
                    for field, v in ((field, columns[field.name]) for field in arrow)
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
