"""A bitmap of the hashes of a bounded table, to leave out in a scan what no row of it can match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_VALUE = 16
#: 8 KB, and 8 MB; a fuller bitmap lets more through and loses nothing.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def bitmap(values: DataFrame, column: str, rows: int) -> tuple[Column, int]:
    """The bits of all 64-bit values of ``column`` as a scalar array, and their number, for about ``rows`` values.

    The array is a subquery: select it as a column of its own and use that
    once; the optimizer then keeps it out of the rows.
    """
    wanted = max(LEAST_BITS, min(MOST_BITS, BITS_PER_VALUE * rows))
    bits = 1 << (wanted - 1).bit_length()
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = values.groupBy(F.shiftright(at, 6).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(({column} & {bits - 1}) % 64 as int))")).alias("_set")
    )
    dense = values.sparkSession.range(bits // 64).join(words, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("_set", F.lit(0)).alias("_set"))))
    return dense.agg(ordered["_set"].alias("bits")).scalar(), bits


def may_hold(set_bits: Column, bits: int, value: Column) -> Column:
    """False for a value that the bitmap was not made of; true for all others, and some more."""
    at = value.bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(set_bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
