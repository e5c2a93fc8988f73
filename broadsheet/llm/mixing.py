"""Mixing sources to target weights, in DataFrame functions only.

Words are summed by source, every source gets a target, and its documents
are repeated at the rate target / size: each document ``floor(rate)`` times,
and once more when its hash-seeded draw falls below the fraction that is left.

Defined results: a NULL source is a source of its own and comes last; a NULL
or empty text has size 0 and is repeated like any other document of its
source.  A source without words has target 0 and no copies.  Documents with
equal ids share their draw; a NULL id draws as an empty one.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from ..session import cut_lineage
from .common import WORD

#: Relative weights, dealt to the sources in order again and again.
WEIGHTS = (5, 2, 1)
#: Words the mix takes, as a share of all words.
SHARE = 1.5
#: No source is repeated more often than this.
MAX_RATE = 2
SEED = "mix"
#: Hexadecimal digits of the digest that make one draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE
) -> DataFrame:
    """``source, source_size, target`` from one row ``source, size`` per document.

    Targets follow the weights, but stop at ``max_rate`` times the source;
    what is above goes to the others by weight, until none is above.  That
    rule has a level: every target is the smaller of its cap and weight times
    level.  Sources in order of cap / weight reach their caps one after the
    other, so running sums over that order give the level.  The windows run
    over one row per source, which the partial sums made.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn("_place", F.row_number().over(by_code_point)).select(
        "source",
        "source_size",
        "_place",
        F.element_at(wheel, ((F.col("_place") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * float(max_rate)).alias("_cap"),
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    staged = weighted.select(
        "*",
        F.row_number().over(by_ratio).alias("_order"),
        (F.sum("source_size").over(everything) * share).alias("_wanted"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))).alias("_free"),
    )
    level = (F.col("_wanted") - F.col("_capped")) / F.col("_free")
    # The first source in that order whose cap lies at or above the level sets it for all.
    reached = F.when(level <= F.col("_cap") / F.col("_weight"), F.struct(F.col("_order"), level.alias("level")))
    leveled = staged.withColumn("_level", F.min(reached).over(everything)["level"])
    return leveled.select(
        "source",
        "source_size",
        F.when(F.col("_level").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_level")))
        .alias("target"),
    )


def mixing_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_rate: float = MAX_RATE,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies``.

    Texts are read once; afterwards only ids, sources and sizes move.  The
    per-source table is measured and broadcast, or joined by shuffle when it
    outgrows the bound.
    """
    sizes = cut_lineage(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    )
    targets = cut_lineage(source_targets(sizes, weights, share, max_rate).withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return sizes.join(
        broadcast_if_small(targets, "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select("doc_id", "source", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.

    Columns are those of ``docs``.  The rate is joined to the rows by source,
    so no text is shuffled while the per-source table fits its bound.
    """
    seed = options.get("seed", SEED)
    sizes = cut_lineage(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    limits = {k: v for k, v in options.items() if k != "seed"}
    targets = cut_lineage(
        source_targets(sizes, **limits).select(
            F.col("source").alias("_source"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
        )
    )
    whole = F.floor("_rate")
    copies = (whole + F.when(draw(F.col("_id"), seed) < F.col("_rate") - whole, 1).otherwise(0)).cast("int")
    # The row as one column: whatever its columns are called, none meets the names used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_of")
    )
    return (
        rows.join(broadcast_if_small(targets, "_source"), F.col("_of").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    )
