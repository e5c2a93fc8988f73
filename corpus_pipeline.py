"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before kept, written as Parquet and read
again, and all but the last return the columns of ``documents``.  Stages that
give texts to Python workers bound the session's Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import language, line_dedup, mixing, near_dedup, packing
from broadsheet.llm.common import SPACE, document_remainder, read_table, written
from broadsheet.llm.queries import tokenizer_files
from broadsheet.operators.sizing import is_small
from broadsheet.session import bound_arrow_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go.

    A NULL text goes; repeated rows and ids are judged each, equal texts alike;
    an empty table stays empty.
    """
    bound_arrow_batches(spark)
    return language.keep_identified(docs, document_remainder("doc_id", 3) != 1)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go, and documents that have no word left by it.

    ``n_chars`` is the length of the text that stays.  A NULL or empty text and
    rows without a repeated line pass as they are; of equal lines the smallest
    id keeps its own, NULL last; an empty table stays empty.
    """
    cut = line_dedup.drop_repeated_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.regexp_replace("text", f"{SPACE}+", "") == "")
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest id, NULL last, then any one of its rows.

    Decided and applied by row, as ids may be repeated or NULL; rows without words all stay.
    """
    bound_arrow_batches(spark)
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_dedup.near_duplicates(keyed, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    placed = written(groups.join(keyed.select("_row", "doc_id"), "_row"), "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    staying = placed.groupBy("component_id").agg(F.min(order).alias("_first")).select("_first._row")
    gone = written(placed.select("_row").join(staying, "_row", "left_anti"), "pipeline-gone")
    return keyed.join(F.broadcast(gone) if is_small(gone, "_row") else gone, "_row", "left_anti").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for.

    A NULL text has no words and a NULL source is a source of its own; repeated
    rows are drawn each, those with one id alike, as the draw is a hash of the
    id; an empty table stays empty.
    """
    return mixing.mix_sources(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences; ``row`` tells the copies of a document apart.

    A NULL text is empty and has the end token alone; rows with equal or NULL
    ids are packed each; of pieces of one length any may come first; an empty
    table gives no rows.
    """
    bound_arrow_batches(spark)
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mix", mix_to_weights),
    ("pack", pack_sequences),
]

#: The classifier of the first stage is not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
