"""Load a seed of categories with keyword lists into two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..operators.ranking import number_rows
from ..operators.sizing import rows_if_at_most

# Positions within one seed list stay below this step, so that load_pos keeps
# the order of lists first and of keywords within a list second.
LIST_STEP = 1 << 31


def seed_frame(spark: SparkSession, seed: dict[str, list[str]]) -> DataFrame:
    """A dictionary written by hand as ``seed_pos, category, keywords``."""
    rows = [(pos, name, words) for pos, (name, words) in enumerate(seed.items())]
    return spark.createDataFrame(rows, "seed_pos bigint, category string, keywords array<string>")


def seed_categories(seed: DataFrame) -> DataFrame:
    """``id, category``: ids count from 1 in seed order."""
    return number_rows(seed.select("seed_pos", "category"), ["seed_pos"], "id").select(
        F.col("id").cast(IntegerType()), F.col("category").cast(StringType())
    )


def seed_keywords(seed: DataFrame, categories: DataFrame) -> DataFrame:
    """``keyword, category_id, load_pos``; a repeated keyword keeps its first place."""
    listed = seed.select("seed_pos", "category", F.posexplode("keywords").alias("pos", "keyword"))
    first = listed.groupBy("keyword").agg(F.min(F.struct("seed_pos", "pos", "category")).alias("at"))
    return first.join(categories, F.col("at.category") == categories["category"]).select(
        "keyword",
        F.col("id").alias("category_id"),
        (F.col("at.seed_pos") * LIST_STEP + F.col("at.pos")).alias("load_pos"),
    )


#: More stop words than this do not belong into a plan as literals.
STOP_WORD_LIMIT = 10_000


def stop_words(table: DataFrame, column: str = "word") -> list[str]:
    """The words of a stop-word table, for the ``stop_words`` of the cleaning steps.

    NULLs and repeats do not count; a table beyond the limit is an error.
    """
    words = table.select(column).where(F.col(column).isNotNull()).distinct()
    rows = rows_if_at_most(words, STOP_WORD_LIMIT)
    if rows is None:
        raise ValueError(f"more than {STOP_WORD_LIMIT} stop words")
    return sorted(row[0] for row in rows)
