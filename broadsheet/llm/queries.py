"""The registered queries of this folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    exact_dedup,
    fingerprints,
    hmm_score,
    html_extraction,
    language,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    prefix_trie,
    url_filter,
)
from .common import document_remainder, read_table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@_register
def op1_mix_sources(spark, sf_dir):
    """Words the mix takes of each document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    plan = mixing.mixing_plan(docs)
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@_register
def op7_url_filter(spark, sf_dir):
    """Verdict on every page url under the four fixed rules."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@_register
def op8_exact_dedup(spark, sf_dir):
    """The row that stays for every document."""
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def tokenizer_files() -> dict:
    """Where the public vocabulary is installed."""
    import public_tokenizers

    return {
        "tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@_register
def op9_best_fit_packing(spark, sf_dir):
    """Places of all pieces in sequences of 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, **tokenizer_files()).drop("row")


@_register
def op10_fingerprints(spark, sf_dir):
    """Fingerprints of every text, its edited text, and their likeness."""
    return fingerprints.edited_likeness(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op2_language(spark, sf_dir):
    """Predicted language of every text; learned where crc32(doc_id) mod 3 is not 1."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = document_remainder("doc_id", 3)
    langs, model = language.train(docs, remainder != 1)
    rows = docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "text")
    return language.predict(rows, langs, model)


@_register
def op4_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_extraction.extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_register
def op6_near_dedup(spark, sf_dir):
    """Near-duplicate group of every document."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op5_lm_score(spark, sf_dir):
    """Scores of all texts; learned where crc32(doc_id) mod 7 is not 2."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    remainder = document_remainder("doc_id", 7)
    rows = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text")
    return hmm_score.score(rows, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


@_register
def op3_line_dedup(spark, sf_dir):
    """Every document without the lines that an earlier one has."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@_register
def op11_periodic_runs(spark, sf_dir):
    """Runs of every text, of which every tenth id is made to go round."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    looped = docs.select("doc_id", periodic_runs.planted_loop("doc_id", "text").alias("text"))
    return periodic_runs.run_digests(periodic_runs.find_runs(looped))


@_register
def op12_prefix_trie(spark, sf_dir):
    """Nodes of the trie of all conversations, which start with turns of the first of their hundred."""
    conversations = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = written(prefix_trie.ordered_turns(conversations), "trie-turns")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_start(turns))


@_register
def op13_decontamination(spark, sf_dir):
    """Words of every document that lie in ten words of a benchmark item."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.overlap_digests(decontamination.find_overlaps(docs, items))
