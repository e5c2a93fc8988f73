"""Inputs of the registered queries.

Small parameters (dictionary, stop words, alias names) are written out here.
Everything else is derived by Spark from the given tables, so that it grows
with them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.counting import tokens
from broadsheet.functions.text import clean_text
from broadsheet.functions.urls import domain, host
from broadsheet.sources.documents import articles_from_documents, pages

STOP_WORDS = ["the", "of", "and", "it"]

# keyword, category, load position
DICTIONARY = [
    ("tion", "anchor", 1),
    ("on in", "basin", 2),
    ("ther", "basin", 3),
    ("is in", "cable", 4),
    ("mit", "dome", 5),
    ("orre", "anchor", 6),
    ("rewh", "cable", 7),
    ("license", "ember", 8),
    ("apache", "ember", 9),
    ("de la", "flint", 10),
    ("que", "flint", 11),
    ("purple harbour walk", "glade", 12),
    ("zzyzx", "glade", 13),
    ("und der", "dome", 14),
]

# name, iso2, iso3, canonical; invented countries over words of the corpus
GAZETTEER = [
    ("Tion", "TI", "TIO", None),
    ("Ther", "TH", "THR", "Tion"),
    ("On In", "OI", "OIN", None),
    ("Is In", "OJ", "OIN", None),
    ("De La", "DL", "NULL", None),
    ("Und Der", "UD", "NULL", None),
    ("License", "LI", "LIC", None),
    ("Apache", "LI", "LIC", "License"),
    ("Purple Harbour", "PH", "PHA", None),
    ("Zzyzx", "ZZ", "ZZY", None),
    ("Mit", "MI", None, None),
]

KEYWORD_A, KEYWORD_B = "tion", "on in"
# Terms that may overlap themselves, or hold others.
CLOSE_TERMS = ["in in", "in in in", "on in on", "la la", "de la de", "la de la de la", "en la", "in", "la"]
# What is put into texts in place of what, in this order.
PUT_INTO_TEXTS = [("on ", "on's "), ("es ", "es’x "), (" in ", " http://in.example/in ")]


def _local(spark: SparkSession, rows: list[tuple], names: list[str], types: list) -> DataFrame:
    columns = list(zip(*rows))
    arrays = [pa.array(column, kind) for column, kind in zip(columns, types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names))


def dictionary(spark: SparkSession) -> DataFrame:
    return _local(
        spark, DICTIONARY, ["keyword", "category", "load_pos"], [pa.string(), pa.string(), pa.int64()]
    )


def gazetteer(spark: SparkSession) -> DataFrame:
    return _local(spark, GAZETTEER, ["name", "iso2", "iso3", "canonical"], [pa.string()] * 4)


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return articles_from_documents(spark, sf_dir, STOP_WORDS, columns or ("url", "scrape_date", "content"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def in_letters(number: Column) -> Column:
    """A number spelt with the letters a to j, as names may hold no digits."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def cleaned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, first_doc``: each word of the corpus and where it is first seen."""
    # A plain explode would first test for empty texts, and clean every text twice.
    words = articles_with_id(spark, sf_dir).select("doc_id", F.explode_outer(tokens(F.col("content"))).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.min("doc_id").alias("first_doc"))


def articles_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, "url", "content").select(
        F.substring_index("url", "/", -1).cast("bigint").alias("doc_id"), "content"
    )


def benchmark_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword, category, load_pos`` from the benchmark passages.

    Each word and each pair of neighbouring words is a keyword, under the
    category of the first passage that has it.
    """
    cleaned = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", clean_text(F.col("text"), STOP_WORDS).alias("content")
    )
    each = tokens(F.col("content"))
    pairs = F.zip_with(
        each,
        F.slice(each, F.lit(2), F.size(each)),
        lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)).otherwise(F.lit("")),
    )
    terms = cleaned.select("item_id", F.explode(F.concat(each, pairs)).alias("keyword"))
    return (
        terms.where(F.col("keyword") != "")
        .groupBy("keyword")
        .agg(F.min("item_id").alias("load_pos"))
        .select("keyword", in_letters(F.col("load_pos")).alias("category"), "load_pos")
    )


def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, category``: one per document; two Spanish documents of a ten share a name."""
    doc_id = F.col("doc_id")
    shared = (F.col("lang") == "es").cast("bigint") * (doc_id - F.floor(doc_id / 10) * 10)
    return documents(spark, sf_dir, "doc_id", "lang").select(
        (doc_id + 1).cast("int").alias("id"), in_letters(doc_id - shared).alias("category")
    )


def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword, category_id, load_pos``: each word under its first document."""
    return cleaned_words(spark, sf_dir).select(
        F.col("word").alias("keyword"),
        (F.col("first_doc") + 1).cast("int").alias("category_id"),
        F.col("first_doc").alias("load_pos"),
    )


def each_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, doc_id, lang, source, word``: every word of every whole text."""
    placed = documents(spark, sf_dir, "doc_id", "lang", "source", "text").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", " ")).alias("pos", "word")
    )
    return placed.select((F.col("doc_id") * 1048576 + F.col("pos")).alias("request_id"), "doc_id", "lang", "source", "word")


def category_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, typed``: a category name typed for each word."""
    doc_id, lang = F.col("doc_id"), F.col("lang")
    typed = (
        F.when(lang == "fr", F.concat(F.lit("  "), F.upper(in_letters(doc_id)), F.lit(" ")))
        .when(lang == "de", F.concat(F.lit("New "), in_letters(F.floor(doc_id / 10))))
        .when(F.col("source") == "src3", F.lit(" "))
        .otherwise(F.col("word"))
    )
    return each_word(spark, sf_dir).select("request_id", typed.alias("typed"))


def keyword_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, typed, typed_keyword``: category by id or name, and a word."""
    doc_id, lang = F.col("doc_id"), F.col("lang")
    typed = (
        F.when(lang == "en", (doc_id + 1).cast("string"))
        .when(lang == "fr", F.upper(in_letters(doc_id)))
        .when(lang == "de", F.concat(F.lit("no "), in_letters(doc_id)))
        .otherwise(F.lit(""))
    )
    typed_keyword = F.when(
        F.col("source") == "src4", F.concat(F.lit("Fresh "), in_letters(F.floor(doc_id / 20)))
    ).otherwise(F.col("word"))
    return each_word(spark, sf_dir).select(
        "request_id", typed.alias("typed"), typed_keyword.alias("typed_keyword")
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, typed, typed_keyword`` naming what to delete."""
    doc_id, lang = F.col("doc_id"), F.col("lang")
    typed = (
        F.when(lang == "de", (doc_id + 1).cast("string"))
        .when(lang == "fr", F.initcap(in_letters(doc_id)))
        .otherwise(F.lit("unheard of"))
    )
    typed_keyword = F.when(lang == "de", F.lit("2")).otherwise(
        F.regexp_replace("word", "[.,]", "")
    )
    return each_word(spark, sf_dir).select(
        "request_id", typed.alias("typed"), typed_keyword.alias("typed_keyword")
    )


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seed_pos, category, keywords``: one seed entry per document."""
    return articles_with_id(spark, sf_dir).select(
        F.col("doc_id").alias("seed_pos"),
        in_letters(F.col("doc_id")).alias("category"),
        F.filter(tokens(F.col("content")), lambda w: w != "").alias("keywords"),
    )


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, iso2, name``: every word of the corpus listed under its sources."""
    listed = articles(spark, sf_dir, "url", "content").select(
        F.substring_index("url", "/", -1).cast("int").alias("pos"),
        F.upper(F.split_part(F.split_part("url", F.lit("src"), F.lit(2)), F.lit("."), F.lit(1))).alias("iso2"),
        # A plain explode would first test for empty texts, and clean every text twice.
        F.explode_outer(tokens(F.col("content"))).alias("name"),
    )
    return listed.where(F.col("name") != "")


def place_iso3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``iso2, iso3``: codes of the sources that published in Spanish."""
    return (
        documents(spark, sf_dir, "source", "lang")
        .where(F.col("lang") == "es")
        .select(F.regexp_replace("source", "src", "").alias("iso2"))
        .distinct()
        .select("iso2", F.concat(F.lit("X"), F.lpad("iso2", 2, "0")).alias("iso3"))
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir, ["page_id", "url"])


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls as queued, at a time derived from the id."""
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    seconds = (F.col("page_id") * 37 % 5000).cast("int")
    return page_urls(spark, sf_dir).select(
        "url",
        (start + F.make_dt_interval(secs=seconds)).alias("scrape_time"),
        (F.col("page_id") % 3).cast("int").alias("scrape_retries"),
    )


def stored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).where(F.contains("url", F.lit("www."))).select("url")


def excluded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        page_urls(spark, sf_dir)
        .where(F.contains("url", F.lit("/fr/")))
        .select("url", F.lit("listed").alias("reason"))
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain, page, url``: every page taken as a listing page of its host."""
    bare = F.regexp_replace(F.col("url"), r"^https?://(www\.)?", "")
    return page_urls(spark, sf_dir).select(
        F.substring_index(bare, "/", 1).alias("domain"),
        F.regexp_replace(bare, "^[^/]*", "").alias("page"),
        "url",
    )


def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link rule per host."""
    own = F.col("domain")
    return (
        listings(spark, sf_dir)
        .select("domain")
        .distinct()
        .select(
            "domain",
            F.when(F.startswith(own, F.lit("blog.")), F.lit("^/[a-z]")).otherwise(F.lit("^/")).alias("url_filter"),
            F.when(F.startswith(own, F.lit("m.")), F.array(F.lit("ing$"), F.lit("[.,]$")))
            .otherwise(F.array().cast("array<string>"))
            .alias("url_exclusion"),
            F.lit("").alias("pagin_filter"),
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain, div_filter, p_attr_exclusion``: one rule per https domain but mobile ones."""
    own = F.col("domain")
    return (
        page_urls(spark, sf_dir)
        .select(domain(F.col("url")).alias("domain"))
        .where((own != "http:") & ~F.startswith(own, F.lit("m.")))
        .distinct()
        .select(
            "domain",
            F.when(F.startswith(own, F.lit("blog.")), "^ad$")
            .when(F.startswith(own, F.lit("thther")), "no-such-class")
            .alias("div_filter"),
            F.array(F.lit("promo")).alias("p_attr_exclusion"),
        )
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select(host(F.col("url")).alias("host"))


def paged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a listing of three landed pages; the last leads to one that is not there.

    Where the url has a query, the next pages add to it.
    """
    bare = F.regexp_replace(F.col("url"), r"^https?://(www\.)?", "")
    numbered = pages(spark, sf_dir, ["url", "html"]).select(
        bare.alias("bare"), "html", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")
    )
    # A listing's next page is what follows the last question mark, put after the listing.
    mark = F.concat(F.lit("?page="), "k")
    here = F.concat(F.lit("https://www."), "bare", F.when(F.col("k") == 1, "").otherwise(mark))
    onward = F.concat(F.lit('<a class="pager next" href="?page='), F.col("k") + 1, F.lit('">on</a><h1>'))
    return numbered.select(here.alias("url"), F.replace("html", F.lit("<h1>"), onward).alias("html"))


#: Put at the start of an article; none of these paragraphs stays.
UNWANTED = (
    "<figcaption><p>caption</p></figcaption>" * 3
    + '<p>gone <span class="no-exclude">x</span></p>' * 2
    + '<p data-kind="big promo">gone</p><p class="a promo-b">gone</p>'
)
MARKED = "".join(f'<section class="x paragraph-{k}"> Marked {k} here </section>' for k in range(8))


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its article in another kind of container, by the sixth of its id."""
    html = F.col("html")
    kind = F.col("page_id") % 6
    story = '<article class="lead story">'
    by_id = F.replace(F.replace(html, F.lit("<article>"), F.lit('<div id="the-story">')), F.lit("</article>"), F.lit("</div>"))
    changed = (
        F.when(kind == 0, F.replace(html, F.lit("<article>"), F.lit(story + UNWANTED)))
        .when(kind == 1, by_id)
        .when(kind == 2, F.replace(html, F.lit("<article>"), F.lit(story + MARKED)))
        .when(kind == 3, F.concat(F.lit('<div class="story"></div>'), F.replace(html, F.lit("<article>"), F.lit(story))))
        .when(kind == 4, F.concat(F.lit('<div class="my story">' + "<p> t </p>" * 9 + "</div>"), F.replace(html, F.lit("<article>"), F.lit(story))))
        .otherwise(html)
    )
    return pages(spark, sf_dir).withColumn("html", changed)


def odd_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for every https domain: containers named like a story, without promotions."""
    return (
        page_urls(spark, sf_dir)
        .select(domain(F.col("url")).alias("domain"))
        .where(F.col("domain") != "http:")
        .distinct()
        .select("domain", F.lit("story").alias("div_filter"), F.array(F.lit("promo")).alias("p_attr_exclusion"))
    )


def class_pager(html: Column) -> Column:
    """Each menu link as a pager by class; the last one counts."""
    return F.replace(html, F.lit('<li><a href="/'), F.lit('<li><a class="pager next" href="?page='))


def labelled_pager(html: Column) -> Column:
    """Each menu link as a pager by aria-label; the first one counts."""
    return F.replace(html, F.lit('<li><a href="/'), F.lit('<li><a aria-label="pager" href="?page='))


def heading_pager(html: Column) -> Column:
    """The heading as a tag of the pager class with a query attribute."""
    return F.replace(html, F.lit("<h1>"), F.lit('<h1 class="pager" data-id="7" data-next="/x?from=h1">'))
