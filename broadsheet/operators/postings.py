"""A stored index of which words stand where, to answer terms without reading texts.

A cleaned text is cut at spaces and hyphens into parts.  The index has one row
per part and article with the places of the part, each marked by whether a
hyphen stands before and after it.  A phrase is a join of its parts on the
article, at places that follow one another.  Rows are laid out by a hash of the
part, so that a question reads only the folders of its own parts; the articles
of one part, however many, are spread over files and tasks by url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counting import tokens
from ..session import cut_lineage
from .bits import bitmap, let, may_hold
from .matching import term_hits
from .sizing import broadcast_if_small, rows_if_at_most

POSTINGS = "part string, url string, scrape_date date, places array<int>, bucket int"
#: Folders of the index, and files that the articles of a folder may always be spread over.
BUCKETS, SPREAD = 64, 4
#: Tasks that write the index for each core; the more, the less of it is being sorted at one time.
TASKS_PER_CORE = 4
#: Terms whose parts are looked up to choose folders.
LISTED_TERMS = 10_000
#: Bits of a place below its number: a hyphen stands before, after it.
BEFORE, AFTER = 1, 2


def bucket_of(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int")


def _parts(content: Column) -> Column:
    """``part, places`` of one text, in the order of the parts.

    The text is grouped where it is read: its parts are sorted, and each run of equal ones becomes one entry.
    """

    def marked(token: Column) -> Column:
        def of(parts: Column) -> Column:
            last = F.size(parts) - 1
            return F.transform(
                parts,
                lambda p, i: F.struct(
                    p.alias("part"), (F.when(i > 0, BEFORE).otherwise(0) + F.when(i < last, AFTER).otherwise(0)).alias("marks")
                ),
            )

        plain = F.array(F.struct(token.alias("part"), F.lit(0).alias("marks")))
        return F.when(F.contains(token, F.lit("-")), let(F.split(token, "-"), of)).otherwise(plain)

    placed = F.transform(
        F.flatten(F.transform(tokens(content), marked)),
        lambda p, at: F.struct(p["part"].alias("part"), (at * 4 + p["marks"]).alias("place")),
    )

    def grouped(found: Column) -> Column:
        begins = F.transform(
            found, lambda p, i: F.when((i == 0) | (p["part"] != F.get(found, i - 1)["part"]), i)
        )

        def entries(begins: Column) -> Column:
            return F.transform(
                begins,
                lambda i, j: F.struct(
                    F.get(found, i)["part"].alias("part"),
                    # Spark's slice goes over the whole array each time.
                    F.transform(
                        F.sequence(i, F.coalesce(F.get(begins, j + 1), F.size(found)) - 1), lambda at: F.get(found, at)["place"]
                    ).alias("places"),
                ),
            )

        return let(F.filter(begins, lambda i: i.isNotNull()), entries)

    return let(F.sort_array(F.filter(placed, lambda p: p["part"] != "")), grouped)


def _rows(articles: DataFrame) -> DataFrame:
    """The index rows of each article by itself, without a shuffle."""
    return articles.select("url", "scrape_date", F.posexplode(_parts(F.col("content"))).alias("_at", "_p")).select(
        "_p.part", "url", "scrape_date", "_p.places"
    )


def postings(articles: DataFrame) -> DataFrame:
    """The index rows of ``articles`` (``url, scrape_date, content``), whose urls are distinct.

    They are made where the texts are read.  Articles that share url and date
    all the same are found over these two, and only their rows are shuffled
    to become one per part.
    """
    key = F.xxhash64("url", "scrape_date")
    repeated = articles.groupBy(key.alias("_hash")).count().where("count > 1").select("_hash")
    rows = repeated.count()
    if not rows:
        return _rows(articles).withColumn("bucket", bucket_of(F.col("part")))
    set_bits, bits = bitmap(repeated, "_hash", rows)
    told = articles.withColumn("_bits", set_bits).withColumn("_again", may_hold(F.col("_bits"), bits, key)).drop("_bits")
    merged = (
        _rows(told.where("_again"))
        .groupBy("part", "url", "scrape_date")
        .agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    )
    return _rows(told.where("NOT _again")).unionByName(merged).withColumn("bucket", bucket_of(F.col("part")))


def laid_out(index: DataFrame) -> DataFrame:
    """Index rows as they are written: by folder, and sorted by part in a file.

    Each task writes the folders of the articles it has, so no row is
    shuffled; a folder has a file for each task, a few for each core at most.
    """
    most = max(SPREAD, TASKS_PER_CORE * index.sparkSession.sparkContext.defaultParallelism)
    return index.coalesce(most).sortWithinPartitions("bucket", "part", "url")


def is_indexed(term: Column) -> Column:
    """Whether the index can answer a term: parts with one space or hyphen between them."""
    return F.rlike(term, F.lit("^[^ -]+([ -][^ -]+)*$"))


def term_parts(terms: DataFrame) -> DataFrame:
    """``term, n, k, part, mark, whole`` of every part; ``mark`` stands before it."""
    parts = F.split("term", "[ -]")
    marks = F.regexp_replace("term", "[^ -]", "")
    return (
        terms.select("term", F.size(parts).alias("n"), marks.alias("_marks"), F.posexplode(parts).alias("k", "part"))
        .select(
            "term",
            "n",
            "k",
            "part",
            F.when(F.col("k") > 0, F.substring("_marks", F.col("k"), F.lit(1))).alias("mark"),
            (~F.contains("term", F.lit(" "))).alias("whole"),
        )
    )


def wanted_folders(index: DataFrame, parts: DataFrame) -> DataFrame:
    """The index without folders that hold none of ``parts``, where these are few."""
    if rows_if_at_most(parts.select("part"), LISTED_TERMS) is None:
        return index
    folders = [r["bucket"] for r in parts.select(bucket_of(F.col("part")).alias("bucket")).distinct().collect()]
    return index.where(F.col("bucket").isin(folders))


def _apart(starts: Column, n: Column) -> Column:
    """How many of sorted starts can be taken from the left without sharing a part."""
    begin = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("taken"))

    def step(seen: Column, start: Column) -> Column:
        fits = start > seen["end"]
        return F.struct(
            F.when(fits, start + n - 1).otherwise(seen["end"]).alias("end"),
            (seen["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"),
        )

    return F.aggregate(starts, begin, step, lambda seen: seen["taken"])


def term_pairs(parts: DataFrame) -> DataFrame:
    """``term, n, k, part, mark, next, next_mark, whole`` of every two neighbouring parts; ``k`` is the first one's."""
    following = parts.select(
        "term", (F.col("k") - 1).alias("k"), F.col("part").alias("next"), F.col("mark").alias("next_mark")
    )
    return parts.where("n > 1").join(following, ["term", "k"])


def _fits(place: Column, k: Column, mark: Column) -> Column:
    """Whether a part stands at ``place`` with the marks that part ``k`` of a term has around it."""
    hyphen_before = place.bitwiseAND(F.lit(BEFORE)) != 0
    hyphen_after = place.bitwiseAND(F.lit(AFTER)) != 0
    inner = mark.isNull() | ((mark == "-") == hyphen_before)
    opens = ~F.col("whole") | (k > 0) | ~hyphen_before
    closes = ~F.col("whole") | (k < F.col("n") - 1) | ~hyphen_after
    return inner & opens & closes


def _neighbours(listed: Column) -> Column:
    """``part, place, next, next_place`` of listed parts that follow one another in an article."""
    at = lambda o: F.shiftright(o["place"], 2)
    each = F.flatten(
        F.transform(
            listed, lambda r: F.transform(r["places"], lambda p: F.struct(p.alias("place"), r["part"].alias("part")))
        )
    )

    def most_at_once(found: Column) -> Column:
        """More than 1 where articles share a url: then several parts stand at one place."""
        begin = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(1).alias("most"))

        def step(seen: Column, o: Column) -> Column:
            run = F.when(at(o) == seen["at"], seen["run"] + 1).otherwise(1)
            return F.struct(at(o).alias("at"), run.alias("run"), F.greatest(seen["most"], run).alias("most"))

        return F.aggregate(found, begin, step, lambda seen: seen["most"])

    def pairs(found: Column) -> Column:
        def of(most: Column) -> Column:
            def after(o: Column, i: Column) -> Column:
                near = F.transform(F.sequence(i + 1, i + 2 * most - 1), lambda j: F.get(found, j))
                return F.transform(
                    F.filter(near, lambda f: at(f) == at(o) + 1),
                    lambda f: F.struct(
                        o["part"].alias("part"), o["place"].alias("place"), f["part"].alias("next"), f["place"].alias("next_place")
                    ),
                )

            return F.flatten(F.transform(found, after))

        return let(most_at_once(found), of)

    def unlike_the_one_before(found: Column) -> Column:
        return F.filter(found, lambda o, i: (i == 0) | (o != F.get(found, i - 1)))

    return let(let(F.sort_array(each), unlike_the_one_before), pairs)


def indexed_hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, url, scrape_date, hits``, for hits above 0: words as equal tokens, phrases at word ends.

    ``terms`` is ``term``, distinct; those that ``is_indexed`` does not take
    have no row.  A common part brings one row per article that has it, spread
    by article from there on, however many phrases it is in: phrases are
    joined over two neighbouring parts, once these have met in the article.
    """
    parts = cut_lineage(term_parts(terms.where(is_indexed(F.col("term")))))
    rows = wanted_folders(index, parts)
    words = broadcast_if_small(parts.where("n = 1"), "part")
    fitting = F.filter("places", lambda p: _fits(p, F.lit(0), F.lit(None).cast("string")))
    single = rows.join(words, "part").select(
        "term", "url", "scrape_date", F.size(fitting).cast("long").alias("hits")
    )
    listed = broadcast_if_small(parts.where("n > 1").select("part").distinct(), "part")
    met = (
        rows.join(listed, "part", "left_semi")
        .groupBy("url", "scrape_date")
        .agg(F.collect_list(F.struct("part", "places")).alias("_listed"))
        .select("url", "scrape_date", F.explode(_neighbours(F.col("_listed"))).alias("_o"))
        .select("url", "scrape_date", "_o.*")
    )
    pairs = broadcast_if_small(term_pairs(parts), "part")
    starts = (
        met.join(pairs, ["part", "next"])
        .where(_fits(F.col("place"), F.col("k"), F.col("mark")) & _fits(F.col("next_place"), F.col("k") + 1, F.col("next_mark")))
        .select("term", "n", "url", "scrape_date", "k", (F.shiftright("place", 2) - F.col("k")).alias("_start"))
    )
    # A start counts when all pairs of the term have it.
    common = (
        starts.groupBy("url", "scrape_date", "term", "n", "_start")
        .agg(F.size(F.collect_set("k")).alias("_pairs"))
        .where("_pairs = n - 1")
        .groupBy("url", "scrape_date", "term", "n")
        .agg(F.array_sort(F.collect_list("_start")).alias("_starts"))
    )
    phrases = common.select("term", "url", "scrape_date", _apart(F.col("_starts"), F.col("n")).alias("hits"))
    return single.unionByName(phrases).where("hits > 0")


def answered_hits(index: DataFrame, articles: DataFrame, terms: DataFrame) -> DataFrame:
    """``indexed_hits`` for all terms; odd ones, with edge or double marks, are looked for in the texts."""
    odd = terms.where((F.col("term") != "") & ~is_indexed(F.col("term"))).select("term")
    answered = indexed_hits(index, terms)
    if odd.isEmpty():
        return answered
    scanned = term_hits(articles, odd, keep=["url", "scrape_date"], bounded=True)
    summed = scanned.groupBy("term", "url", "scrape_date").agg(F.sum("hits").alias("hits")).where("hits > 0")
    return answered.unionByName(summed.select(*answered.columns))


def hits_by_date(hits: DataFrame, days: DataFrame, terms: list[str]) -> DataFrame:
    """``scrape_date`` and one column per term, ``kw_1, kw_2...``; days without a hit have 0.

    ``days`` are the scrape dates of the corpus, distinct.
    """
    of_term = [
        F.coalesce(F.sum(F.when(F.col("term") == t, F.col("hits"))), F.lit(0)).cast("long").alias(f"kw_{i}")
        for i, t in enumerate(terms, 1)
    ]
    return (
        days.where("scrape_date IS NOT NULL")
        .join(hits.groupBy("scrape_date", "term").agg(F.sum("hits").alias("hits")), "scrape_date", "left")
        .groupBy("scrape_date")
        .agg(*of_term)
        .orderBy("scrape_date")
    )
