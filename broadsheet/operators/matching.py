"""Which dictionary terms occur in which text, and how often.

Two plans give the same rows:

* A dictionary of hand-edited size is put into the plan as literals.  Each
  text is tested where it is scanned: one hash lookup per token for single
  words, one substring test per phrase.  No join and no shuffle.
* A larger dictionary is joined by equality.  A phrase is known by the number
  of its tokens, a hash of those inside it and the letters that its first token
  ends and its last begins with.  A text is scanned once, whatever the size of
  the dictionary: at each of its tokens, the units that a bitmap of the
  dictionary may hold go on, with the few tokens they are made of, and the join
  checks their letters.  What a scan passes on does not grow with the longest
  phrase, and the texts never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.counting import count_bounded_phrase, count_phrase, tokens
from ..session import cut_lineage
from .bits import bitmap, may_hold
from .sizing import is_small, rows_if_at_most

# Measured on local cores: beyond about this many phrases, one substring test
# per phrase costs more than the equality join.
INLINE_PHRASES = 300
INLINE_WORDS = 2_000
ANCHOR_SIDE = 3


def is_phrase(term: Column) -> Column:
    return F.contains(term, F.lit(" "))


def split_terms(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    """Single words and phrases."""
    return [t for t in terms if " " not in t], [t for t in terms if " " in t]


def distinct_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Each non-empty term once; the empty term matches nothing."""
    return terms.select(F.col(column).alias("term")).where(F.col("term") != "").distinct()


def inline_terms(terms: DataFrame, column: str = "term") -> list[str] | None:
    """The distinct terms when few enough for the literal plan, else None.

    All rows are counted, not just distinct terms, so that a table passing
    this check may also be broadcast whole.
    """
    rows = rows_if_at_most(terms.select(column), INLINE_WORDS + INLINE_PHRASES)
    if rows is None:
        return None
    found = sorted({row[0] for row in rows if row[0]})
    words, phrases = split_terms(found)
    return found if len(words) <= INLINE_WORDS and len(phrases) <= INLINE_PHRASES else None


def _phrase_count(bounded: bool):
    return count_bounded_phrase if bounded else count_phrase


def known_tokens(content: Column, words: Sequence[str]) -> Column:
    """The tokens of a text that are dictionary words, repeats kept."""
    if not words:
        return F.array().cast("array<string>")
    return F.filter(tokens(content), lambda t: t.isin(list(words)))


def known_phrases(content: Column, phrases: Sequence[str], bounded: bool) -> Column:
    """Array of (term, hits) for the phrases that occur in a text."""
    if not phrases:
        return F.array().cast("array<struct<term:string,hits:bigint>>")
    count = _phrase_count(bounded)
    present = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(content, p))
    return F.transform(present, lambda p: F.struct(p.alias("term"), count(content, p).alias("hits")))


def term_hits(
    articles: DataFrame,
    terms: DataFrame,
    keep: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Rows ``(*keep, *terms.columns, hits)`` to be summed by the caller.

    ``terms`` has a ``term`` column and may carry others, such as the
    category.  A term may come in several rows of one text, and with zero
    hits where a phrase occurs but is not ``bounded`` by word ends.  The
    partial sum runs before any shuffle, so a term found everywhere costs no
    more than a rare one.
    """
    listed = inline_terms(terms)
    if listed is not None:
        return _literal_hits(articles, terms, listed, keep, bounded)
    return _joined_hits(articles, terms, keep, bounded)


def _literal_hits(
    articles: DataFrame, terms: DataFrame, listed: list[str], keep: Sequence[str], bounded: bool
) -> DataFrame:
    words, phrases = split_terms(listed)
    content = F.col("content")
    once = F.transform(
        known_tokens(content, words),
        lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("hits")),
    )
    hits = articles.select(*keep, F.inline(F.concat(once, known_phrases(content, phrases, bounded))))
    if terms.columns == ["term"]:
        return hits
    # The row count of this side was checked when the terms were listed.
    return hits.join(F.broadcast(terms), "term").select(*keep, *terms.columns, "hits")


def _joined_hits(articles: DataFrame, terms: DataFrame, keep: Sequence[str], bounded: bool) -> DataFrame:
    lookup = _lookup(terms)
    # At most one row per token count and pair of anchor lengths.
    shapes = (
        lookup.groupBy("_size", "_before", "_after")
        .agg(F.count("*").alias("rows"), F.max("_overlaps").alias("overlaps"))
        .collect()
    )
    if not shapes:
        return articles.limit(0).crossJoin(F.broadcast(terms.limit(0))).select(*keep, *terms.columns, F.lit(0).cast("long").alias("hits"))
    set_bits, bits = bitmap(lookup, "_unit", sum(s["rows"] for s in shapes))
    side = lookup.drop("_before", "_after")
    side = F.broadcast(side) if is_small(side, "term") else side
    one = F.lit(1).cast("long")
    met = _listed_units(articles, shapes, set_bits, bits, keep).join(side, "_unit").where(_meets())
    if bounded:
        met = met.withColumn("hits", F.when(F.col("_size") > 1, count_bounded_phrase(_in_place(), F.col("term"))).otherwise(one))
    else:
        met = met.withColumn("hits", one)
    columns = [*keep, *terms.columns, "hits"]
    if not any(s["overlaps"] for s in shapes):
        return met.select(*columns)
    # Matches that may share letters are counted from the left, those of one text together; all others are
    # summed where they are found, whatever their text.
    shared = F.col("_overlaps") & F.col("_close")
    place = F.when(shared & (F.col("hits") > 0), F.struct(_start().alias("start"), _end().alias("end")))
    return (
        met.withColumn("_place", place)
        .withColumn("_text_row", F.when(shared, F.col("_row")))
        .groupBy(*keep, *terms.columns, "_text_row")
        .agg(F.sort_array(F.collect_list("_place")).alias("_places"), F.sum("hits").alias("_hits"))
        .select(
            *keep, *terms.columns, F.when(F.col("_text_row").isNotNull(), _taken(F.col("_places"))).otherwise(F.col("_hits")).alias("hits")
        )
    )


def _listed_units(articles: DataFrame, shapes: list[Row], set_bits: Column, bits: int, keep: Sequence[str]) -> DataFrame:
    """``*keep, _row, _unit, _at, _piece, _close``: each unit that may be listed, its place and its tokens.

    Each token is a row of the scan, and the units that begin there are named
    and looked up in the bitmap before anything is copied: by built-in
    expressions that are compiled with the scan, the same ones for every shape,
    so that their code stays short.  ``_close`` is false only where the same
    unit does not begin less than its own length away.
    """
    tokens_, at, size, before, after = (F.col(c) for c in ("_tokens", "_at", "_length", "_left", "_right"))
    kinds = [
        F.struct(F.lit(s["_size"]).alias("_length"), F.lit(s["_before"]).alias("_left"), F.lit(s["_after"]).alias("_right"))
        for s in shapes
    ]
    unit, last = F.col("_unit"), F.size(tokens_) - (size - 1)

    def alike(i: Column) -> Column:
        """Whether a unit of two tokens begins and ends like the one before ``i``."""
        first, second, third = (F.get(tokens_, i + k) for k in (-2, -1, 0))
        return (F.right(first, before) == F.right(second, before)) & (F.left(second, after) == F.left(third, after))

    again = ((at > 1) & alike(at)) | ((at < last) & alike(at + 1))
    return (
        articles.select(*keep, F.monotonically_increasing_id().alias("_row"), tokens(F.col("content")).alias("_tokens"))
        .select(*keep, "_row", "_tokens", F.posexplode_outer("_tokens").alias("_skipped", "_token"))
        .select(*keep, "_row", "_tokens", (F.col("_skipped") + 1).alias("_at"), F.inline(F.array(*kinds)))
        .where(at <= last)
        # A row of its own keeps the name from being worked out again at each use.
        .select("*", F.explode(F.array(_unit(tokens_, at, size, before, after))).alias("_unit"))
        .where(may_hold(set_bits, bits, unit))
        .select(*keep, "_row", "_unit", "_at", F.slice(tokens_, at, size).alias("_piece"), ((size > 2) | ((size > 1) & again)).alias("_close"))
    )


def _unit(tokens_: Column, i: Column, size: Column, before: Column, after: Column) -> Column:
    """The name of ``size`` tokens of a text from the 1-based ``i`` on."""
    first, last = F.get(tokens_, i - 1), F.get(tokens_, i + size - 2)
    phrase = F.xxhash64(
        size * 16 + before * 4 + after,
        F.right(first, before),
        F.slice(tokens_, i + 1, F.greatest(size - 2, F.lit(0))),
        F.left(last, after),
    )
    return F.when(size == 1, F.xxhash64(F.lit(1), first)).otherwise(phrase)


def _inner(tokens_: Column) -> Column:
    return F.slice(tokens_, F.lit(2), F.greatest(F.size(tokens_) - 2, F.lit(0)))


def _meets() -> Column:
    """Whether the tokens of a text hold the term that shares their unit, letter by letter."""
    first, last = F.get("_piece", 0), F.element_at("_piece", -1)
    phrase = (
        F.endswith(first, F.col("_first"))
        & F.startswith(last, F.col("_last"))
        & (F.size("_piece") == F.col("_size"))
        & (_inner(F.col("_piece")) == F.col("_inner"))
    )
    return F.when(F.col("_size") == 1, first == F.col("term")).otherwise(phrase)


def _in_place() -> Column:
    """The phrase where it was met, with one more character on either side."""
    first = F.right(F.get("_piece", 0), F.length("_first") + 1)
    last = F.left(F.element_at("_piece", -1), F.length("_last") + 1)
    return F.array_join(F.concat(F.array(first), F.col("_inner"), F.array(last)), " ")


def _start() -> Column:
    """Where a match starts: its token, and the letter in it."""
    return F.struct(F.col("_at").alias("token"), (F.length(F.get("_piece", 0)) - F.length("_first")).alias("letter"))


def _end() -> Column:
    return F.struct((F.col("_at") + F.col("_size") - 1).alias("token"), F.length("_last").alias("letter"))


def _taken(places: Column) -> Column:
    """How many of sorted matches can be taken from the left without sharing a letter."""
    none = F.struct(F.lit(0).alias("token"), F.lit(0).alias("letter"))
    begin = F.struct(none.alias("end"), F.lit(0).cast("long").alias("taken"))

    def step(seen: Column, place: Column) -> Column:
        fits = place["start"] >= seen["end"]
        return F.struct(
            F.when(fits, place["end"]).otherwise(seen["end"]).alias("end"),
            (seen["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"),
        )

    return F.aggregate(places, begin, step, lambda seen: seen["taken"])


def _can_overlap(term: Column) -> Column:
    """True for a phrase that begins the way it ends, if by one letter only."""
    lengths = F.sequence(F.lit(1), F.length(term) - 1)
    return is_phrase(term) & F.exists(lengths, lambda n: F.left(term, n) == F.right(term, n))


def _lookup(terms: DataFrame) -> DataFrame:
    """The dictionary by the unit each term is looked up with, written once."""
    term, size = F.col("term"), F.col("_size")
    parted = (
        terms.where(term != "")
        .withColumn("_words", tokens(term))
        .withColumn("_size", F.size("_words"))
        .withColumn("_first", F.get("_words", 0))
        .withColumn("_last", F.element_at("_words", -1))
        .withColumn("_inner", _inner(F.col("_words")))
        .withColumn("_overlaps", _can_overlap(term))
        .withColumn("_before", F.when(size > 1, F.least(F.lit(ANCHOR_SIDE), F.length("_first"))).otherwise(0))
        .withColumn("_after", F.when(size > 1, F.least(F.lit(ANCHOR_SIDE), F.length("_last"))).otherwise(0))
        .drop("_words")
    )
    shape = size * 16 + F.col("_before") * 4 + F.col("_after")
    phrase = F.xxhash64(shape, F.right("_first", F.col("_before")), F.col("_inner"), F.left("_last", F.col("_after")))
    return cut_lineage(parted.withColumn("_unit", F.when(size == 1, F.xxhash64(F.lit(1), term)).otherwise(phrase)))
