"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are hashed by ``GRAM`` words in a row.  Of every ``SPAN - GRAM + 1``
such grams side by side the one with the smallest hash is a fingerprint, so
any ``SPAN`` words that a document shares with an item give both the same
fingerprint: none is missed.  Fingerprints are joined, and a hit is extended
to the window it came from: the grams at both ends of a window cover all its
words, so a window counts where its fingerprint and both ends agree.  Items of
fewer words are one window and one gram of their own length.

The texts are read once and stay where they are.  A document looks for its
minima only around grams whose bit is set in a bitmap of all fingerprints of
the items; the bitmap has 64 bits a fingerprint up to ``MAX_BITS``, beyond
which more windows go through the join, which decides alone.  Windows with a
set bit, word counts and ids are written; windows meet those of the items by
equality, items of equal words as one, and only what was hit is shuffled by
document.

Defined results: a NULL text, and one without words, has no words, no hits and
no windows.  Rows that agree in id and text get the same result, each its own
row; rows that share only the id are judged apart.  Items that share an id
count as one, those without an id make hits but are not listed.  Empty tables
of documents give no rows, of items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import is_small
from .common import let, written

#: Words of a shared span that is found without fail, and of a gram.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BITS_PER_FINGERPRINT = 64
LEAST_BITS, MAX_BITS = 1 << 16, 1 << 26

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, once A-Z are in lower case.
WORD = r"([0-9a-z\x{80}-\x{10FFFF}]+)"

WINDOWS = "array<struct<start: int, length: int, print: bigint, head: bigint, tail: bigint>>"
NAME = ("length", "print", "head", "tail")


def word_hashes(text: Column) -> Column:
    """One hash per word of a text, empty without words."""
    known = F.coalesce(text, F.lit(""))
    # Only A-Z are lowered; where there is nothing but ASCII, that is all lower() does.
    low = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))
    return F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(1)), lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, words: int) -> Column:
    """Hashes of all ``words`` words in a row; ``hashes`` must have so many."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - words),
        lambda i: F.xxhash64(F.lit(words), *[F.get(hashes, i + k) for k in range(words)]),
    )


def _window(start: Column, length: int, fingerprint: Column, head: Column, tail: Column) -> Column:
    named = {"start": start, "length": F.lit(length), "print": fingerprint, "head": head, "tail": tail}
    return F.struct(*[value.alias(name) for name, value in named.items()])


def _smallest(grams: Column, start: Column) -> Column:
    return F.least(*[F.get(grams, start + k) for k in range(WINDOW)])


def _long_window(grams: Column, start: Column) -> Column:
    return _window(start, SPAN, _smallest(grams, start), F.get(grams, start), F.get(grams, start + WINDOW - 1))


def _short_window(hashes: Column, length: int, start: Column) -> Column:
    """Two independent hashes of all its words name a short window."""
    words = [F.get(hashes, start + k) for k in range(length)]
    one = F.xxhash64(F.lit(length), *words)
    return _window(start, length, one, one, F.xxhash64(F.lit("short"), *words))


def _none() -> Column:
    return F.array().cast(WINDOWS)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, start, length, print, head, tail`` of every window of the items."""
    hashed = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("_words"))
    n = F.size("_words")
    every = let(
        gram_hashes(F.col("_words"), GRAM),
        lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - WINDOW), lambda j: _long_window(g, j)),
    )
    windows = F.when(n >= SPAN, every)
    for length in range(1, SPAN):
        windows = windows.when(n == length, F.array(_short_window(F.col("_words"), length, F.lit(0))))
    return hashed.select("item_id", F.explode(windows).alias("_w")).select("item_id", "_w.*")


def bitmap(prints: DataFrame) -> tuple[Column, int]:
    """The bits of all values of column ``print``, as a scalar array, and their number."""
    wanted = max(LEAST_BITS, min(MAX_BITS, BITS_PER_FINGERPRINT * prints.count()))
    bits = 1 << (wanted - 1).bit_length()
    at = F.col("print").bitwiseAND(F.lit(bits - 1))
    words = prints.groupBy(F.shiftright(at, 6).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((print & {bits - 1}) % 64 as int))")).alias("_set")
    )
    dense = prints.sparkSession.range(bits // 64).join(words, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("_set", F.lit(0)).alias("_set"))))
    return dense.agg(ordered["_set"].alias("bits")).scalar(), bits


def document_windows(text: Column, set_bits: Column, bits: int, short: list[int]) -> Column:
    """Number of words of a text and its windows whose fingerprint has its bit set."""

    def known(value: Column) -> Column:
        at = value.bitwiseAND(F.lit(bits - 1))
        return F.getbit(F.get(set_bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1

    def around(grams: Column, p: Column) -> Column:
        """The windows of which gram ``p`` is the smallest."""
        starts = F.sequence(F.greatest(F.lit(0), p - (WINDOW - 1)), F.least(p, F.size(grams) - WINDOW))
        return F.transform(
            F.filter(starts, lambda j: _smallest(grams, j) == F.get(grams, p)), lambda j: _long_window(grams, j)
        )

    def long(hashes: Column) -> Column:
        def seeded(grams: Column) -> Column:
            places = F.filter(F.transform(grams, lambda g, p: F.when(known(g), p)), lambda p: p.isNotNull())
            return F.array_distinct(F.flatten(F.transform(places, lambda p: around(grams, p))))

        return F.when(F.size(hashes) >= SPAN, let(gram_hashes(hashes, GRAM), seeded)).otherwise(_none())

    def of_length(hashes: Column, length: int) -> Column:
        def seeded(grams: Column) -> Column:
            places = F.filter(F.transform(grams, lambda g, p: F.when(known(g), p)), lambda p: p.isNotNull())
            return F.transform(places, lambda p: _short_window(hashes, length, p))

        return F.when(F.size(hashes) >= length, let(gram_hashes(hashes, length), seeded)).otherwise(_none())

    return let(
        word_hashes(text),
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.concat(long(h), *[of_length(h, length) for length in short]).cast(WINDOWS).alias("windows"),
        ),
    )


def _union(hits: Column) -> Column:
    """Number of words that sorted windows cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def step(seen: Column, hit: Column) -> Column:
        end = F.greatest(seen["end"], hit["start"] + hit["length"])
        return F.struct(
            end.alias("end"), (seen["words"] + end - F.least(end, F.greatest(seen["end"], hit["start"]))).alias("words")
        )

    return F.aggregate(hits, start, step, lambda seen: seen["words"])


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, hits, items`` of every document.

    ``hits`` are its windows that occur in an item, as sorted start and
    length; ``items`` the ids of those items as sorted text.
    """
    windows = written(item_windows(items, item_id, item_text), "leaks-item-windows")
    # Windows of equal content share one name; its items follow at the end.
    names = windows.select(*NAME).distinct()
    short = sorted(r["length"] for r in windows.where(F.col("length") < SPAN).select("length").distinct().collect())
    set_bits, bits = bitmap(names.select("print").distinct())
    keys = ["_id", "_hash"]
    # A subquery may not stand inside the expression that uses it; the optimizer
    # puts it there, so that the bits are not copied into the rows.
    judged = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"), set_bits.alias("_bits")
    ).select(
        *keys, let(F.col("_bits"), lambda known: document_windows(F.col("_text"), known, bits, short)).alias("_found")
    )
    table = written(judged.select(*keys, "_found.*"), "leaks-documents")
    candidates = table.where(F.size("windows") > 0).select(*keys, F.explode("windows").alias("_w")).select(*keys, "_w.*")
    # A row for each window of an item, so that a hit tells its item at once.
    listed = windows.select(*NAME, F.col("item_id").cast("string").alias("_item")).distinct()
    hits = candidates.join(F.broadcast(listed) if is_small(listed, "_item") else listed, list(NAME))
    # Copies of a row give the same hits once more; sets take them together.
    leaks = hits.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("hits"),
        F.sort_array(F.collect_set("_item")).alias("items"),
        F.lit(True).alias("_hit"),
    )
    same = F.col("t._id").eqNullSafe(F.col("l._id")) & F.col("t._hash").eqNullSafe(F.col("l._hash"))
    return (
        table.drop("windows")
        .alias("t")
        .join(leaks.alias("l"), same, "left")
        .select(
            F.col("t._id").alias("doc_id"),
            "n_words",
            F.when(F.col("_hit"), _union(F.col("hits"))).otherwise(F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("hits", F.array().cast("array<struct<start: int, length: int>>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def overlap_digests(found: DataFrame) -> DataFrame:
    """Counts, a digest of the items and the verdict of every document."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
