"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The five-word shingles of a text are hashed once; the leading bits of a hash
name a bin, and each bin keeps its smallest hash.  Empty bins are filled by
optimal densification: bin b probes bins in a random order that depends on b
alone, and takes the first one that is not empty.  The low bits
of the bins are stored; the likeness of two fingerprints is the share of
equal bins, corrected for bins that are equal by chance.

Defined results: words are separated by white space and compared in lower
case; a text of fewer words has one shingle, all its words.  A NULL text and
one without words have an empty fingerprint, which is like another empty one
(1) and unlike all others (0).  In the order of ``with_next``, rows with equal
id and text share one place; of rows that only share the id, or have no id,
the hash of the text decides; NULL ids come last.  An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from .common import WORD, let, written

SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Probes of the densification that are looked at one by one; should all be
#: empty, the bin with the smallest hash for b is taken of those that are not.
SHORT_PROBES = 24


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the shingles of a text, with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < SHINGLE_WORDS, F.array(F.xxhash64(h)))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)]),
            )
        ),
    )


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS).cast("int")


def signature(text: Column) -> Column:
    """The low bits of all bins, as an array of ``BINS`` numbers; empty without shingles."""

    def smallest(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (_bin(F.get(ordered, i - 1)) != _bin(x)))

    def bins(filled: Column) -> Column:
        """Every bin, NULL where no shingle fell."""
        by_bin = F.map_from_arrays(F.transform(filled, _bin), filled)
        return F.when(F.size(filled) == BINS, filled_in_order(filled)).otherwise(
            let(
                by_bin,
                lambda found: F.transform(
                    F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.element_at(found, b)
                ),
            )
        )

    def filled_in_order(filled: Column) -> Column:
        """All bins are there; signed order starts with the upper half."""
        half = BINS // 2
        return F.concat(F.slice(filled, half + 1, half), F.slice(filled, 1, half))

    def densify(dense: Column) -> Column:
        def last_resort(b: Column) -> Column:
            """The bin that is not empty with the smallest hash for ``b``."""
            there = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda p: F.get(dense, p).isNotNull())
            ranked = F.transform(there, lambda p: F.struct(F.xxhash64(b, p, F.lit("rest")).alias("h"), p.alias("p")))
            return F.get(dense, F.array_min(ranked)["p"])

        def value(v: Column, b: Column) -> Column:
            probes = [
                F.get(dense, F.pmod(F.xxhash64(b, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(SHORT_PROBES)
            ]
            return F.coalesce(v, *probes, last_resort(b)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("short")

        return F.transform(dense, value)

    filled = let(F.sort_array(shingle_hashes(text)), smallest)
    return let(
        filled,
        lambda f: F.when(F.size(f) == 0, F.array().cast("array<smallint>")).otherwise(let(bins(f), densify)),
    )


def packed(sig: Column) -> Column:
    """A signature as hexadecimal digits."""
    digits = LOW_BITS // 4
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), digits, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, from 0 to 1."""
    chance = 1.0 / (1 << LOW_BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    estimate = (equal / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, signature, fingerprint`` of every row; nothing is shuffled."""
    signed = docs.select(F.col(doc_id).alias("doc_id"), signature(F.col(text)).alias("signature"))
    return signed.withColumn("fingerprint", packed(F.col("signature")))


KEYS = ("_no_id", "_id", "_hash")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).isNull().alias("_no_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(content).alias("_hash"),
        content.alias("_text"),
    )


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends in the start of the next document (descending id,
    the first after the last) where its own second half was.  Texts are
    shuffled once, by their key; of the next text only the part that is used
    follows, by the key of the row that uses it.
    """
    keyed = _keyed(docs, doc_id, text)
    places = written(
        number_rows(
            keyed.groupBy(*KEYS, F.length("_text").cast("long").alias("_chars")).agg(F.count("*").alias("_copies")),
            [*KEYS, "_chars"],
            "_place",
        ),
        "fingerprint-places",
    )
    last = places.count()
    # Row q is the next one of row q + 1, and the last place of row 1.
    user = F.when(F.col("_place") == 1, F.lit(last)).otherwise(F.col("_place") - 1)
    users = places.select(
        user.alias("_place"),
        F.floor(F.col("_chars") / 2).cast("int").alias("_want"),
        *[F.col(k).alias(f"_user{k}") for k in KEYS],
    )
    placed = places.join(users, "_place")
    texts = keyed.groupBy(*KEYS).agg(F.first("_text").alias("_text"))
    both = texts.join(placed, list(KEYS))
    starts = both.select(
        *[F.col(f"_user{k}").alias(k) for k in KEYS], F.expr("substring(_text, 1, _want)").alias("_start")
    )
    own = both.select(*KEYS, "_text", "_chars", "_copies", "_place").join(starts, list(KEYS))
    edited = F.concat(
        F.expr("substring(_text, 1, cast(_chars - floor(_chars / 2) as int))"), F.col("_start")
    )
    signed = written(
        own.withColumn("_edited", edited).select(
            "_place",
            F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"),
            F.col("_copies"),
            F.col("_chars").alias("n_chars"),
            F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
            signature(F.col("_text")).alias("_signature"),
            signature(F.col("_edited")).alias("_edited_signature"),
        ),
        "fingerprint-signatures",
    )
    following = signed.select(
        F.when(F.col("_place") == last, F.lit(1)).otherwise(F.col("_place") + 1).alias("_place"),
        F.col("_signature").alias("_next_signature"),
    )
    return (
        signed.join(following, "_place")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            packed(F.col("_signature")).alias("fingerprint"),
            packed(F.col("_edited_signature")).alias("edited_fingerprint"),
            likeness(F.col("_signature"), F.col("_edited_signature")).alias("near_edited"),
            likeness(F.col("_signature"), F.col("_next_signature")).alias("near_next"),
        )
    )
