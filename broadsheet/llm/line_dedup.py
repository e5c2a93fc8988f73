"""Line dedup by a tree of line templates, in DataFrame functions only.

A line is parsed to a fixed depth: tokens with a digit become ``<*>``, then
the number of tokens and the leading tokens lead to a leaf.  The distinct
masked lines of a leaf are its variants.  They are generalised to templates by
agreement, never by a share of the leaf, so that what else a leaf holds does not
matter: a token that no other variant of the leaf has at its place becomes a
variable field; then, until nothing changes, so does a token where templates
that agree in all other places have ``MIN_VALUES`` tokens or a field already.  A
template keeps ``MIN_CONSTANT`` of its tokens.  A template that recurs across
documents stays in its first document and is dropped from all others, and so is
a masked line that recurs as it is; inside one document nothing is dropped.

Texts are parsed once.  Lines then move as hashes; only lines of leaves with
several variants are taken apart, and texts move once, to meet what is dropped
from them.  Counts are partial sums before every shuffle, so a line that a third
of all documents share is one row per partition.

Defined results: a document is an (id, text) pair, and rows that agree in
both are one document; NULL ids count as ids and come last.  Lines with fewer
than ``MIN_TOKENS`` tokens are not generalised, and recur in ``MIN_SHORT``
documents; empty lines stay.  A NULL text stays NULL.  Of documents
with the same line the one with the smallest id keeps it (then the one with the
smaller hash of its text).  Other columns pass through.  An empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import let, written

#: Leading tokens that lead to a leaf, and tokens of a line that has templates.
DEPTH, MIN_TOKENS = 3, 6
#: Documents in which a masked line recurs, a short one, and a generalised template.
MIN_DOCUMENTS, MIN_SHORT, MIN_GENERALISED = 2, 10, 5
#: Tokens that templates which agree elsewhere have in a variable field.
MIN_VALUES = 3
#: Share of tokens that are not variable in a generalised template.
MIN_CONSTANT = 0.75
FIELD = "<*>"

KEYS = ("_no_id", "_id", "_hash")
#: A masked line by two hashes: of what leads to its leaf, and of all of it.
VARIANT = ("_leaf", "_line1")


def _keys(doc_id: str, text: str) -> list[Column]:
    return [
        F.col(doc_id).isNull().alias("_no_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
    ]


def _masked(text: Column) -> Column:
    """A text with single spaces and masked tokens.

    Most texts have single spaces and many no digit; they are left as they are
    after a search.  A token is masked from its start on, so long tokens are
    read once.
    """
    uneven = [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")]
    any_uneven = uneven[0] | uneven[1] | uneven[2] | uneven[3] | uneven[4]
    single = F.when(any_uneven, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return let(
        single,
        lambda t: F.when(
            F.rlike(t, F.lit("[0-9]")), F.regexp_replace(t, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)
        ).otherwise(t),
    )


def _parsed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Keys, line number, masked line, number of tokens and leaf of every line that is not empty."""
    lines = docs.select(*_keys(doc_id, text), F.posexplode(F.split(_masked(F.col(text)), "\n", -1)).alias("_line", "_raw"))
    spaces = F.octet_length("_masked") - F.octet_length(F.replace("_masked", F.lit(" "), F.lit("")))
    return (
        lines.select(*KEYS, "_line", F.trim("_raw").alias("_masked"))
        .where("_masked <> ''")
        .withColumn("_tokens", spaces + 1)
        .withColumn("_leaf", F.xxhash64("_tokens", F.substring_index("_masked", " ", DEPTH)))
        .withColumn("_line1", F.xxhash64("_masked"))
    )


def _owner() -> Column:
    return F.min(F.struct(*KEYS)).alias("_owner")


def _hashes(place: str, token: Column) -> list[Column]:
    """A template is named by the sums without carry of these over its places."""
    return [F.xxhash64(place, token), F.xxhash64(F.lit("template"), F.col(place), token)]


TEMPLATE = ("_leaf", "_template1", "_template2")


def generalised(lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants and the template of each that has one, as ``VARIANT, _template1, _template2``."""
    # A template is never in more documents than its whole leaf.
    leaves = written(
        variants.where(F.col("_tokens") >= MIN_TOKENS)
        .groupBy("_leaf")
        .agg(F.count("*").alias("_variants"), F.sum("_documents").alias("_in"))
        .where((F.col("_variants") > 1) & (F.col("_in") >= MIN_GENERALISED)),
        "lines-leaves",
    )
    wanted = leaves.select("_leaf")
    taken = lines.join(broadcast_if_small(wanted, "_leaf"), "_leaf")
    distinct = taken.groupBy(*VARIANT, "_tokens").agg(F.first("_masked").alias("_masked"))
    tokens = written(
        distinct.select(*VARIANT, "_tokens", F.posexplode(F.split("_masked", " ")).alias("_place", "_token")), "lines-tokens"
    )
    place = ["_leaf", "_place", "_token"]
    shared = tokens.groupBy(*place).agg(F.count("*").alias("_having")).where("_having > 1").select(*place, F.lit(True).alias("_shared"))
    one, two = _hashes("_place", F.col("_known"))
    known = F.when(F.col("_shared"), F.col("_token")).otherwise(FIELD)
    first = written(
        tokens.join(shared, place, "left")
        .withColumn("_known", known)
        .groupBy(*VARIANT, "_tokens")
        .agg(
            F.bit_xor(one).alias("_template1"),
            F.bit_xor(two).alias("_template2"),
            F.sum((F.col("_known") == FIELD).cast("int")).alias("_fields"),
            F.collect_list(F.struct("_place", "_known")).alias("_places"),
        )
        .where(F.col("_tokens") - F.col("_fields") >= F.col("_tokens") * MIN_CONSTANT),
        "lines-first",
    )
    of_variant = first.select(*VARIANT, "_template1", "_template2")
    templates = first.groupBy(*TEMPLATE, "_tokens").agg(F.first("_places").alias("_places"))
    # Templates meet inside their leaf only: a leaf in which nothing moved is done, and not looked at again.
    done = []
    while True:
        templates = written(templates, "lines-templates")
        moved = written(merged(templates), "lines-merged")
        leaves = written(moved.select("_leaf").distinct(), "lines-moving")
        moving = broadcast_if_small(leaves, "_leaf")
        with_field = templates.where(F.exists("_places", lambda p: p["_known"] == FIELD)).select(*TEMPLATE)
        fields = written(with_field.join(moving, "_leaf", "left_anti"), "lines-fields")
        done.append(of_variant.join(broadcast_if_small(fields, "_leaf"), list(TEMPLATE)))
        if leaves.isEmpty():
            break
        # What is named anew keeps its variants; templates that meet become one.
        names = broadcast_if_small(moved.drop("_tokens", "_places"), "_leaf")
        of_variant = written(
            of_variant.join(moving, "_leaf", "left_semi").join(names, list(TEMPLATE), "left").select(
                *VARIANT, *[F.coalesce(f"_new{i}", f"_template{i}").alias(f"_template{i}") for i in (1, 2)]
            ),
            "lines-general",
        )
        renamed = moved.select("_leaf", F.col("_new1").alias("_template1"), F.col("_new2").alias("_template2"), "_tokens", "_places")
        templates = (
            templates.join(moving, "_leaf", "left_semi")
            .join(names.select(*TEMPLATE), list(TEMPLATE), "left_anti")
            .unionByName(renamed)
            .groupBy(*TEMPLATE, "_tokens")
            .agg(F.first("_places").alias("_places"))
        )
    return reduce(DataFrame.unionByName, done).select(*VARIANT, "_template1", "_template2")


def merged(templates: DataFrame) -> DataFrame:
    """Templates that get a further field, with their new name and places."""
    one, two = _hashes("_place", F.col("_known"))
    places = templates.select(*TEMPLATE, "_tokens", F.explode("_places").alias("_p")).select(*TEMPLATE, "_tokens", "_p.*")
    # All other places of a template, as the name without this place.
    others = places.withColumn("_rest1", F.col("_template1").bitwiseXOR(one)).withColumn(
        "_rest2", F.col("_template2").bitwiseXOR(two)
    )
    rest = ["_leaf", "_place", "_rest1", "_rest2"]
    agreeing = (
        others.groupBy(*rest)
        .agg(F.count("*").alias("_values"), F.max(F.col("_known") == FIELD).alias("_field"))
        .where((F.col("_values") >= MIN_VALUES) | ((F.col("_values") > 1) & F.col("_field")))
        .select(*rest)
    )
    fields = (
        others.where(F.col("_known") != FIELD)
        .join(agreeing, rest, "left_semi")
        .groupBy(*TEMPLATE)
        .agg(F.collect_list("_place").alias("_opened"))
    )
    fields = written(fields, "lines-opened")
    opened = templates.join(broadcast_if_small(fields, "_leaf"), list(TEMPLATE)).withColumn(
        "_places",
        F.transform(
            "_places",
            lambda p: F.struct(
                p["_place"].alias("_place"),
                F.when(F.array_contains("_opened", p["_place"]), FIELD).otherwise(p["_known"]).alias("_known"),
            ),
        ),
    )
    fields_now = F.size(F.filter("_places", lambda p: p["_known"] == FIELD))
    named = opened.where(F.col("_tokens") - fields_now >= F.col("_tokens") * MIN_CONSTANT)
    one, two = (
        F.aggregate(
            F.transform("_places", lambda p: hash_of(p)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)
        )
        for hash_of in (
            lambda p: F.xxhash64(p["_place"], p["_known"]),
            lambda p: F.xxhash64(F.lit("template"), p["_place"], p["_known"]),
        )
    )
    return named.select(*TEMPLATE, "_tokens", "_places", one.alias("_new1"), two.alias("_new2"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys and line numbers of all lines that are dropped."""
    parsed = written(_parsed(docs, doc_id, text), "lines-parsed")
    lines = parsed.select(*KEYS, "_line", *VARIANT)
    # One row per document and variant, then counts by variant.
    by_document = parsed.select(*KEYS, *VARIANT, "_tokens").distinct()
    variants = written(
        by_document.groupBy(*VARIANT, "_tokens").agg(F.count("*").alias("_documents"), _owner()), "lines-variants"
    )
    enough = F.when(F.col("_tokens") < MIN_TOKENS, MIN_SHORT).otherwise(MIN_DOCUMENTS)
    exact = variants.where(F.col("_documents") >= enough).select(*VARIANT, "_owner")
    general = written(generalised(parsed, variants), "lines-general")
    template = list(TEMPLATE)
    recurring = (
        lines.select(*KEYS, *VARIANT)
        .join(broadcast_if_small(general, "_leaf"), list(VARIANT))
        .select(*template, *KEYS)
        .distinct()
        .groupBy(*template)
        .agg(F.count("*").alias("_documents"), _owner())
        .where(F.col("_documents") >= MIN_GENERALISED)
        .select(*template, "_owner")
    )
    by_template = general.join(recurring, template).select(*VARIANT, "_owner")
    owners = written(
        exact.select(*VARIANT, F.col("_owner").alias("_exact"), F.lit(None).cast(exact.schema["_owner"].dataType).alias("_general"))
        .union(
            by_template.select(
                *VARIANT, F.lit(None).cast(exact.schema["_owner"].dataType).alias("_exact"), F.col("_owner").alias("_general")
            )
        )
        .groupBy(*VARIANT)
        .agg(F.min("_exact").alias("_exact"), F.min("_general").alias("_general")),
        "lines-owners",
    )
    this = F.struct(*KEYS)
    # The template's owner decides where there is one: it keeps its line, and no other variant's owner does.
    return (
        lines.join(owners, list(VARIANT))
        .where(F.coalesce("_general", "_exact") != this)
        .select(*KEYS, "_line")
    )


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    Columns of ``docs`` with one of the two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Line numbers of a document as a bitmap, 64 to a word.
    words = (
        repeated_lines(docs, doc_id, text)
        .groupBy(*KEYS, F.floor(F.col("_line") / 64).cast("int").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _line % 64)")).alias("_bits"))
    )
    dropped = words.groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"), F.max("_word").alias("_last")
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.coalesce(F.element_at("_map", w), F.lit(0)))
    # Other columns as one: whatever they are called, none meets the names used here.
    others = F.struct(*[F.col(f"`{c}`") for c in kept if c != text] or [F.lit(None)])
    keyed = docs.select(others.alias("_row"), F.col(text).alias("_text"), *_keys(doc_id, text))
    joined = keyed.join(
        dropped.select(*[F.col(k).alias(f"_d{k}") for k in KEYS], dense.alias("_dense")),
        [F.col(k) == F.col(f"_d{k}") for k in KEYS],
        "left",
    )
    lines = F.split(F.col("_text"), "\n", -1)
    staying = F.filter(
        lines,
        lambda line, i: F.getbit(F.coalesce(F.get("_dense", F.shiftright(i, 6)), F.lit(0)), i.bitwiseAND(F.lit(63))) == 0,
    )
    cut = joined.withColumn("_staying", F.when(F.col("_dense").isNotNull(), staying))
    return cut.select(
        *[
            F.when(F.col("_staying").isNull(), F.col("_text")).otherwise(F.array_join("_staying", "\n")).alias(text)
            if c == text
            else F.col("_row").getField(c).alias(c)
            for c in kept
        ],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_staying").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_staying")).cast("long").alias("n_dropped"),
    )
