"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full sets.

* One pass turns each text into its shingle set, MinHash samples, band keys,
  and odd sketches: bitmaps in which hashes flip one bit each.  In the whole
  sketch of a set of moderate size every hash does: two never differ in more
  bits than their sets in hashes, so no link is turned away.  For larger sets
  each bin's smallest hash does, and the bits that differ estimate the
  similarity, most precisely when it is high.
* Rows with equal sets form a class; classes go on, so exact copies cost one row.
* In each band bucket every class is paired with the smallest one.  A pair is
  looked at when set sizes and sketches allow the threshold, and linked when
  the full sets, made anew from the texts, reach it.
* Then follow rounds for what the star left out: in buckets that still hold
  several components, classes outside the bucket's largest component are set
  against the other components' members, the likeliest first, until no allowed
  pair between different components is left.  Each round looks deeper, and no
  pair is tested twice.  Large buckets
  are dealt out in chunks.

Links of the threshold or more share a band with a probability that
``miss_probability`` gives (about 3e-7 missed at the threshold itself).

Defined results: a text without words has no shingle, is linked with nothing
and stays.  Rows with the id of the row that stays stay with it.  NULL ids
count only where a group has no other; its id is then NULL and all its rows
stay.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import is_small
from ..session import cut_lineage
from .common import map_batches, mix64, written
from .shingles import _table, common_count, shingle_set

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
#: Up to this size of the smaller set, a pair is judged by whole sketches, which turn no link away.
WHOLE = 1024
#: Samples folded into a sketch come from one permutation: the smallest hash of each bin.
SKETCH_BINS = 1024
SKETCH_BITS = 2048
#: Pairs whose sketches estimate so many standard deviations below the threshold are not looked at.
DEVIATIONS = 5.0
#: Variance of the estimate: by folding at most this, by sampling for a set of one hash per bin.
FOLDING, SAMPLING = 1e-4, 0.1875 / SKETCH_BINS
#: Pairs per class and bucket that the first round looks at, and how many times
#: deeper each further one looks.
DEPTH, DEEPER = 2, 32
#: Classes of a bucket that one task gets beside those set against them.
CHUNK = 1024

_FACTORS = (_table(SAMPLES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = (_table(SAMPLES, 12) >> np.uint64(32)).astype(np.uint32)
_SALTS = _table(SAMPLES, 13)


def miss_probability(similarity: float) -> float:
    """Chance that a pair of this similarity shares no band."""
    return (1.0 - similarity**ROWS) ** BANDS


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The samples of a set, in blocks of bounded size."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for start in range(0, len(x), 4096):
            block = (x[start : start + 4096, None] ^ _MASKS) * _FACTORS
            np.minimum(best, block.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    with np.errstate(over="ignore"):
        mixed = mix64(samples.astype(np.uint64) + _SALTS)
        return mix64(mixed.reshape(BANDS, ROWS).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Bitmap, as 64-bit words, in which every hash flips one bit."""
    with np.errstate(over="ignore"):
        at = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Parity bitmap of the bins' smallest hashes, as 64-bit words, and the number of bins in use.

    ``hashes`` come sorted, so the first of each bin is its smallest.
    """
    bins = hashes >> np.uint64(64 - SKETCH_BINS.bit_length() + 1)
    first = hashes[np.concatenate(([True], bins[1:] != bins[:-1]))] if len(hashes) else hashes
    return _parities(first), len(first)


def sketches_of(hashes: np.ndarray) -> tuple[list[int], list[int], int]:
    """Whole sketch, sketch of the bins' smallest, and bins in use, as far as pairs of allowed sizes need them."""
    whole = 0 < len(hashes) * PERCENT <= WHOLE * 100
    if len(hashes) <= WHOLE:
        return _parities(hashes).tolist() if whole else [], [], 0
    bits, bins = odd_sketch(hashes)
    return _parities(hashes).tolist() if whole else [], bits.tolist(), bins


def whole_allows(differing: np.ndarray, size: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets that differ in at least so many hashes can be linked; never false for a link."""
    return differing * (100 + PERCENT) <= (size + others) * (100 - PERCENT)


def likeness(differing: np.ndarray, used: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The similarity that differing bits of two sketches estimate, given the bins in use.

    The bits give the size of the symmetric difference of the samples; where
    both sets use a bin and differ, that bin counts twice in it.
    """
    gone = -SKETCH_BITS / 2.0 * np.log(np.maximum(1e-9, 1.0 - 2.0 * np.asarray(differing) / SKETCH_BITS))
    same = np.maximum(0.0, (used + others - gone) / 2.0)
    both_use = np.minimum(used, others) / SKETCH_BINS
    return same / np.maximum(1e-9, same + gone * (1.0 - both_use / 2.0))


def least_likeness(used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a sketch must estimate; a set that has a bin for nearly every hash is hardly sampled."""
    return PERCENT / 100.0 - DEVIATIONS * np.sqrt(FOLDING + SAMPLING * (1.0 - used / size))


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_text1"), F.xxhash64(F.lit("text"), text).alias("_text2")]


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, set_key, n_shingles, bands, whole, sketch, bins`` and two hashes of the text, by row."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content.alias("_text"), *_text_keys(content))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            keys, sizes, bands, wholes, sketches, used = [], [], [], [], [], []
            for content in columns["_text"]:
                hashes = shingle_set(content)
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                samples = minhash(hashes)
                bands.append(band_keys(samples).tolist() if len(hashes) else [])
                for column, value in zip((wholes, sketches, used), sketches_of(hashes)):
                    column.append(value)
            kept = {c: columns[c] for c in ("doc_id", "_text1", "_text2")}
            yield {
                **kept, "set_key": keys, "n_shingles": sizes, "bands": bands, "whole": wholes, "sketch": sketches, "bins": used
            }

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(
        rows,
        run,
        f"doc_id {kind}, _text1 long, _text2 long, set_key binary, n_shingles long, bands array<long>, "
        "whole array<long>, sketch array<long>, bins long",
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for all other nodes.

    Alternates large-star and small-star steps until every component is a
    star; every step is a minimum by node and a join back, so no
    neighbourhood is gathered.
    """

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        edges = cut_lineage(edges)
        # Stars: a node has one edge down, and what it leads to has none.
        below = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        astray = below.join(edges.select(F.col("u").alias("v"), F.lit(True).alias("goes_on")), "v", "left")
        if astray.where((F.col("n") > 1) | F.col("goes_on")).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        around = both_ways(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def linked_up(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links``: only the components that these join are worked on."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("_a"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
    between = (
        links.join(left, "a", "left")
        .join(right, "b", "left")
        .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        .where("a <> b")
    )
    joined = components(between)
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return cut_lineage(
        roots.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root")).union(joined)
    )


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold.

    Only the texts of these classes are read again and moved.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = cut_lineage(classes.select("cid", "_text1", "_text2").join(nodes, "cid"))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(content.alias("_text"), *_text_keys(content))
    found = rows.join(F.broadcast(wanted) if is_small(wanted, "cid") else wanted, ["_text1", "_text2"])
    texts = written(found.groupBy("cid").agg(F.first("_text").alias("_text")), "near-texts")
    sides = (
        pairs.join(texts.select(F.col("cid").alias("a"), F.col("_text").alias("_left")), "a")
        .join(texts.select(F.col("cid").alias("b"), F.col("_text").alias("_right")), "b")
        .select("a", "b", "_left", "_right")
    )

    def check(batches: Iterator[dict]) -> Iterator[dict]:
        last: dict[str, tuple] = {}

        def made(side: str, content: str) -> np.ndarray:
            if side not in last or last[side][0] != content:
                last[side] = (content, shingle_set(content))
            return last[side][1]

        for columns in batches:
            left, right = [], []
            for a, b, x, y in zip(columns["a"], columns["b"], columns["_left"], columns["_right"]):
                one, two = made("a", x), made("b", y)
                both = common_count(one, two)
                if both and 100 * both >= PERCENT * (len(one) + len(two) - both):
                    left.append(a)
                    right.append(b)
            if left:
                yield {"a": left, "b": right}

    return written(map_batches(sides, check, "a long, b long"), "near-links")


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n
    )


def _by_whole() -> Column:
    return F.least("_n", "_m") <= WHOLE


def _likely() -> Column:
    """``whole_allows``, or else ``likeness`` of ``_far`` bits with ``_p`` and ``_q`` bins in use against ``least_likeness``."""
    gone = F.log(F.greatest(F.lit(1e-9), 1.0 - 2.0 * F.col("_far") / SKETCH_BITS)) * (-SKETCH_BITS / 2.0)
    same = F.greatest(F.lit(0.0), (F.col("_p") + F.col("_q") - gone) / 2.0)
    spread = F.sqrt(FOLDING + SAMPLING * (1.0 - F.least("_p", "_q") / F.greatest("_n", "_m")))
    least = PERCENT / 100.0 - DEVIATIONS * spread
    estimated = same >= least * (same + gone * (1.0 - F.least("_p", "_q") / (2.0 * SKETCH_BINS)))
    allowed = F.col("_far") * (100 + PERCENT) <= (F.col("_n") + F.col("_m")) * (100 - PERCENT)
    return F.when(_by_whole(), allowed).otherwise(estimated)


def star_pairs(members: DataFrame, hubs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every class of a bucket with the bucket's smallest, when sizes and sketches allow a link."""
    edges = (
        members.join(hubs, "band").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    )
    columns = ("cid", "n_shingles", "whole", "sketch", "bins")
    left = facts.select(*[F.col(c).alias(n) for c, n in zip(columns, ("a", "_n", "_v", "_s", "_p"))])
    right = facts.select(*[F.col(c).alias(n) for c, n in zip(columns, ("b", "_m", "_w", "_t", "_q"))])
    one, two = F.when(_by_whole(), F.col("_v")).otherwise(F.col("_s")), F.when(_by_whole(), F.col("_w")).otherwise(F.col("_t"))
    return (
        edges.join(left, "a")
        .join(right, "b")
        .where(F.least("_n", "_m") * 100 >= F.greatest("_n", "_m") * PERCENT)
        .select("a", "b", "_n", "_m", "_p", "_q", _differing(one, two).alias("_far"))
        .where(_likely())
        .select("a", "b")
    )


def crossing_pairs(members: DataFrame, facts: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Allowed pairs between components that share a bucket: ``a, b, more``.

    For a class outside the bucket's largest component, its ``depth`` likeliest
    pairs with other components; ``more`` tells that it has others.
    """
    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "cid", F.coalesce("root", "cid").alias("comp")
    )
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("_n"))
    open_buckets = (
        sizes.groupBy("band")
        .agg(F.sum("_n").alias("_all"), F.count("*").alias("_comps"), F.max(F.struct("_n", "comp")).alias("_top"))
        .where("_comps > 1")
        .select("band", F.ceil(F.col("_all") / CHUNK).cast("int").alias("_chunks"), F.col("_top.comp").alias("_main"))
    )
    outside = F.col("comp") != F.col("_main")
    dealt = (
        placed.join(open_buckets, "band")
        .withColumn(
            "_chunk",
            F.explode(
                F.when(outside, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(
                    F.array(F.pmod(F.xxhash64("cid"), F.col("_chunks")).cast("int"))
                )
            ),
        )
        .select("band", "_chunk", "cid", "comp", outside.alias("outside"))
        .join(facts, "cid")
        .repartition("band", "_chunk")
        .sortWithinPartitions("band", "_chunk")
    )

    def bucket_pairs(rows: list[tuple]) -> Iterator[tuple[int, int, bool]]:
        first = rows[0][1] == 0
        cid = np.array([r[2] for r in rows])
        comp = np.array([r[3] for r in rows])
        loose = np.array([r[4] for r in rows])
        size = np.array([r[5] for r in rows])
        none = [0] * (SKETCH_BITS // 64)
        whole, bits = (np.array([r[c] or none for r in rows], np.int64).view(np.uint64) for c in (6, 7))
        used = np.array([r[8] for r in rows])
        for i in np.flatnonzero(loose):
            others = comp != comp[i]
            if not first:
                others &= ~loose  # pairs of two outside classes are looked at in the first chunk
            else:
                others &= ~loose | (cid > cid[i])
            at = np.flatnonzero(others)
            at = at[np.minimum(size[at], size[i]) * 100 >= np.maximum(size[at], size[i]) * PERCENT]
            by_whole = np.minimum(size[at], size[i]) <= WHOLE
            kept = []
            for at, sketches in ((at[by_whole], whole), (at[~by_whole], bits)):
                if not len(at):
                    continue
                far = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
                if sketches is whole:
                    near = (size[at] + size[i] - far) / (size[at] + size[i] + far)
                    keep = whole_allows(far, size[at], size[i])
                else:
                    near = likeness(far, used[at], used[i])
                    keep = near >= least_likeness(np.minimum(used[at], used[i]), np.maximum(size[at], size[i]))
                kept.append((at[keep], near[keep]))
            if not kept:
                continue
            at, near = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((cid[at], -near))
            for j in at[order[:depth]]:
                yield int(min(cid[i], cid[j])), int(max(cid[i], cid[j])), len(at) > depth

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows: list[tuple] = []
        for columns in batches:
            out: list[tuple] = []
            for row in zip(*(columns[c] for c in ("band", "_chunk", "cid", "comp", "outside", "n_shingles", "whole", "sketch", "bins"))):
                if rows and rows[0][:2] != row[:2]:
                    out += bucket_pairs(rows)
                    rows = []
                rows.append(row)
            if out:
                yield dict(zip(("a", "b", "more"), zip(*out)))
        out = list(bucket_pairs(rows)) if rows else []
        if out:
            yield dict(zip(("a", "b", "more"), zip(*out)))

    found = map_batches(dealt, run, "a long, b long, more boolean")
    return written(found.groupBy("a", "b").agg(F.max("more").alias("more")), "near-crossing")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    rows = written(sketch(docs, doc_id, text), "near-sketches")
    classes = written(
        rows.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("min_id"),
            *[F.first(c).alias(c) for c in ("n_shingles", "bands", "whole", "sketch", "bins")],
            F.min(F.struct("_text1", "_text2")).alias("_text"),
        )
        .select(
            "set_key", "min_id", "n_shingles", "bands", "whole", "sketch", "bins", "_text._text1", "_text._text2",
            F.monotonically_increasing_id().alias("cid"),
        ),
        "near-classes",
    )
    facts = classes.select("cid", "n_shingles", "whole", "sketch", "bins")
    banded = classes.select(F.explode("bands").alias("band"), "cid")
    hubs = (
        banded.groupBy("band")
        .agg(F.min("cid").alias("hub"), F.max("cid").alias("_top"))
        .where("hub < _top")
        .select("band", "hub")
    )
    # Buckets of several classes only; most classes are alone in all of theirs.
    crowded = written(banded.join(hubs, "band"), "near-buckets")
    members = crowded.select("band", "cid")
    stars = cut_lineage(star_pairs(members, crowded.select("band", "hub").distinct(), facts))
    links = confirm(stars, classes, docs, text)
    roots = components(links)
    tested, depth, deeper = stars, DEPTH, True
    while deeper:
        crossing = crossing_pairs(members, facts, roots, depth)
        deeper = crossing.agg(F.max("more")).first()[0]
        fresh = cut_lineage(crossing.select("a", "b").join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            tested = tested.union(fresh)
            roots = linked_up(roots, confirm(fresh, classes, docs, text))
        # Once no pair lay deeper, all were tested: joining components only takes pairs away.
        depth *= DEEPER
    resolved = classes.select("set_key", "cid", "min_id").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    smallest = resolved.groupBy("root").agg(F.min("min_id").alias("component_id"))
    groups = resolved.join(smallest, "root").select("set_key", "component_id")
    return (
        rows.select("doc_id", "n_shingles", "set_key")
        .join(groups, "set_key", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
