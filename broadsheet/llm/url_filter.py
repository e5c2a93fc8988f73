"""Url filter by a cascade of Bloom filters, in DataFrame functions only.

A rule is a host and a path start.  The keys a url can match are its host
suffixes joined with those starts of its path that have the length of some
rule's path.  The cascade answers membership of such a key exactly for every
key of the corpus it was built over: level 0 holds the listed keys, level 1
the keys of the corpus that level 0 lets through by mistake, level 2 the
listed keys that level 1 holds by mistake, and so on until no mistake is
left.  A url is then judged by bit tests inside the scan, without a join.

Defined results: a NULL url, or one without ``://``, has an empty host and
path and meets no rule.  Repeated urls and repeated rules change nothing; a
key listed under both verdicts is allowed.  An empty table gives no rows; an
empty list leaves every url at the default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import let

#: Bits for each key of a level, and probes for each key.
BITS_PER_KEY = 12
PROBES = 6
#: A cascade larger than this, about eleven million keys, is refused: its
#: bitmaps travel with the tasks, each as one value.
MAX_CASCADE_BYTES = 16 * 1024 * 1024
#: More levels than this mean that hashes do not separate the keys.
MAX_LEVELS = 40
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, addressed by seeded hashes."""

    seed: int
    bits: int
    #: ``word, set``, written: the words that are not zero.
    words: DataFrame

    def array(self) -> Column:
        """All words as one array, by a subquery."""
        dense = self.words.sparkSession.range(self.bits // 64).join(self.words, F.col("id") == F.col("word"), "left")
        ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0)).alias("set"))))
        return dense.agg(ordered["set"].alias("words")).scalar()

    def holds(self, key: Column, words: Column) -> Column:
        tests = None
        for probe in range(PROBES):
            at = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(probe), key), F.lit(self.bits))
            test = F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
            tests = test if tests is None else tests & test
        return tests


@dataclass(frozen=True)
class Cascade:
    """Alternating levels; exact for the keys it was built over."""

    levels: tuple[Level, ...]

    def arrays(self) -> Column:
        """The words of all levels, to be selected as one column and used once."""
        return F.struct(F.lit(0).alias("_"), *[level.array().alias(f"w{i}") for i, level in enumerate(self.levels)])

    def member(self, key: Column, arrays: Column) -> Column:
        """Whether ``key`` is listed: decided by the first level that lacks it."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[i].holds(key, arrays[f"w{i}"]), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict

    @property
    def bytes(self) -> int:
        return sum(level.bits // 8 for level in self.levels)


def _level(keys: DataFrame, seed: int) -> Level | None:
    """A filter over the distinct ``key`` column; None when it is empty."""
    count = keys.count()
    if count == 0:
        return None
    bits = -(-max(count * BITS_PER_KEY, 64) // 64) * 64
    if bits // 8 > MAX_CASCADE_BYTES:
        raise ValueError(f"{count} keys need {bits // 8} bytes, more than {MAX_CASCADE_BYTES}")
    positions = keys.select(
        F.explode(
            F.array(
                *[F.pmod(F.xxhash64(F.lit(seed), F.lit(probe), F.col("key")), F.lit(bits)) for probe in range(PROBES)]
            )
        ).alias("at")
    )
    words = positions.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")
    )
    return Level(seed, bits, cut_lineage(words))


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    """The cascade of ``listed`` keys over all ``universe`` keys (column ``key``).

    Only the false positives of a level are set against the listed keys, by
    an anti-join while building; the universe itself is never joined.
    """
    inside = listed.select("key").where(F.col("key").isNotNull()).distinct()
    outside = universe.select("key").where(F.col("key").isNotNull()).distinct()
    levels: list[Level] = []
    holders, others = inside, outside
    while len(levels) < MAX_LEVELS:
        level = _level(holders, seed + len(levels))
        if level is None:
            return Cascade(tuple(levels))
        levels.append(level)
        mistaken = others.where(level.holds(F.col("key"), level.array()))
        if len(levels) == 1:
            mistaken = mistaken.join(inside, "key", "left_anti")
        # A few of many keys; kept, so that no later level repeats the scan.
        holders, others = mistaken.checkpoint(), holders
        size = Cascade(tuple(levels)).bytes
        if size > MAX_CASCADE_BYTES:
            raise ValueError(f"the cascade takes {size} bytes, more than {MAX_CASCADE_BYTES}")
    raise ValueError("the cascade does not end")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    has_scheme = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has_scheme, lowered).otherwise(""), F.when(has_scheme, path).otherwise("")


def url_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """The keys a url can match, longest first, then longest host first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.when(
        host == "", F.array().cast("array<string>")
    ).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths])
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda suffix: F.transform(
                F.filter(starts, lambda start: start.isNotNull()),
                lambda start: F.struct(
                    (-(F.length(suffix) + F.length(start))).alias("size"),
                    (-F.length(suffix)).alias("host_size"),
                    F.concat(suffix, start).alias("key"),
                ),
            ),
        )
    )
    return F.transform(F.sort_array(pairs), lambda pair: pair["key"])


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    The longest fitting rule decides, of equally long ones that of the longer
    host.  Columns of ``pages`` with one of the new names are replaced.
    """
    listed = rules.select(
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_length"),
        "verdict",
    )
    lengths = sorted(row[0] for row in listed.select("path_length").distinct().collect())  # lengths, not rules
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not lengths:
        return pages.select(
            *kept, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    keys = url_keys(F.col("host"), F.col("path"), lengths)
    universe = parts.select(F.explode(keys).alias("key")).distinct()
    allowed = build_cascade(listed.where(F.col("verdict") == "allow"), universe, seed=1)
    blocked = build_cascade(listed.where(F.col("verdict") == "block"), universe, seed=1_000_001)

    # A subquery may not stand inside the expression that uses it; the optimizer
    # puts it there, so that the words are not copied into the rows.
    def first_fit(words: Column) -> Column:
        judged = F.transform(
            keys,
            lambda key: F.struct(
                key.alias("key"),
                allowed.member(key, words["allowed"]).alias("allow"),
                blocked.member(key, words["blocked"]).alias("block"),
            ),
        )
        return F.get(F.filter(judged, lambda j: j["allow"] | j["block"]), 0)

    words = F.struct(allowed.arrays().alias("allowed"), blocked.arrays().alias("blocked"))
    found = parts.withColumn("_words", words).select(
        *parts.columns, let(F.col("_words"), first_fit).alias("_fit")
    )
    return found.select(
        *kept,
        "host",
        "path",
        F.col("_fit.key").alias("rule"),
        F.when(F.col("_fit").isNull(), F.lit(default)).when(F.col("_fit.allow"), "allow").otherwise("block").alias("verdict"),
    )
