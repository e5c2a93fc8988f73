"""Periodic runs of words by a sparse diagonal dynamic program.

Comparing a text with itself, a run with period ``q`` is a diagonal of lag
``q``: each word on it equals the word ``q`` before.  For every word the
program looks at earlier occurrences, lengthens the diagonals that go on and,
where one ends long enough, emits its run.

Only earlier occurrences that can matter are looked at.  Lags come in levels:
``1``, ``2``, ``3-4``, ``5-8`` and so on, up to ``W``.  On a level, a word
occurs together with the ``W - 1`` words before it, and only its nearest
earlier occurrence counts, if its lag is of the level.  Nothing is lost: in a
run of smallest period ``q <= W``, the same ``W`` words cannot come again
after less than ``q``, so from ``W + q`` words into the run on, the nearest
occurrence lies exactly ``q`` back, up to the last word.  Nothing is made up:
a diagonal of more than ``q`` such words covers ``3 * q`` words or more, and a
shorter period of them would have put an occurrence nearer.  Words whose
window does not occur twice are out of all further levels, so plain prose
costs a few passes and the whole takes ``n log n`` steps, for texts of one
repeated word too.

Texts stay where they are read; there is no shuffle, and a task holds one
slice of texts at a time.

Defined results: a NULL or blank text has no words, no run and an empty
collapsed text.  Repeated rows, equal and NULL ids each give a row of their
own.  Words are compared byte by byte.  Runs are sorted by start, then
period.  An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has at least this many words, and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Texts that are Python objects at one time.
TEXTS = 100

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal small numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def diagonals(ends: np.ndarray, lags: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of each diagonal of word positions that ends long enough."""
    order = np.argsort(ends)
    ends, lags = ends[order], lags[order]
    broken = np.flatnonzero((np.diff(ends) != 1) | (np.diff(lags) != 0))
    first, last = np.concatenate(([0], broken + 1)), np.concatenate((broken, [len(ends) - 1]))
    period = lags[first]
    start = ends[first] - period - window + 1
    length = ends[last] - start + 1
    for i in np.flatnonzero(length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)):
        yield int(start[i]), int(length[i]), int(period[i])


def periodic_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(numbers)
    runs: list[tuple[int, int, int]] = []
    if n < MIN_WORDS:
        return runs
    window, at, key = 1, np.arange(n), numbers
    while True:
        order = np.argsort(key, kind="stable")
        place, same = at[order], np.diff(key[order]) == 0
        lag = np.diff(place)
        hit = same & (lag <= window) & (2 * lag > window)
        if hit.any():
            runs.extend(diagonals(place[1:][hit], lag[hit], window))
        # Lags of the next level are longer than this window.
        if MIN_PERIODS * (window + 1) > n or not same.any():
            return sorted(runs, key=lambda run: (run[0], run[2]))
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        name = np.full(n, -1, np.int64)
        name[place[again]] = np.concatenate(([0], np.cumsum(~same)))[again]
        at = np.flatnonzero(name >= 0)
        at = at[at >= window]
        at = at[name[at - window] >= 0]
        if not len(at):
            return sorted(runs, key=lambda run: (run[0], run[2]))
        key = name[at - window] * n + name[at]
        window *= 2


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of every run only the first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    stays = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, stay in zip(words, stays) if stay])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: its runs, and its text with each run cut to one period."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            found, short = [], []
            for content in columns["text"]:
                words = content.encode("utf-8").split() if content else []
                runs = periodic_runs(numbered(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                short.append(collapsed(words, runs).decode("utf-8"))
            yield {"doc_id": columns["doc_id"], "runs": found, "collapsed": short}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
        run,
        f"doc_id {kind}, runs {RUNS}, collapsed string",
        TEXTS,
    )


def planted_loop(doc_id: str, text: str) -> Column:
    """The text, of which every tenth id goes round in a circle from some word on.

    ``h`` is the CRC of the id.  A NULL id leaves the text as it is.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(
            F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " "
        )

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    changed = let(words, lambda w: F.when(F.size(w) > 0, looped(w)))
    return F.when(h % 10 == 0, F.coalesce(changed, F.col(text))).otherwise(F.col(text))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )
    best = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-1000 * F.col("_best.less") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
