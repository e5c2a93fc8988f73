"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from broadsheet.llm import periodic_runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch of every lag; of equal stretches the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i > first and i - first + q >= max(6, 4 * q):
                found.setdefault((first - q, i - first + q), q)
            i += i == first
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(2_000):
        n = rng.randint(0, 70)
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = 9
        assert periodic_runs.periodic_runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize(
    "text", ["a" * 400, fibonacci(700), "ab" * 200 + "c" + "ab" * 200, ("a" * 7 + "b") * 50, (fibonacci(21) * 9 + "c") * 5]
)
def test_runs_of_periodic_texts(text):
    words = [ord(c) for c in text]
    assert periodic_runs.periodic_runs(np.array(words)) == plain_runs(words)


def test_long_periodic_text_takes_no_square_time():
    start = time.time()
    assert periodic_runs.periodic_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert time.time() - start < 20


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = looped(doc_id, SPACE.findall(text or ""))
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha(lines), sha(kept))


def test_digests_of_odd_rows(spark, docs_of):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a a", "a\ta\na a  a a　a", "é É é É é É é É é", "x " * 5_000]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 90))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, "a b a b a b a b"), (5, "a b a b a b a b"), (None, "c c c c c c c"), (10**15, "b c d " * 9)]
    docs = docs_of(rows, extra="runs string")
    changed = docs.withColumn("text", periodic_runs.planted_loop("doc_id", "text"))
    digests = periodic_runs.run_digests(periodic_runs.find_runs(changed))
    got = sorted((tuple(r) for r in digests.collect()), key=repr)
    assert got == sorted((expected(*r[:2]) for r in rows), key=repr)
    empty = periodic_runs.run_digests(periodic_runs.find_runs(docs.limit(0)))
    assert empty.count() == 0 and empty.columns == digests.columns


def test_operator_returns_runs_and_text(spark, docs_of):
    found = periodic_runs.find_runs(docs_of([(1, "x a b a b a b a b y")])).first()
    assert [tuple(r) for r in found["runs"]] == [(1, 8, 2)] and found["collapsed"] == "x a b y"
    assert docs_of([(1, "a")]).select(periodic_runs.planted_loop("doc_id", "text")).count() == 1
