"""Benchmark overlaps against a plain search for every window, and what winnowing promises."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    out = []
    windows = []
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def result(docs, items):
    return sorted(
        (tuple(r) for r in decontamination.overlap_digests(decontamination.find_overlaps(docs, items)).collect()), key=repr
    )


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_words string")


def joined(rng, words):
    """Words with odd separators and letters in either case."""
    return "".join(w.upper() * (rng.random() < 0.3) or w for w in words) if len(words) == 1 else " ".join(
        (w.upper() if rng.random() < 0.3 else w) + rng.choice(["", ",", " ", "\t", "-"]) for w in words
    )


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_with_plain_search(spark, docs_of, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "cé", "É", "d1", "中文", "ß"][: rng.choice([2, 4, 7])]
    make = lambda n: rng.choices(vocabulary, k=n)
    bodies = [make(rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 30])) for _ in range(25)]
    items = [(rng.choice([i, 100 + i, 3, None]), joined(rng, b) if b else rng.choice([None, "", "..."])) for i, b in enumerate(bodies)]
    docs = []
    for i in range(120):
        w = make(rng.choice([0, 3, 9, 10, 12, 60]))
        for _ in range(rng.randint(0, 2)):
            body = rng.choice(bodies)
            cut = rng.randint(0, len(body))
            at = rng.randint(0, len(w))
            w[at:at] = body[cut : cut + rng.choice([4, 9, 10, 12, 40])]
        docs.append((i, joined(rng, w) if w else rng.choice([None, "", " "])))
    docs += [(1, docs[50][1]), (1, docs[50][1]), (None, docs[51][1]), (None, None)]
    got = result(docs_of(docs, extra="hits string"), items_of(spark, items))
    assert got == expected(docs, items)


def test_long_text_and_common_words(spark, docs_of):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(200)]
    text = []
    for _ in range(300):
        text += rng.choices(item, k=30) + item[(s := rng.randint(0, 180)) : s + rng.randint(8, 20)]
    rows = [(1, " ".join(text)), (2, "The the THE"), (3, "le les")]
    items = [(5, " ".join(item)), (6, "the"), (7, " ".join(item)), (8, "le les la")]
    assert result(docs_of(rows), items_of(spark, items)) == expected(rows, items)


def test_every_shared_span_has_a_common_fingerprint(spark):
    """Ten shared words are found whatever stands around them."""
    rng = random.Random(2)
    text = " ".join(rng.choices("abcdefgh", k=400))
    words = text.split()
    items = items_of(spark, [(i, " ".join(rng.choices("ijkl", k=7) + words[i : i + 10] + rng.choices("ijkl", k=7))) for i in range(390)])
    prints = decontamination.item_windows(items).select("item_id", "print").distinct()
    whole = decontamination.item_windows(items_of(spark, [(0, text)])).select("print").distinct()
    assert prints.join(whole, "print").select("item_id").distinct().count() == 390
    # Two of seven grams or so stay, not all.
    assert whole.count() < 0.5 * len(words)


def test_bitmap_that_is_full_loses_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_BITS", 64)
    monkeypatch.setattr(decontamination, "MAX_BITS", 64)
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("abcdef", k=15))) for i in range(40)]
    docs = [(i, " ".join(rng.choices("abcdef", k=20) + items[i][1].split()[2:14])) for i in range(40)]
    assert result(docs_of(docs), items_of(spark, items)) == expected(docs, items)


def test_empty_tables(spark, docs_of):
    docs, items = [(1, "a b c"), (2, None)], items_of(spark, [(1, "a b")])
    assert result(docs_of(docs).limit(0), items) == []
    assert result(docs_of(docs), items.limit(0)) == expected(docs, [])
    found = decontamination.find_overlaps(docs_of(docs), items).where(F.col("doc_id") == 1).first()
    assert [tuple(h) for h in found["hits"]] == [(0, 2)] and found["items"] == ["1"]
