"""Mixing, url filter, line dedup and fingerprints against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import fingerprints, line_dedup, mixing, url_filter


def water_level(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[n] for n in free)
        above = [n for n in free if left * weight[n] / total > cap * sizes[n]]
        for n in above:
            target[n] = cap * sizes[n]
        if not above:
            return target | {n: left * weight[n] / total for n in free}
        left -= sum(target[n] for n in above)
        free -= set(above)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_fill_up_by_weight(spark, seed):
    rng = random.Random(seed)
    sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 10, 1000, 50_000]) for i in range(rng.randint(1, 12))}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    wanted = water_level(sizes)
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-6 * max(1, wanted[k]) for k in wanted)


def test_mix_repeats_rows_by_rate(spark, docs_of):
    rows = [(i, "a b c" * (i % 5), None, f"s{i % 3}" if i % 7 else None) for i in range(400)] + [(None, None, None, "s1")]
    docs = docs_of(rows)
    plan = {(r["doc_id"], r["source"]): r for r in mixing.mixing_plan(docs).collect()}
    assert len(plan) == 401 and all(0 <= r["copies"] <= 2 for r in plan.values())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    counted = Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert counted == Counter({k: r["copies"] for k, r in plan.items() if r["copies"]})
    for source in ("s0", "s1", "s2", None):
        own = [r for r in plan.values() if r["source"] == source]
        rate = own[0]["target"] / own[0]["source_size"]
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) / own[0]["target"] - 1) < 0.3
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixing_plan(docs.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark, docs_of):
    docs = docs_of([(i, "a b", None, "s") for i in range(20)], "_copy string").withColumn("_rate", F.lit(7)).withColumn("_copies", F.lit(8))
    mixed = mixing.mix_sources(docs).collect()
    assert mixed and {(r["_copy"], r["_rate"], r["_copies"]) for r in mixed} == {("own", 7, 8)}


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_urls_against_plain_rules(spark, rows):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.B.Example.NET/en/x?q=/y#z", "x://example.net/en",
        "http://example.com/de/", "http://notexample.com/de/", "http://www.example.com/fr/", "ftp://a.org/fr/1", "http://a.org?x=/fr/",
        "http://É.example.NET/", "http://a..net//", "http://net./", "http://a://b.net/", "http://.net/x", "http://net:80/",
    ] + [f"http://h{i % 50}.example.{('com', 'net', 'org')[i % 3]}/{('de', 'en', 'fr')[i % 4 % 3]}/{i}" for i in range(600)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = rows(url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict"))
    assert found == sorted(((i, *plain_verdict(u)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    bare = url_filter.judge_urls(pages, rules.limit(0)).select("verdict").distinct().collect()
    assert [r[0] for r in bare] == ["allow"]


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 4)  # many mistakes on the first levels
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    held = universe.where(cascade.member(F.col("key"), cascade.arrays())).collect()
    assert {r["key"] for r in held} == {f"k{i}" for i in range(300)}


def test_a_million_rules(spark):
    """The plan does not grow with the list, and every listed host is blocked."""
    import time

    rules = spark.range(1_000_000).select(
        F.concat(F.lit("h"), "id", F.lit(".example")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict")
    )
    pages = spark.range(0, 2_000_000, 997).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".example/x")).alias("url")
    )
    start = time.time()
    judged = url_filter.judge_urls(pages, rules)
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    found = {r["page_id"]: r["verdict"] for r in judged.collect()}
    assert found == {i: "block" if i < 1_000_000 else "allow" for i in range(0, 2_000_000, 997)}
    assert time.time() - start < 120


def plain_templates(variants):
    """Templates of the variants of one leaf, by variant."""
    count = Counter((p, t) for v in variants for p, t in enumerate(v))
    enough = lambda t: sum(x != "<*>" for x in t) >= line_dedup.MIN_CONSTANT * len(t)
    found = {v: tuple(t if count[p, t] > 1 else "<*>" for p, t in enumerate(v)) for v in variants}
    found = {v: t for v, t in found.items() if enough(t)}
    while True:
        templates = set(found.values())
        agree = defaultdict(set)
        for t in templates:
            for p, token in enumerate(t):
                agree[p, t[:p], t[p + 1 :]].add(token)
        new = {}
        for t in templates:
            opened = []
            for p, token in enumerate(t):
                values = agree[p, t[:p], t[p + 1 :]]
                opened.append("<*>" if len(values) >= line_dedup.MIN_VALUES or (len(values) > 1 and "<*>" in values) else token)
            if tuple(opened) != t and enough(opened):
                new[t] = tuple(opened)
        if not new:
            return {v: t for v, t in found.items() if "<*>" in t}
        found = {v: new.get(t, t) for v, t in found.items()}


def plain_line_dedup(docs):
    """The same rules over plain lists; documents are (id, text) pairs."""
    lines = defaultdict(set)
    for doc in docs:
        for i, raw in enumerate((doc[1] or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", raw) if t)
            if tokens:
                lines[tokens].add((doc, i))
    leaves = defaultdict(list)
    for tokens in lines:
        if len(tokens) >= line_dedup.MIN_TOKENS:
            leaves[len(tokens), tokens[: line_dedup.DEPTH]].append(tokens)
    templates = {}
    for variants in leaves.values():
        if len(variants) > 1:
            templates |= plain_templates(variants)
    having = defaultdict(set)
    for v, fixed in templates.items():
        having[fixed] |= {d for d, _ in lines[v]}
    dropped = defaultdict(set)
    for v, places in lines.items():
        documents = {d for d, _ in places}
        general = having.get(templates.get(v), set())
        group = general if len(general) >= line_dedup.MIN_GENERALISED else documents
        if len(group) >= (line_dedup.MIN_DOCUMENTS if len(v) >= line_dedup.MIN_TOKENS else line_dedup.MIN_SHORT):
            for d, i in places:
                if d != min(group, key=lambda d: (d[0] is None, d[0] or 0)):
                    dropped[d].add(i)
    return [
        (d[0], None if d[1] is None else "\n".join(r for i, r in enumerate(d[1].split("\n")) if i not in dropped[d])) for d in docs
    ]


@pytest.mark.parametrize("templates", [4, 6, 50])
def test_templates_recur_whatever_their_leaf_holds(spark, docs_of, templates):
    """One leaf; a field whose values differ, or come again in other lines."""
    made = [
        (100 * t + k, f"the user of service{chr(97 + t % 26)}{chr(97 + t // 26)} named {name} has logged in again today")
        for t in range(templates)
        for k, name in enumerate(["".join(chr(97 + int(d)) for d in str(100 * t + k)) if k % 2 else "x" + chr(97 + k % 26) for k in range(100)])
    ]
    found = line_dedup.drop_repeated_lines(docs_of(made))
    assert sorted(tuple(r) for r in found.select("doc_id", "text").collect()) == sorted(plain_line_dedup(made))
    assert found.where("n_dropped > 0").count() >= 99 * templates


def test_leaves_in_which_nothing_moves_are_looked_at_once(spark, docs_of, monkeypatch):
    moving = [f"a b c {x} d e f {y} g h i j" for x in "xyz" for y in "mno"]
    still = [f"p q r once{'abcdef'[i]} s t u v" for i in range(6)]
    made = list(enumerate(moving + still))
    looked_at = []

    def merged(templates, of=line_dedup.merged):
        looked_at.append(templates.select("_tokens").distinct().collect())
        return of(templates)

    monkeypatch.setattr(line_dedup, "merged", merged)
    found = line_dedup.drop_repeated_lines(docs_of(made)).select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_line_dedup(made))
    assert [sorted(r[0] for r in tokens) for tokens in looked_at] == [[8, 12], [12]]


def test_short_lines_recur_from_ten_documents_on(spark, docs_of):
    made = [(i, f"All rights reserved.\nWords of document {chr(97 + i)} alone" + ("\nYes." if i < 9 else "")) for i in range(12)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs_of(made)).collect()}
    assert [i for i in left if "reserved" in left[i]] == [0]
    assert [i for i in sorted(left) if "Yes." in left[i]] == list(range(9))


def test_columns_of_any_name_pass_through(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)], "_hash string").withColumns({c: F.lit(7) for c in ("_dense", "_staying", "_row", "_text", "_id")})
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {(r["_hash"], r["_dense"], r["_text"]) for r in found.collect()} == {("own", 7, 7)}


def test_lines_against_plain_rules(spark, docs_of, rows):
    rng = random.Random(5)
    boiler = "all rights reserved by the owner of this site"
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    made = [
        (i, "\n".join([boiler, f"user u{i} logged in from host h{i} today", f"request by {chr(97 + i % 26)}x ended with no error at all"]
                      + rng.sample(pool, 4) + [boiler]))
        for i in range(60)
    ]
    made += [
        (200 + i, f"a b c {rng.choice('xyz')} {rng.choice('uvw')} d e {rng.choice('mno')} f g h i\n\t a  b\tc {rng.choice('pqr')} d e f g")
        for i in range(40)
    ]
    made += [(100, None), (101, ""), (102, "\n\n"), (103, "word " * 5000), (104, made[3][1]), (None, boiler + "\nunique tail of a text here now")]
    docs = docs_of(made, "n_lines string")
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert rows(found.select("doc_id", "text")) == sorted(plain_line_dedup(made), key=repr)
    assert sum(r["n_dropped"] for r in found.collect()) > 180
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    # Rows that agree in id and text are one document: they keep their lines.
    twice = docs_of([(1, boiler), (1, boiler)], "n_lines string")
    assert rows(line_dedup.drop_repeated_lines(twice).select("doc_id", "text")) == [(1, boiler)] * 2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def test_fingerprints_estimate_likeness(spark, docs_of):
    import hashlib

    rng = random.Random(2)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([0, 1, 3, 5, 20, 300, 900]))]
        texts[i] = " ".join(words) if i % 9 else (None if i % 2 else "Ünï côde “text” " * 20)
    for i in range(60, 80):
        words = (texts[i - 60] or "x y z").split()
        words[:: 40] = ["edit"] * len(words[:: 40])
        texts[i] = " ".join(words)
    texts[80] = texts[5]
    found = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs_of(list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for mark, other in ((row["near_edited"], edited), (row["near_next"], after)):
            if shingles(text) and shingles(other):
                errors.append(mark - jaccard(text, other))
            else:
                assert mark == float(not shingles(text) and not shingles(other))
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.02
    assert found[80]["fingerprint"] == found[5]["fingerprint"]
    assert len({len(r["fingerprint"]) for r in found.values()} - {0}) == 1


def test_fingerprints_of_odd_rows(spark, docs_of):
    assert fingerprints.edited_likeness(docs_of([])).count() == 0
    single = fingerprints.edited_likeness(docs_of([(7, "one two three")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in single] == [(7, 1.0)]
    rows = fingerprints.edited_likeness(docs_of([(None, "a b"), (None, None), (1, "x"), (1, "x"), (1, "y")])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None", "None"]
