"""Language, extraction, scoring, duplicates and packing against plain Python."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, hmm_score, html_extraction, language, near_dedup, packing
from broadsheet.llm.common import document_remainder, lower_words
from broadsheet.llm.queries import tokenizer_files

# -- language ----------------------------------------------------------------

SOUNDS = {
    "en": "the of and ing tion to is that with er on".split(),
    "de": "der die und sch ung zu ich heit über nicht für".split(),
    "fr": "le la des eau est ment que un dans oui été".split(),
    "es": "el los para ción que año del una con por señ".split(),
    "xx": "zqa kwy vvu xoq".split(),
}


def invented(lang, rng, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def language_rows(langs, n=300):
    rng = random.Random(1)
    return [(i, invented(langs[i % len(langs)], rng, rng.randint(5, 80)), langs[i % len(langs)]) for i in range(n)]


def test_languages_are_told_apart(spark, docs_of):
    rows = language_rows(list(SOUNDS))
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 34 !?", "de"), (903, "the of " * 60_000, None), (None, invented("es", random.Random(2), 40), "es")]
    docs = docs_of(rows + odd, "score string")
    langs, model = language.train(docs, document_remainder("doc_id", 3) != 1)
    assert langs == sorted(SOUNDS)
    kinds = Counter(kind for kind, _, _ in model)
    assert kinds == {"family": 3, "language": 2}
    judged = language.predict(docs, langs, model)
    found = {r["doc_id"]: r for r in judged.collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(found[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert found[903]["lang_pred"] == "en" and found[None]["lang_pred"] == "es"
    assert all(0.0 <= r["score"] <= 1.0 for r in found.values())
    kept = language.keep_identified(docs, document_remainder("doc_id", 3) != 1)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} | {903, None}


def test_languages_of_small_tables(spark, docs_of):
    always = F.lit(True)
    for rows, wanted in (([(1, "some text", "en"), (2, "1", "en")], {1: "en", 2: "und"}), ([(1, "some text", None)], {1: "und"}), ([], {})):
        docs = docs_of(rows)
        langs, model = language.train(docs, always)
        assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, langs, model).collect()} == wanted


def test_long_texts_are_read_whole():
    text = "abc" * 200_000
    whole = language.ngram_vector(text)
    language_piece, language.PIECE_CHARS = language.PIECE_CHARS, 1 << 22
    try:
        assert np.allclose(whole, language.ngram_vector(text))
    finally:
        language.PIECE_CHARS = language_piece


# -- extraction --------------------------------------------------------------


def cheapest(odds, edges):
    """The labelling of least cost, by trying all."""
    best = None
    for labels in itertools.product([False, True], repeat=len(odds)):
        cost = sum(max(0, o) if not inside else max(0, -o) for o, inside in zip(odds, labels))
        cost += sum(c for a, b, c in edges if labels[a] != labels[b])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


@pytest.mark.parametrize("seed", range(20))
def test_minimum_cut_is_the_cheapest_labelling(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.choice([-6, -2, -0.5, 0, 0.7, 1, 3]) for _ in range(n)]
    edges = [(a, b, rng.choice([0.2, 0.5, 1.0])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
    labels = html_extraction.minimum_cut(odds, edges)
    cost = sum(max(0, o) if not inside else max(0, -o) for o, inside in zip(odds, labels))
    cost += sum(c for a, b, c in edges if labels[a] != labels[b])
    assert abs(cost - cheapest(odds, edges)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now.</div><div class="cookie-notice"><p>We use cookies.</p></div>%s<aside><p>Beside the text.</p></aside>
<form><p>Your name</p><input></form><div id="comments"><div class="comment-text"><p>Great article, thanks!</p></div></div>
<footer>&copy; site &middot; words.</footer></body></html>"""
ARTICLE = "<article><h1>A &amp; B&quot;</h1><p><b>First  part,\n here.<br><p>Second &lt;i&gt; part.</p><ul><li>One<li>Two</ul><p>x</p></article>"
TEXT = 'A & B"\nFirst part, here.\nSecond <i> part.\nOne\nTwo\nx'


def test_main_text_of_pages(spark):
    pages = [
        (1, PAGE % ARTICLE, TEXT),
        (2, (PAGE % ARTICLE).replace("article>", "main>"), TEXT),
        (3, (PAGE % ARTICLE).replace("<article>", '<div class="post-content">').replace("</article>", "</div>"), TEXT),
        (4, (PAGE % ARTICLE).split("</article>")[0], TEXT),
        (5, None, ""), (6, "", ""), (7, "<p>Plain text, only.</p><p>Another line.</p>", "Plain text, only.\nAnother line."),
        (8, "<div><p>" + "long text. " * 20_000 + "</p></div>", ("long text. " * 20_000).strip()),
        (9, "<article>" + "<p>one</p>" * 3_000 + "</article>", "\n".join(["one"] * 3_000)),
        (10, "<<<>>><p", None), (1, PAGE % ARTICLE, TEXT),
    ]
    frame = spark.createDataFrame([(i, f"u{i}", h, "mine") for i, h, _ in pages], "page_id long, url string, html string, text string")
    found = html_extraction.extract_main_text(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_content", "n_blocks"]
    texts = {r["page_id"]: r for r in found.collect()}
    for i, _, wanted in pages:
        assert wanted is None or texts[i]["text"] == wanted, i
        assert texts[i]["n_chars"] == len(texts[i]["text"])
    assert html_extraction.extract_main_text(frame.limit(0)).count() == 0


LONG = "A long paragraph of plain words, as articles have them, that ends with a stop."


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p data-x=it's>One two.</p><p>Three.</p></article>", "One two.\nThree."),
        ('<article><p title="x>One.</p><p>Two.</p></article>', "One.\nTwo."),
        ('<article><p>See <a title="The hidden valley" href=x>this</a> now.</p></article>', "See this now."),
        (f"<body><form id=aspnet><article><p>{LONG}</p></article><label>Name</label></form></body>", LONG),
        (
            f'<article><p>{LONG}</p><p class="share-price">Shares rose by ten.</p><div class="related-work"><p>{LONG}</p></div></article>',
            f"{LONG}\nShares rose by ten.\n{LONG}",
        ),
        (f'<article><p>{LONG}</p><div class="share"><a href=x>Tweet</a></div><p hidden>Secret</p></article>', LONG),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><p cla", f"{LONG}\n{LONG}"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        (f'<article><p onclick="if (a > b) c()">{LONG}</p></article>', LONG),
    ],
)
def test_odd_markup_is_read_and_judged(html, text):
    assert html_extraction.main_text(html)[0] == text


def test_broken_pages_take_no_square_time():
    import time

    start = time.time()
    for html in ("<a '" * 250_000, "<a x=\"" * 100_000 + ">", "<div>x" * 50_000, "<b><i>" * 50_000 + "x", "<p>" * 200_000, "</b>" * 200_000):
        html_extraction.main_text(html)
    assert time.time() - start < 30


def invented_pages(n, seed, marked):
    """Menus, a notice, paragraphs with a list of short points between them, and a footer; with telling tags or without."""
    rng = random.Random(seed)
    nav, aside, article, footer = ("nav", "aside", "article", "footer") if marked else ("div",) * 4
    sentence = lambda k: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(k)).capitalize() + "."
    for _ in range(n):
        menu = "".join(f'<li><a href="/{k}">{sentence(2)[:-1]}</a></li>' for k in range(6))
        body = [sentence(rng.randint(12, 40)) for _ in range(rng.randint(4, 9))]
        points = [f"Point {k} of {rng.randint(10, 99)}" for k in range(rng.randint(1, 3))]
        text = "".join(f"<p>{b}</p>" for b in body[:2]) + f"<ul>{''.join(f'<li>{x}' for x in points)}</ul>" + "".join(f"<p>{b}</p>" for b in body[2:])
        html = (
            f"<{nav}><ul>{menu}</ul></{nav}><{aside}>{sentence(rng.randint(3, 6))}</{aside}><{article}>{text if not marked else ''.join(f'<p>{b}</p>' for b in body)}"
            f"</{article}><{footer}>&copy; {sentence(3)}</{footer}>"
        )
        yield html, {*body, *points}


def test_the_cut_mends_what_blocks_alone_get_wrong(spark):
    """Against the sign of each block's own log-odds, on pages whose markup says nothing."""
    pages = [(html,) for html, _ in invented_pages(80, 1, True)]
    weights = html_extraction.train_blocks(spark.createDataFrame(pages, "html string"))
    wrong, changed = {True: 0, False: 0}, 0
    for html, body in invented_pages(200, 2, False):
        by = {}
        for smooth in wrong:
            blocks, by[smooth] = html_extraction.labelled(html, weights, smooth)
            wrong[smooth] += sum((b.text in body) != inside for b, inside in zip(blocks, by[smooth]))
        changed += by[True] != by[False]
    assert changed > 50 and wrong[True] < 0.6 * wrong[False], (changed, wrong)


# -- scoring -----------------------------------------------------------------


def test_forward_recursion_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(5), 3).T
    model = hmm_score.Model(start, move, emit)
    texts = [[int(x) for x in rng.integers(0, 5, n)] for n in (1, 2, 5, 6, 3, 1)]
    found = hmm_score.log10_of_texts(texts, model, hmm_score.padded(model))
    counts = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((5, 3)), "log": np.zeros(1)}
    hmm_score.expected_counts(texts, model, hmm_score.padded(model), counts)
    assert math.isclose(counts.pop("log")[0], found.sum(), rel_tol=1e-9)
    wanted = {k: np.zeros_like(v) for k, v in counts.items()}
    for text, got in zip(texts, found):
        total, parts = 0.0, {k: np.zeros_like(v) for k, v in counts.items()}
        for path in itertools.product(range(3), repeat=len(text)):
            p = start[path[0]] * np.prod([move[a, b] for a, b in zip(path, path[1:])]) * np.prod([emit[x, s] for x, s in zip(text, path)])
            total += p
            parts["start"][path[0]] += p
            for a, b in zip(path, path[1:]):
                parts["move"][a, b] += p
            for x, s in zip(text, path):
                parts["emit"][x, s] += p
        assert math.isclose(10**got, total, rel_tol=1e-9)
        for k in wanted:
            wanted[k] += parts[k] / total
    assert all(np.allclose(counts[k], wanted[k], rtol=1e-4) for k in wanted)


def scored_rows(seed, n):
    rng = random.Random(seed)
    return [(i, invented("en" if i % 2 else "de", rng, rng.randint(0, 60))) for i in range(n)]


def test_scores_against_counts(spark, docs_of, monkeypatch):
    rows = scored_rows(3, 300) + [(900, None), (901, ""), (902, "the " * 6000), (None, "the of"), (5, "the of"), (5, "the of")]
    docs = docs_of(rows, "n_tokens string")
    learn = document_remainder("doc_id", 7) != 2
    found = hmm_score.score(docs, learn)
    counts = Counter()
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*lower_words(text), b"\n"])
    tokens, words = sum(counts.values()), len(counts)
    result = found.collect()
    assert len(result) == len(rows)
    of_text = defaultdict(set)
    for (i, text), row in zip(sorted(rows, key=repr), sorted(result, key=lambda r: repr((r["doc_id"], dict(rows).get(r["doc_id"]))))):
        own = [*lower_words(text), b"\n"]
        if i == 5:
            continue
        assert row["n_tokens"] == len(own) and row["train_tokens"] == tokens
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(row["base_score"], sum(math.log10((counts[w] + 1) / (tokens + words + 1)) for w in own), rel_tol=1e-9)
        assert row["score"] < 0
        of_text[text].add(round(row["score"], 9))
    assert all(len(s) == 1 for s in of_text.values())
    held = [r for r in result if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm_score.score(docs.limit(0), learn).count() == 0


def coded_rows(docs, learn):
    counts = hmm_score.count_words(docs.where(learn), "text")
    vocabulary = hmm_score.read_vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return counts, vocabulary, hmm_score.write_symbols(docs, learn, "text", shared)


def test_probabilities_of_single_words_sum_to_one(spark, docs_of):
    """Over all symbols, and within each over its words and one unseen word."""
    docs = docs_of(scored_rows(4, 60))
    counts, vocabulary, coded = coded_rows(docs, F.lit(True))
    model, _ = hmm_score.train(coded, vocabulary, "doc_id")
    assert len(model.emit) == hmm_score.ALPHABET
    assert math.isclose(float((model.emit @ model.start).sum()), 1.0, rel_tol=1e-9)
    assert np.allclose(model.emit.sum(axis=0), 1.0) and np.allclose(model.move.sum(axis=1), 1.0)
    words = {bytes(r["word"]): (r["c"], r["at"]) for r in counts.select("*", hmm_score.symbol_of("word").alias("at")).collect()}
    assert all(at == hmm_score.symbol(w) for w, (_, at) in words.items())
    for at in {at for _, at in words.values()}:
        own = [c for c, here in words.values() if here == at]
        assert (vocabulary.symbol_tokens[at], vocabulary.symbol_words[at]) == (sum(own), len(own))


def test_passes_raise_the_likelihood(spark, docs_of, monkeypatch):
    """Without smoothing, no pass may lower it; with it, the first ones do not."""
    docs = docs_of(scored_rows(8, 200))
    _, vocabulary, coded = coded_rows(docs, F.lit(True))
    _, logs = hmm_score.train(coded, vocabulary, "doc_id", passes=3)
    assert logs[0] < logs[1] < logs[2]
    monkeypatch.setattr(hmm_score, "PRIOR", 1e-9)
    monkeypatch.setattr(hmm_score, "MIXED_IN", 0.0)
    _, logs = hmm_score.train(coded, vocabulary, "doc_id", passes=6)
    assert all(later >= earlier - 1e-4 * abs(earlier) for earlier, later in zip(logs, logs[1:]))


def test_symbols_depend_on_the_word_alone(spark, docs_of):
    docs = docs_of([(1, "a Rare word"), (2, "a " * 500)])
    few = {r["doc_id"]: bytes(r["symbols"]) for r in coded_rows(docs, F.col("doc_id") == 1)[2].collect()}
    many = {r["doc_id"]: bytes(r["symbols"]) for r in coded_rows(docs, F.lit(True))[2].collect()}
    assert few == many
    assert few[1] == np.array([hmm_score.symbol(w) for w in (b"a", b"rare", b"word", hmm_score.END)], "<i4").tobytes()


# -- duplicates --------------------------------------------------------------


def test_exact_duplicates_against_a_dict(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 20_000)  # so that subtrees are spilled
    rng = random.Random(7)
    base = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    made = [(i, rng.choice(base)) for i in range(900)] + [(1000, None), (1001, " \n"), (1002, "x" * 50_000), (1003, "x " * 50_000), (None, base[0])]
    groups = defaultdict(list)
    for i, text in made:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), i is None, i or 0, i))
    wanted = []
    for content, group in groups.items():
        keep = min(group)[3]
        wanted += [(g[3], keep, len(group), g[3] == keep, hashlib.sha256(content.encode()).hexdigest()) for g in group]
    found = exact_dedup.exact_duplicates(docs_of(made))
    assert rows(found) == sorted(wanted, key=repr)
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0


def test_trie_holds_what_was_put_in():
    rng = random.Random(3)
    trie, wanted = exact_dedup.PatriciaTrie(), {}
    for i in range(2_000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        trie.insert(text, (0, i, False, 1))
        wanted.setdefault(text, [i, 0])[1] += 1
    spilled = dict(trie.spill())
    assert spilled and not spilled.keys() & dict(trie.entries(trie.root, b"")).keys()
    found = spilled | dict(trie.drain())
    assert {t: [o[1], o[3]] for t, o in found.items()} == wanted


def plain_near(docs):
    sets = []
    for _, text in docs:
        words = lower_words(text)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    smallest = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            known = smallest[find(i)]
            smallest[find(i)] = doc_id if known is None else min(known, doc_id)
    return [(d, len(s), d if not s else smallest[find(i)], (d if not s else smallest[find(i)]) == d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_near_duplicates_against_all_pairs(spark, docs_of, rows, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    rng = random.Random(11)
    made = []
    for family in range(6):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(rng.choice([2, 12, 30])):
            # Chains: each copy is an edit of the one before, so ends differ a lot.
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 9999)}"
            made.append((len(made), " ".join(words)))
    made += [(900, None), (901, " "), (902, "A b"), (903, "a B"), (904, "a b c d e"), (905, "w " * 20_000), (None, "a b"), (None, "lonely text")]
    found = near_dedup.near_duplicates(docs_of(made, "component_id string"))
    assert rows(found) == sorted(plain_near(made), key=repr)
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_sketches_estimate_and_bands_rarely_miss():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.75, 0.85, 0.95):
        for n in (20, 60, 150, 400, 1_000, 2_000, 8_000) * 5:
            both = rng.integers(0, 2**64, round(n * share), dtype=np.uint64)
            true = len(both) / (len(both) + 2 * ((n - len(both)) // 2))
            a, b = (np.concatenate([both, rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            x, y = near_dedup.minhash(a), near_dedup.minhash(b)
            (p, used), (q, others) = near_dedup.odd_sketch(np.unique(a)), near_dedup.odd_sketch(np.unique(b))
            near = float(near_dedup.likeness(np.bitwise_count((p ^ q).view(np.uint64)).sum(), used, others))
            assert near >= near_dedup.least_likeness(min(used, others), max(len(a), len(b)))
            assert set(near_dedup.band_keys(x)) & set(near_dedup.band_keys(y))
            errors.append(near - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.03
    assert near_dedup.miss_probability(0.75) < 1e-6


@pytest.mark.parametrize("sizes", [(14, 14, 12), (16, 12, 12), (12, 9, 9), (8, 6, 6), (20, 15, 15), (40, 30, 30), (140, 140, 120), (1_200, 900, 900)])
def test_whole_sketches_turn_no_link_away(sizes):
    n, m, shared = sizes
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(3_000 if n < 100 else 300):
        hashes = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
        a, b = np.sort(hashes[:n]), np.sort(hashes[n - shared :])
        v, w = (np.array(near_dedup.sketches_of(x)[0]).view(np.uint64) for x in (a, b))
        lost += not near_dedup.whole_allows(np.bitwise_count(v ^ w).sum(dtype=np.int64), n, m)
    assert lost == 0


def test_small_links_at_the_threshold_are_found(spark, docs_of):
    # 14 shingles each, 12 of them shared: 100 * 12 = 75 * 16.
    made = [(2 * k + i, " ".join(f"w{k}x{j}" for j in range(i * 2, 18 + i * 2))) for k in range(300) for i in range(2)]
    found = near_dedup.near_duplicates(docs_of(made)).where("kept").count()
    assert found == 300


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


# -- packing -----------------------------------------------------------------


def fewest_bins(lengths, capacity):
    """Exact for a few pieces: by trying all, with symmetric bins left out."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for left in set(bins):
            if left >= lengths[i]:
                rest = list(bins)
                rest.remove(left)
                place(i + 1, [*rest, left - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_plans_are_near_the_fewest_sequences(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
    plan = packing.plan_fillings(Counter(lengths), 20)
    used = Counter()
    for filling, _, times in plan:
        assert sum(filling) <= 20 and times > 0
        used.update({n: c * times for n, c in Counter(filling).items()})
    assert used == Counter(lengths)
    assert sum(times for *_, times in plan) <= fewest_bins(lengths, 20) + (1 if len(lengths) > 5 else 0)


def test_large_plans_meet_the_bound():
    rng = random.Random(1)
    lengths = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    plan = packing.plan_fillings(lengths)
    bound = -(-sum(n * c for n, c in lengths.items()) // 2048)
    assert bound <= sum(times for *_, times in plan) <= bound * 1.002 + 1
    assert len(plan) <= 3 * len(lengths)


def test_packed_pieces_are_whole(spark, docs_of):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    whole = Tokenizer.from_file(files["tokenizer_path"])
    rng = random.Random(4)
    made = [(i, invented(rng.choice(list(SOUNDS)), rng, rng.randint(0, 300))) for i in range(150)]
    made += [
        (900, None), (901, ""), (902, "a  b\n\n c\t d\r\ne "), (903, "the of " * 9_000), (904, "x<|endoftext|>y don't we'll"), (905, "“é” 漢字. 12,3.5;"),
        (906, "nbsp here and　there"), (907, "z" * 30_000), (5, made[5][1]), (None, "no id"), (None, "no id"),
    ]
    pieces = packing.pack_documents(docs_of(made).repartition(5), **files).collect()
    texts = defaultdict(list)
    for p in pieces:
        texts[p["row"]].append(p)
    ids_of = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    wanted = Counter()
    for i, text in made:
        ids = ids_of(text)
        head = len(ids) % 2048 or min(2048, len(ids))
        starts = [0, *range(head, len(ids), 2048)]
        cuts = [ids[s : e] for s, e in zip(starts, [*starts[1:], len(ids)])]
        wanted[i, tuple((k, s, len(c), zlib.crc32(np.asarray(c, "<u4").tobytes())) for k, (s, c) in enumerate(zip(starts, cuts)))] += 1
    found = Counter(
        (ps[0]["doc_id"], tuple(sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in ps))) for ps in texts.values()
    )
    assert found == wanted
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p["length"] for p in pieces)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs_of([]), **files).count() == 0


WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　"


@pytest.mark.parametrize("by_ranks", [True, False])
def test_ids_of_any_white_space(by_ranks):
    files = tokenizer_files()
    encoder = packing.ChunkEncoder(*(files.values() if by_ranks else [files["tokenizer_path"]]))
    rng = random.Random(11)
    fixed = [" a\tb", "foo\tbar ", "a  b\tc", "x　y ", "\n", " ", "a\n\nb", "a \nb", "a\n b"]
    words = ["a", "foo", "Bar,", "don't", "12", "é", "漢字", ".", "x" * 70, "<|endoftext|>"]
    for k in range(50_000):
        text = "".join(
            rng.choice(words) if rng.random() < 0.5 else rng.choice([" ", " ", "\n", rng.choice(WHITE)])
            for _ in range(rng.randint(1, 9))
        )
        text = fixed[k] if k < len(fixed) else text
        assert encoder.encode(text) == np.asarray(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_tokenizer_is_read_for_special_tokens_only():
    encoder = packing.ChunkEncoder(*tokenizer_files().values())
    plain = encoder.encode("some words, 12 of them\nand\t other  white space")
    assert plain and "whole" not in vars(encoder)
    text = "a <|endoftext|> b"
    assert encoder.encode(text) == np.asarray(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.size < packing.CACHE_BYTES + 1_000


@pytest.mark.parametrize("seed", range(6))
def test_search_is_never_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(rng.choice([50, 500, 3_000])))
    count = lambda plan: sum(times for *_, times in plan)
    assert count(packing.plan_fillings(lengths)) <= count(packing._planned(lengths, 2048, 0))


# -- the solver of the language pairs --------------------------------------------


def svm_loss(w, x, y, penalty):
    """Squared hinge loss with both classes weighing the same, and the ridge."""
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    return (share * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum() + 0.5 * penalty * w @ w


@pytest.mark.parametrize("seed", range(4))
def test_svm_against_a_plain_descent(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.4 * rng.normal(size=60) > 0.2, 1.0, -1.0)
    penalty = 1e-2
    w = np.zeros(6)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        w = w - 0.05 * (-2 * np.append((share * slack * y) @ x, (share * slack * y).sum()) + penalty * w)
    found = language.fit_svm(x, y, penalty, steps=3_000)
    assert svm_loss(found, x, y, penalty) <= svm_loss(w, x, y, penalty) + 1e-6
    assert np.allclose(found, w, atol=1e-2)


def test_svm_holds_its_rows_once():
    x = np.random.default_rng(5).random((3_000, 256), np.float32)
    y = np.where(np.arange(len(x)) % 2, 1.0, -1.0)
    tracemalloc.start()
    try:
        language.fit_svm(x, y, steps=3)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes / 2


def test_languages_by_votes_of_their_pairs():
    """Every pair's margin counts one win; the label with most wins is taken."""
    rng = np.random.default_rng(5)
    labels = ["a", "b", "c", "d"]
    model = {("language", a, b): rng.normal(size=4) for a, b in itertools.combinations(labels, 2)}
    x = rng.normal(size=(200, 3))
    best, score = language.vote(labels, "language", model, x)
    for row, at in zip(x, best):
        wins = Counter()
        for (_, a, b), w in model.items():
            wins[b if row @ w[:-1] + w[-1] > 0 else a] += 1
        assert wins[labels[at]] == max(wins.values())
    assert ((score >= 0) & (score <= 1)).all()
