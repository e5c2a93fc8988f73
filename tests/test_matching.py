"""Both matching plans, labels, and their agreement with plain rules."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import labelling, matching, sizing, words
from broadsheet.plans import categories, keywords
from broadsheet.sources import dictionary

DICTIONARY = [("tion", "A", 1), ("on in", "B", 2), ("ther", "B", 3), ("is in", "C", 4), ("mit", "D", 5)]
LABEL_CASES = [
    ("tion tion ther", "A"),
    ("tion ther", "B"),
    ("mit tion", "A"),
    ("nothing here", "B"),
    ("", "B"),
    ("mit mit tion", "D"),
]


@pytest.fixture(params=["literal", "joined", "sliced"])
def plan(request, monkeypatch):
    """Force each of the plans that give the same rows."""
    if request.param != "literal":
        for module in (matching, labelling):
            monkeypatch.setattr(module, "INLINE_WORDS", 0)
            monkeypatch.setattr(module, "INLINE_PHRASES", 0)
    if request.param == "sliced":
        monkeypatch.setattr(sizing, "SLICE_ROWS", 2)
    return request.param


def make_articles(spark, contents):
    rows = [(f"https://a.com/{i}", None, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "url string, scrape_date date, content string")


def make_dictionary(spark, rows=DICTIONARY):
    return spark.createDataFrame(rows, "keyword string, category string, load_pos bigint")


def test_labels(spark, plan):
    articles = make_articles(spark, [c for c, _ in LABEL_CASES])
    found = labelling.label_articles(articles, make_dictionary(spark)).collect()
    assert {r["url"]: r["label"] for r in found} == {
        f"https://a.com/{i}": label for i, (_, label) in enumerate(LABEL_CASES)
    }


def test_zero_hit_null(spark, plan):
    articles = make_articles(spark, ["nothing here", "tion"])
    found = labelling.label_articles(articles, make_dictionary(spark), zero_hit="null").collect()
    assert sorted((r["url"][-1], r["label"]) for r in found) == [("0", None), ("1", "A")]


def test_empty_dictionary_labels_null(spark, plan):
    articles = make_articles(spark, ["tion"])
    empty = make_dictionary(spark, []) if plan == "literal" else make_dictionary(spark).where("false")
    assert [r["label"] for r in labelling.label_articles(articles, empty).collect()] == [None]


def test_category_order(spark):
    found = labelling.category_order(make_dictionary(spark)).orderBy("no_phrase", "first_pos").collect()
    assert [r["category"] for r in found] == ["B", "C", "A", "D"]


def test_category_hits(spark, plan, rows):
    articles = make_articles(spark, ["tion tion ther on in", "is in"])
    assert rows(labelling.category_hits(articles, make_dictionary(spark))) == [
        ("https://a.com/0", "A", 2),
        ("https://a.com/0", "B", 2),
        ("https://a.com/1", "C", 1),
    ]


def plain_hits(content, term, bounded):
    if " " not in term:
        return content.split().count(term)
    pattern = re.escape(term)
    return len(re.findall(rf"\b{pattern}\b" if bounded else pattern, content))


@pytest.mark.parametrize("bounded", [False, True])
def test_hits_agree_with_plain_counting(spark, plan, bounded):
    """Random texts over few letters, so that phrases touch and overlap."""
    source = random.Random(7)
    pieces = ["ab", "ba", "aba", "bab", "a-b", "éa", "bb"]
    contents = [" ".join(source.choices(pieces, k=source.randint(0, 25))) for _ in range(60)]
    terms = ["ab", "bb", "a-b", "zz"] + [
        " ".join(source.choices(pieces, k=k)) for k in (2, 2, 2, 2, 3, 3, 4)
    ] + ["b a", "a b", "ba ab ba", "no such"]
    terms = sorted(set(terms))
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    found = (
        matching.term_hits(make_articles(spark, contents), listed, keep=["url"], bounded=bounded)
        .groupBy("url", "term")
        .agg(F.sum("hits").alias("hits"))
        .where("hits > 0")
        .collect()
    )
    expected = {
        (f"https://a.com/{i}", t): plain_hits(c, t, bounded)
        for i, c in enumerate(contents)
        for t in terms
        if plain_hits(c, t, bounded)
    }
    assert {(r["url"], r["term"]): r["hits"] for r in found} == expected


def test_top_keywords_keep_zero_phrases_only(spark, plan):
    articles = make_articles(spark, ["tion mit tion"])
    found = keywords.top_keywords(articles, make_dictionary(spark)).collect()
    assert [tuple(r) for r in found] == [("tion", "A", 2), ("mit", "D", 1), ("is in", "C", 0), ("on in", "B", 0)]
    assert keywords.top_keywords(articles.where("false"), make_dictionary(spark)).collect() == []


def test_phrase_count_without_articles(spark, rows):
    listed = make_dictionary(spark).select(F.col("keyword").alias("term"))
    assert rows(words.phrase_count(make_articles(spark, ["x"]), listed)) == [("is in", 0), ("on in", 0)]
    assert rows(words.phrase_count(make_articles(spark, []), listed)) == []


def test_word_count(spark, rows):
    assert rows(words.word_count(make_articles(spark, ["a b a", "", "b"]))) == [("a", 2), ("b", 2)]


def test_reports_add_up(spark):
    contents = [c for c, _ in LABEL_CASES] * 3
    articles = make_articles(spark, contents).withColumn(
        "scrape_date", F.to_date(F.lit("2024-01-01"))
    )
    cube = categories.category_cube(labelling.label_articles(articles, make_dictionary(spark)))
    for report in (categories.category_totals, categories.categories_by_date, categories.categories_by_domain):
        assert sum(r["count"] for r in report(cube).collect()) == len(contents)


def test_dates_sum_to_the_keyword_total(spark):
    articles = make_articles(spark, ["tion tion", "mit", "tion"]).withColumn(
        "scrape_date", F.date_add(F.to_date(F.lit("2024-01-01")), F.length("content"))
    )
    by_date = keywords.keywords_by_date(articles, "tion").collect()
    assert [r["kw_1"] for r in by_date] == [0, 1, 2]


def test_undated_articles_drop_out_of_date_reports(spark):
    articles = make_articles(spark, ["tion"])
    cube = categories.category_cube(labelling.label_articles(articles, make_dictionary(spark)))
    assert categories.categories_by_date(cube).collect() == []
    assert keywords.keywords_by_date(articles, "tion").collect() == []
    assert [r["count"] for r in categories.category_totals(cube).collect()] == [1]


def test_keyword_join(spark, rows):
    kws = spark.createDataFrame([("a", 1, 1), ("b", 9, 2)], "keyword string, category_id int, load_pos bigint")
    cats = spark.createDataFrame([(1, "X"), (2, "Y")], "id int, category string")
    assert rows(labelling.keyword_categories(kws, cats)) == [("a", "X", 1)]


@pytest.mark.parametrize("zero_hit", ["first", "null"])
def test_both_labelling_plans_give_the_same_rows(spark, rows, monkeypatch, zero_hit):
    dictionary = spark.createDataFrame(
        [
            ("tion", "A", 1), ("tion", "A", 2), ("mit", "B", 3), ("mit", "B", 3), (None, "A", 4), ("", "B", 5),
            ("key", None, 6), ("of the", "C", None), ("of the", "D", None), ("zwei", "E", 7), ("drei", "F", 7),
        ],
        "keyword string, category string, load_pos long",
    )
    day = datetime.date(2024, 1, 1)
    articles = spark.createDataFrame(
        [
            ("u", day, "tion mit mit"), ("u", day, "tion tion mit"), ("u", day, "tion tion mit"), ("v", None, "end of the of the"),
            ("w", day, "zwei drei"), ("x", day, ""), ("y", day, None), (None, None, "mit"), (None, None, "nothing"),
        ],
        "url string, scrape_date date, content string",
    )
    small = rows(labelling.label_articles(articles, dictionary, zero_hit))
    monkeypatch.setattr(labelling, "INLINE_WORDS", 0)
    monkeypatch.setattr(labelling, "INLINE_PHRASES", 0)
    large = rows(labelling.label_articles(articles, dictionary, zero_hit))
    assert small == large and len(small) == 9
    assert [r[2] for r in small if r[0] == "u"] == ["A", "A", "B"]
    assert [r[2] for r in small if r[0] == "w"] == ["E"]


def test_terms_by_date_are_typed_terms(spark, rows):
    articles = spark.createDataFrame([(datetime.date(2024, 1, 1), "tion of the tion")], "scrape_date date, content string")
    assert rows(keywords.keywords_by_date(articles, " Tion ", "OF the")) == [(datetime.date(2024, 1, 1), 2, 1)]
    for bad in ("", "  ", "a1", "x.y"):
        with pytest.raises(ValueError):
            keywords.keywords_by_date(articles, bad)


def test_stop_words_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("the",), ("of",), ("the",), (None,)], "word string")
    assert dictionary.stop_words(table) == ["of", "the"]
    monkeypatch.setattr(dictionary, "STOP_WORD_LIMIT", 1)
    with pytest.raises(ValueError):
        dictionary.stop_words(table)


def test_long_phrases_and_overlaps_in_one_scan(spark, monkeypatch):
    """A phrase of 200 tokens, one that overlaps itself across long texts, and no more scans for more terms."""
    for name in ("INLINE_WORDS", "INLINE_PHRASES"):
        monkeypatch.setattr(matching, name, 0)
    source = random.Random(3)
    long = " ".join(source.choices(["ab", "ba", "cab"], k=200))
    looped = " ".join(["ab", "ba"] * 300 + ["ab"])
    contents = [f"x{long}y z {long}", looped, "ab " + looped, "", "ab"]
    terms = [long, "ab ba ab", "b ab b", " ".join(["ab", "ba"] * 60 + ["ab"]), "ab", "ba ab ba ab"]
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    hits = matching.term_hits(make_articles(spark, contents), listed, keep=["url"])
    found = hits.groupBy("url", "term").agg(F.sum("hits").alias("hits")).collect()
    expected = {(f"https://a.com/{i}", t): n for i, c in enumerate(contents) for t in terms if (n := plain_hits(c, t, False))}
    assert {(r["url"], r["term"]): r["hits"] for r in found} == expected
    # The texts are read once, with phrases that overlap and without, for many terms too.
    many = spark.createDataFrame([(f"w{i}",) for i in range(3000)], "term string")
    for some in (many, listed):
        plan = matching.term_hits(make_articles(spark, contents), some)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1


def test_matches_that_stand_alone_are_summed_over_texts(spark, monkeypatch):
    """A phrase that may overlap itself, but nowhere does, leaves the scan as sums and not as rows of each text."""
    for name in ("INLINE_WORDS", "INLINE_PHRASES"):
        monkeypatch.setattr(matching, name, 0)
    listed = spark.createDataFrame([("on no",), ("la la",), ("ab la la ab",)], "term string")
    texts = ["on no x", "x on no y on no"] * 20 + ["la la la", "x ab la la ab la la ab", "a on noon no"]
    hits = matching.term_hits(make_articles(spark, texts).coalesce(2), listed).collect()
    totals = {t: sum(r["hits"] for r in hits if r["term"] == t) for t in ("on no", "la la", "ab la la ab")}
    assert totals == {t: sum(plain_hits(c, t, False) for c in texts) for t in totals}
    assert len([r for r in hits if r["term"] == "on no"]) == 2


def test_words_of_texts_are_taken_from_one_cleaning(spark, tmp_path):
    from checks import fixtures as fx

    rows = [(1, "One two. Two!", "en", "src1"), (2, "", "de", "src2"), (3, None, "es", "src3"), (4, "the of", "en", "src1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    names, words = fx.place_names(spark, str(tmp_path)), fx.cleaned_words(spark, str(tmp_path))
    assert sorted(map(tuple, names.collect())) == [(1, "1", "one"), (1, "1", "two"), (1, "1", "two")]
    assert sorted(map(tuple, words.collect())) == [("one", 1), ("two", 1)]
    for df in (names, words):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
