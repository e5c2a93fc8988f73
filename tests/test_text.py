"""Cleaning and counting rules, case by case."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import counting, formatting, text

STOPS = ["the", "of", "and", "it"]

CLEAN_CASES = [
    ("U.S. well—known “hi”", "us wellknown hi"),
    ("stand-up a--b -x co- self-care", "stand-up self-care"),
    ("3d 2024 x@y.com https://a.b/c", ""),
    ("O’Brien It’s cat's", "cat"),
    ("ab'c’d ab’c'd", "ab"),
    ("‘quoted naïve 中文", "naïve 中文"),
    ("Real Estate.\nreal-estate", "real estate real-estate"),
    ("", ""),
    ("tab\tnbsp sep\u001cnel\u0085end", "tab nbsp sep nel end"),
    ("The OF theory", "theory"),
]


def clean(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", text.clean_text(F.col("t"), STOPS).alias("c")).collect()
    return [row["c"] for row in sorted(found, key=lambda r: r["i"])]


def test_clean_text_cases(spark):
    assert clean(spark, [t for t, _ in CLEAN_CASES]) == [c for _, c in CLEAN_CASES]


def plain_clean(value):
    """The same rules said once more over Python strings."""
    deleted = set("!\"#$%&()*+,./:;<=>?[\\]^_`{|}~—“”")
    kept = []
    for token in "".join(c for c in value if c not in deleted).lower().split():
        if "http" in token:
            continue
        mark = "'" if "'" in token else "’"
        token = token.split(mark)[0]
        parts = token.split("-")
        if all(p.isalpha() for p in parts) and len(token) > 1 and token not in STOPS:
            kept.append(token)
    return " ".join(kept)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(alphabet="abTHEofandit http'’-—“”.,@1é中 \t\n\u001c", max_size=40),
        min_size=20,
        max_size=40,
    )
)
def test_clean_text_agrees_with_plain_rules(spark, texts):
    assert clean(spark, texts) == [plain_clean(t) for t in texts]


def test_clean_text_is_stable_on_its_own_output(spark):
    once = clean(spark, [t for t, _ in CLEAN_CASES])
    assert clean(spark, once) == once


def test_default_stop_words_come_from_spark(spark):
    assert "the" in text.default_stop_words()
    df = spark.createDataFrame([("The cat sat",)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == "cat sat"


@pytest.mark.parametrize(
    "content, term, anywhere, bounded",
    [
        ("surreal estates real estate", "real estate", 2, 1),
        ("el nino préel nino el nino-x", "el nino", 3, 2),
        ("a b a b a", "a b a", 1, 1),
        ("", "a b", 0, 0),
    ],
)
def test_phrase_counts(spark, content, term, anywhere, bounded):
    df = spark.createDataFrame([(content, term)], "c string, t string")
    row = df.select(
        counting.count_phrase(F.col("c"), F.col("t")),
        counting.count_bounded_phrase(F.col("c"), F.col("t")),
    ).first()
    assert tuple(row) == (anywhere, bounded)


def test_word_count_takes_equal_tokens_only(spark):
    df = spark.createDataFrame([("art artist art",)], "c string")
    assert df.select(counting.count_word(F.col("c"), "art")).first()[0] == 2


def test_strip_and_terms(spark):
    df = spark.createDataFrame(
        [("  Real\tEstate \n",), ("co-op",), ("3d",), ("",)], "t string"
    )
    found = df.select(
        formatting.typed_term(F.col("t")), formatting.valid_term(F.col("t")), formatting.display_name(F.col("t"))
    ).collect()
    assert [tuple(r)[:2] for r in found] == [
        ("real\testate", True),
        ("co-op", True),
        ("3d", False),
        ("", True),
    ]
    assert found[1][2] == "Co-Op"


def test_formats(spark):
    row = (
        spark.range(1)
        .select(
            formatting.dotted_thousands(F.lit(1234567)),
            formatting.second_text(formatting.parse_second(F.lit("2024-05-06 07:08:09"))),
            formatting.minute_text(formatting.parse_second(F.lit("2024-05-06 07:08:09"))),
        )
        .first()
    )
    assert tuple(row) == ("1.234.567", "2024-05-06 07:08:09", "2024-05-06 07:08")


def test_strip_takes_the_spaces_that_texts_are_split_on(spark):
    every = spark.range(0xFFFF).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    odd = every.select("c", F.concat("c", "c", F.lit("x "), "c", F.lit("y"), "c").alias("t"))
    slow = F.regexp_replace("t", f"^{text.WHITESPACE}|{text.WHITESPACE}$", "")
    assert odd.where(text.strip(F.col("t")) != slow).count() == 0
    assert "regexp" not in odd.select(text.strip(F.col("t")))._jdf.queryExecution().analyzed().toString()
