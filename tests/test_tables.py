"""Dictionary maintenance, keys, frontier, gazetteer, statistics, ranking."""

import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import frontier, keys, ranking, sizing, terms
from broadsheet.plans import charts, countries, statistics
from broadsheet.sources import dictionary, gazetteer, tables


@pytest.fixture
def stored(spark):
    cats = spark.createDataFrame([(1, "sports"), (2, "empty"), (3, "sports")], "id int, category string")
    kws = spark.createDataFrame(
        [("goal", 1, 5), ("free kick", 1, 2), ("coach", 3, 9)],
        "keyword string, category_id int, load_pos bigint",
    )
    return cats, kws


def requests(spark, *typed):
    return spark.createDataFrame(
        [(i, *t) if isinstance(t, tuple) else (i, t, None) for i, t in enumerate(typed)],
        "request_id bigint, typed string, typed_keyword string",
    )


def test_category_keywords(spark, stored, rows):
    assert rows(terms.category_keywords(*stored)) == [
        (1, "sports", 1, "free kick"),
        (1, "sports", 2, "goal"),
        (1, "sports", 3, "coach"),
        (2, "empty", None, None),
    ]


def test_resolve(spark, stored, rows):
    cats, kws = stored
    asked = requests(spark, ("1", "2"), (" SPORTS ", "Free Kick"), ("7", "1"), ("nope", "goal"), ("2", "1"))
    resolved = terms.resolve_category(asked, cats)
    assert rows(resolved.select("request_id", "category_id", "category")) == [
        (0, 1, "sports"), (1, 1, "sports"), (2, None, None), (3, None, None), (4, 2, "empty")
    ]
    picked = terms.resolve_keyword(resolved, cats, kws)
    assert rows(picked.select("request_id", "keyword")) == [
        (0, "goal"), (1, "free kick"), (2, None), (3, None), (4, None)
    ]


def test_add_categories(spark, stored, rows):
    cats, _ = stored
    asked = requests(spark, " Politics ", "sports", "politics", "a1", "", "world-news")
    verdicts = terms.check_new_categories(asked, cats)
    assert rows(verdicts.select("request_id", "status")) == [
        (0, "added"), (1, "exists"), (2, "exists"), (3, "invalid"), (4, "cancelled"), (5, "added")
    ]
    assert rows(terms.add_categories(asked, cats))[3:] == [(4, "politics"), (5, "world-news")]


def test_add_keywords(spark, stored, rows):
    cats, kws = stored
    asked = requests(
        spark, ("1", "Own Goal"), ("empty", "goal"), ("9", "x"), ("2", "own goal"), ("2", "4x"), ("", "y"), ("2", "")
    )
    verdicts = terms.check_new_keywords(asked, cats, kws)
    assert rows(verdicts.select("request_id", "status")) == [
        (0, "added"), (1, "exists"), (2, "no such category"), (3, "exists"), (4, "invalid"),
        (5, "cancelled"), (6, "cancelled"),
    ]
    assert ("own goal", 1, 10) in rows(terms.add_keywords(asked, cats, kws))


def test_deletes_cascade(spark, stored, rows):
    cats, kws = stored
    kept, left = terms.delete_categories(requests(spark, "Sports").select("request_id", "typed"), cats, kws)
    assert rows(kept) == [(2, "empty")] and rows(left) == []
    left = terms.delete_keywords(requests(spark, ("sports", "1"), ("1", "GOAL"), ("2", "coach")), cats, kws)
    assert rows(left) == [("coach", 3, 9)]


def test_keys_and_orphans(spark, stored, rows):
    cats, kws = stored
    assert rows(keys.key_violations({"c": (cats, "category"), "k": (kws, "keyword")})) == [("c", "sports", 2)]
    assert rows(keys.orphan_keywords(kws, cats.where("id <> 3"))) == [("coach", 3, 9)]


@pytest.mark.parametrize("slice_rows", [0, 100])
def test_without_stored(spark, rows, monkeypatch, slice_rows):
    monkeypatch.setattr(sizing, "SLICE_ROWS", slice_rows)
    batch = spark.createDataFrame([("a",), ("b",)], "url string")
    assert rows(keys.without_stored(batch, spark.createDataFrame([("a",), ("z",)], "url string"))) == [("b",)]


def test_dead_terms(spark, stored, rows):
    listed = spark.createDataFrame([("war on the sea",), ("covid19",), ("goal",)], "keyword string")
    assert rows(terms.dead_terms(listed, ["the"])) == [("covid19", ""), ("war on the sea", "war on sea")]


def test_seed(spark, rows):
    seed = dictionary.seed_frame(spark, {"b": ["x", "y z"], "a": ["x", "w"]})
    cats = dictionary.seed_categories(seed)
    assert rows(cats) == [(1, "b"), (2, "a")]
    found = dictionary.seed_keywords(seed, cats).orderBy("load_pos").collect()
    assert [(r["keyword"], r["category_id"]) for r in found] == [("x", 1), ("y z", 1), ("w", 2)]


def test_number_rows_with_a_hot_key(spark):
    source = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", source.random(), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v double, i int")
    found = ranking.number_rows(df, ["v", "i"], "n", keys=["k"]).collect()
    expected = {}
    for key in {k for k, _, _ in data}:
        for n, (_, _, i) in enumerate(sorted(r for r in data if r[0] == key), 1):
            expected[i] = n
    assert {r["i"]: r["n"] for r in found} == expected


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows_per_batch", [3, 10_000])
def test_numbers_and_previous_rows_across_ranges(spark, seed, rows_per_batch, monkeypatch):
    """Keys that span several ranges, NULL keys, and one shuffle for all of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that keys span ranges
    source = random.Random(seed)
    kinds = [None, "a", "b"] + ["hot"] * (8 if seed else 0)
    data = [(source.choice(kinds), source.choice([1, 2, None]), i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame(data, "k string, l int, i int, v string").repartition(7)
    try:
        for keys in (["k"], ["k", "l"], []):
            found = ranking.number_rows(df, ["i"], "n", keys=keys, previous=("v", "before"))
            groups = {}
            for k, l, i, v in sorted(data, key=lambda r: r[2]):
                groups.setdefault(tuple({"k": k, "l": l}[c] for c in keys), []).append((i, v))
            wanted = {
                i: (n, rows[n - 2][1] if n > 1 else None) for rows in groups.values() for n, (i, _) in enumerate(rows, 1)
            }
            assert {r["i"]: (r["n"], r["before"]) for r in found.collect()} == wanted
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
            assert {r["i"]: r["n"] for r in ranking.number_rows(df, ["i"], "n", keys=keys).collect()} == {i: n for i, (n, _) in wanted.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranking.number_rows(df.limit(0), ["i"], "n", keys=["k"], previous=("v", "b")).count() == 0


def make_frontier(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", F.to_timestamp_ntz(F.lit("2024-01-01 10:00:00")).alias("scrape_time"), F.lit(0).alias("scrape_retries")
    )


def test_round_robin_and_pauses(spark):
    queue = make_frontier(
        spark, ["https://a.com/1", "https://a.com/2", "https://a.com/3", "https://b.org/1"]
    )
    plan = frontier.host_pauses(queue).orderBy("position").collect()
    assert [(r["url"], r["pause"]) for r in plan] == [
        ("https://a.com/1", False), ("https://b.org/1", False), ("https://a.com/2", False), ("https://a.com/3", True)
    ]


def test_frontier_keeps_url_sets_apart(spark, rows):
    queue = make_frontier(spark, ["u1", "u2", "u3"])
    stored = spark.createDataFrame([("u1",)], "url string")
    excluded = spark.createDataFrame([("u2", "why")], "url string, reason string")
    found = spark.createDataFrame([("u1",), ("u4",), ("u4",)], "url string")
    fresh = frontier.new_links(found, queue, stored, excluded)
    assert rows(fresh) == [("u4",)]
    assert sorted(r["url"] for r in frontier.enqueue(queue, fresh).collect()) == ["u1", "u2", "u3", "u4"]
    assert [r["url"] for r in frontier.purge(queue, stored, excluded).collect()] == ["u3"]
    outcomes = spark.createDataFrame([("u1", "stored"), ("u2", "fetch_error")], "url string, status string")
    left = frontier.dequeue(frontier.count_attempts(queue, outcomes), outcomes).collect()
    assert sorted((r["url"], r["scrape_retries"]) for r in left) == [("u2", 1), ("u3", 0)]


@pytest.mark.parametrize(
    "as_of, stale", [("2024-01-01 11:00:00", False), ("2024-01-01 11:00:01", True), ("2024-01-01 10:30:00", False)]
)
def test_refresh_needed(spark, as_of, stale):
    moment = F.to_timestamp_ntz(F.lit(as_of))
    assert frontier.refresh_needed(make_frontier(spark, ["u"]), moment).first()[0] is stale
    assert frontier.refresh_needed(make_frontier(spark, ["u"]).where("false"), moment).first()[0] is True


def test_gazetteer_rules(spark, rows):
    names = spark.createDataFrame(
        [(1, "US", "United States"), (2, "UM", "United States"), (3, "MK", "Macedonia"), (4, "XX", "Nowhere")],
        "pos int, iso2 string, name string",
    )
    codes = spark.createDataFrame([("US", "USA"), ("UM", "UMI"), ("MK", "OLD")], "iso2 string, iso3 string")
    built = gazetteer.build_gazetteer(
        names, codes, gazetteer.alias_frame(spark), gazetteer.extra_frame(spark)
    )
    assert rows(built) == [
        ("America", "US", "USA", "United States"),
        ("Macedonia", "MK", "MKD", "Macedonia"),
        ("Nowhere", "XX", "NULL", "Nowhere"),
        ("Somalia", "SO", "SOM", "Somalia"),
        ("Timor-Leste", "TL", "TLS", "Timor-Leste"),
        ("USA", "US", "USA", "United States"),
        ("United States", "US", "USA", "United States"),
    ]


def test_world_gazetteer_and_mentions(spark):
    codes = [(0, "US", "United States", "USA"), (1, "GB", "United Kingdom", "GBR"), (2, "FR", "France", "FRA"), (3, "MK", "North Macedonia", "MKD"), (4, "SS", "South Sudan", "SSD"), (5, "SD", "Sudan", "SDN"), (6, "ZA", "South Africa", "ZAF"), (7, "ES", "Spain", "ESP")]
    world = gazetteer.world_gazetteer(spark.createDataFrame(codes, "pos int, iso2 string, name string, iso3 string"))
    texts = ["usa america france", "united states south sudan", "england uk united kingdom united states-led", "macedonia"]
    articles = spark.createDataFrame([(t,) for t in texts], "content string")
    found = {r["country"]: r["count"] for r in countries.country_mentions(articles, world).collect()}
    expected = {"united states": 4, "united kingdom": 3, "france": 1, "south sudan": 1, "sudan": 1, "macedonia": 1}
    assert {name: n for name, n in found.items() if n} == expected
    assert found["south africa"] == 0 and "spain" not in found


def test_names_of_one_code_share_their_count(spark, rows):
    gaz = spark.createDataFrame(
        [("New Land", None, "NEW", None), ("Old Land", None, "NEW", None)],
        "name string, iso2 string, iso3 string, canonical string",
    )
    articles = spark.createDataFrame([("new land old land new land",)], "content string")
    assert rows(countries.country_mentions(articles, gaz)) == [("new land", "NEW", 3), ("old land", "NEW", 3)]
    assert rows(countries.country_mentions(articles, gaz, per_name=True)) == [
        ("new land", "NEW", 2), ("old land", "NEW", 1)
    ]
    assert rows(countries.country_mentions(articles.where("false"), gaz)) == []


def test_statistics_count_undated_as_a_day(spark):
    df = spark.createDataFrame(
        [("https://a.com/1", "2024-01-01"), ("https://a.com/2", "2024-01-03"), ("http://b.com/", None)],
        "url string, d string",
    ).select("url", F.to_date("d").alias("scrape_date"))
    row = statistics.corpus_statistics(df).first()
    assert (row[0], row[1], str(row[2]), str(row[3])) == (3, 3, "2024-01-01", "2024-01-03")
    assert [tuple(r) for r in statistics.articles_per_host(df).collect()] == [("a.com", 2), ("b.com", 1)]
    assert statistics.anything_stored(df) and not statistics.anything_stored(df.where("false"))


def test_charts(spark, rows, tmp_path):
    totals = spark.createDataFrame([("a", 3), ("b", 1)], "category string, count bigint")
    shares = charts.category_shares(totals)
    assert rows(shares) == [("a", 3, 0.75), ("b", 1, 0.25)]
    tables.write_chart_table(shares, str(tmp_path / "j"))
    tables.write_chart_table(shares, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    by_domain = spark.createDataFrame([("x", "a", 2)], "domain string, category string, count bigint")
    assert rows(charts.domain_matrix(by_domain, ["a", "b"])) == [("x", 2, 0, 0)]
    one = spark.createDataFrame([("2024-01-01", 5)], "scrape_date string, kw_1 bigint")
    assert rows(charts.keyword_series(one, "t")) == [("2024-01-01", "t", 5)]


def test_create_missing_tables(spark):
    tables.create_missing(spark, "papers")
    tables.create_missing(spark, "papers")
    assert tables.table_exists(spark, "papers", "articles")
    assert not tables.table_exists(spark, "papers", "nothing")
    assert spark.table("papers.articles").columns == ["url", "content", "scrape_date"]
    spark.sql("DROP DATABASE papers CASCADE")


@pytest.fixture
def large_tables(spark, monkeypatch):
    """No table counts as small, and partitions stay as they are dealt."""
    monkeypatch.setattr(sizing, "SLICE_ROWS", -1)
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_unknown_categories_do_not_meet_in_one_task(spark, stored, large_tables):
    asked = spark.range(8000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 100 == 0, "Sports ").otherwise("unheard of").alias("typed")
    )
    found = terms.resolve_category(asked, stored[0])
    assert {tuple(r) for r in found.select("typed", "category_id", "category").distinct().collect()} == {
        ("Sports ", 1, "sports"), ("unheard of", None, None)
    }
    dealt = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 8000 and max(dealt) < 2500


def test_deleted_names_are_looked_up_once(spark, stored, rows, monkeypatch):
    met, real = [], terms.resolve_category
    monkeypatch.setattr(terms, "resolve_category", lambda r, *a: (met.append(r.count()), real(r, *a))[1])
    asked = spark.range(1000).select(F.col("id").alias("request_id"), F.lit("1").alias("typed"), F.lit("Goal").alias("typed_keyword"))
    kept, keywords = terms.delete_categories(asked, *stored)
    assert (rows(kept), rows(keywords)) == ([(2, "empty")], [])
    assert rows(terms.delete_keywords(asked, *stored)) == [("coach", 3, 9), ("free kick", 1, 2)]
    assert met == [1, 1]


@pytest.mark.parametrize("large", [False, True])
def test_verdicts_agree_with_one_request_after_the_other(spark, stored, large, request):
    if large:
        request.getfixturevalue("large_tables")
    draw = random.Random(5)
    words = ["goal", " New ", "new", "b4d", "", " ", "Deep-end", "deep-end", "rain fall", None, " rain fall　"]
    asked = [(draw.randrange(60), draw.choice(["1", "3", "Sports", "empty", "9", "", "no", None]), draw.choice(words)) for _ in range(150)]
    asked += asked[:40] + [(None, "1", "unnumbered"), (None, "1", "new")]
    table = spark.createDataFrame(asked, "request_id bigint, typed string, typed_keyword string")
    place = {"1": 1, "sports": 1, "empty": 2, "2": 2}

    def judged(rows_, known):
        first = {}
        for i, term in rows_:
            if i is not None:
                first[term] = min(i, first.get(term, i))
        for i, term in rows_:
            bad = "cancelled" if term == "" else "exists" if term in known else "invalid" if term == "b4d" else None
            yield bad or ("added" if i is not None and first.get(term) == i else "exists")

    clean = lambda t: None if t is None else t.strip().lower()
    placed = [(i, place.get(clean(t)), clean(w)) for i, t, w in asked]
    sound = [p for p in placed if p[1] is not None and p[2] is not None]
    verdicts = [(*p, v) for p, v in zip(sound, judged([(p[0], p[2]) for p in sound], {"goal", "free kick", "coach"}))]
    away = [
        (i, None, clean(w), "cancelled" if clean(t) == "" else "no such category")
        for (i, t, w), p in zip(asked, placed) if p[1] is None
    ]
    order = lambda found: sorted(found, key=repr)
    assert order(map(tuple, terms.check_new_keywords(table, *stored).collect())) == order(verdicts + away)
    added = [v[2] for v in sorted((v for v in verdicts if v[3] == "added"), key=lambda v: v[0])]
    got = terms.add_keywords(table, *stored).where("load_pos > 9").collect()
    assert sorted(r["keyword"] for r in got) == sorted(added) and len(added) > 3
    names = table.select("request_id", F.col("typed_keyword").alias("typed"))
    plain = [(i, clean(w)) for i, _, w in asked if w is not None]
    want = [(*p, v) for p, v in zip(plain, judged(plain, {"sports", "empty"}))]
    assert order(map(tuple, terms.check_new_categories(names, stored[0]).collect())) == order(want)
    new = terms.add_categories(names, stored[0]).where("id > 3").collect()
    assert sorted(r["category"] for r in new) == sorted(t for _, t, v in want if v == "added")


def _exchanged(df):
    """The shuffles of a plan, as it is before it runs."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("slice_rows", [0, 100])
def test_requests_that_name_nothing_are_not_shuffled(spark, stored, rows, monkeypatch, slice_rows):
    monkeypatch.setattr(sizing, "SLICE_ROWS", slice_rows)
    cats, kws = stored
    asked = requests(spark, ("1", "2"), (" SPORTS ", "Free Kick"), ("nope", "goal"), (None, "goal"), ("1", "goal "), ("2", "goal"), ("1", None), ("1", "9"))
    asked = asked.unionByName(asked.where("request_id = 0")).withColumn("request_id", F.expr("nullif(request_id, 5)"))
    resolved = terms.resolve_category(asked, cats)
    picked = terms.resolve_keyword(resolved, cats, kws)
    assert rows(picked.select("request_id", "category", "keyword")) == sorted(
        [(0, "sports", "goal"), (0, "sports", "goal"), (1, "sports", "free kick"), (2, None, None), (3, None, None),
         (4, "sports", "goal"), (None, "empty", None), (6, "sports", None), (7, "sports", None)], key=repr
    )
    # Both tables of answers have a branch that no join is in.
    joins = 1 if slice_rows else 2
    assert picked._jdf.queryExecution().optimizedPlan().toString().count("Union") >= joins


@pytest.mark.parametrize("slice_rows", [0, 100])
def test_keyword_verdicts_of_odd_requests(spark, stored, rows, monkeypatch, slice_rows):
    monkeypatch.setattr(sizing, "SLICE_ROWS", slice_rows)
    cats, kws = stored
    kws = kws.unionByName(spark.createDataFrame([("4x4", 1, 11), (None, 1, 12)], kws.schema))
    asked = requests(
        spark, ("9", "new"), ("1", "New "), ("2", "new"), ("1", "4x4"), ("1", "5x5"), ("1", None), ("nope", None), (None, "new"),
        (" ", "new"), ("1", " "), ("1", "goal"), ("empty", "other"), ("1", "other"),
    )
    asked = asked.unionByName(asked.where("request_id = 1")).unionByName(asked.where("request_id = 11").withColumn("request_id", F.lit(None).cast("long")))
    verdicts = terms.check_new_keywords(asked, cats, kws)
    assert rows(verdicts.select("request_id", "keyword", "status")) == sorted(
        [(0, "new", "no such category"), (1, "new", "added"), (1, "new", "added"), (2, "new", "exists"), (3, "4x4", "exists"),
         (4, "5x5", "invalid"), (6, None, "no such category"), (7, "new", "no such category"), (8, "new", "cancelled"),
         (9, "", "cancelled"), (10, "goal", "exists"), (11, "other", "added"), (None, "other", "exists"), (12, "other", "exists")], key=repr
    )
    # Requests do not meet at the keyword that they share.
    if slice_rows:
        assert not [x for x in _exchanged(verdicts) if "keyword" in x]
