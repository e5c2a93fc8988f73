"""Published runs, the queue log, the word index and bucketed urls."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.counting import count_term
from broadsheet.operators import postings, queue_log
from broadsheet.operators.frontier import count_attempts, dequeue, enqueue, purge
from broadsheet.plans import run
from broadsheet.session import cut_lineage
from broadsheet.sources import buckets, runs

ARTICLES = "url string, scrape_date date, content string"


def articles_of(spark, texts):
    import datetime

    return spark.createDataFrame(
        [(f"u{i}", datetime.date(2024, 1, 1 + i % 3) if i % 5 else None, t) for i, t in enumerate(texts)], ARTICLES
    )


def terms_of(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def scanned(articles, terms):
    out = []
    for t in terms:
        hits = articles.select("url", count_term(F.col("content"), t).alias("hits")).where("hits > 0").collect()
        out += [(t, r["url"], r["hits"]) for r in hits]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_index_answers_like_the_texts(spark, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "né", "cd"][: rng.choice([2, 4])]
    word = lambda: "-".join(rng.choices(letters, k=rng.choice([1, 1, 1, 2, 3])))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(60)]
    terms = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(60)} | {"zz", "a b a", "a a", "a a a"})
    articles = articles_of(spark, texts)
    found = postings.indexed_hits(postings.postings(articles), terms_of(spark, terms))
    assert sorted((r["term"], r["url"], r["hits"]) for r in found.collect()) == scanned(articles, terms)


def test_odd_terms_are_looked_for_in_the_texts(spark):
    articles = articles_of(spark, ["a -b a- b", "x a b", "a  b"])
    terms = ["a b", "a  b", "", "-b", "a -b"]
    index = postings.postings(articles)
    got = {(r["term"], r["url"]) for r in postings.answered_hits(index, articles, terms_of(spark, terms)).collect()}
    assert got >= {("a b", "u1"), ("a  b", "u2"), ("a -b", "u0")}
    assert postings.answered_hits(index, articles, terms_of(spark, ["a b"])).count() == 1


def test_index_grows_by_batches_and_reads_its_folders_only(spark, tmp_path):
    articles = articles_of(spark, ["a b c", "b c d", "c d e", "a b", None, ""])
    root = str(tmp_path)
    for number, keep in enumerate([F.col("url") < "u2", F.col("url") >= "u2"], 1):
        rows = postings.laid_out(postings.postings(articles.where(keep)))
        runs.publish(spark, root, number, {"postings": rows}, run.PARTITIONED)
    index = runs.read_runs(spark, root, "postings", postings.POSTINGS)
    found = postings.indexed_hits(index, terms_of(spark, ["a b", "c"]))
    assert sorted((r["term"], r["url"]) for r in found.collect()) == [("a b", "u0"), ("a b", "u3"), ("c", "u0"), ("c", "u1"), ("c", "u2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "content" not in plan
    empty = postings.indexed_hits(runs.read_runs(spark, f"{root}/none", "postings", postings.POSTINGS), terms_of(spark, ["a"]))
    assert empty.count() == 0


def frontier_of(spark, urls):
    return spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t").crossJoin(
        spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int")
    ).select("url", F.col("t").alias("scrape_time"), F.col("n").alias("scrape_retries"))


def test_log_folds_to_the_snapshots(spark, rows):
    urls = [f"u{i}" for i in range(30)]
    frontier = cut_lineage(frontier_of(spark, urls))
    log = queue_log.snapshot_rows(frontier, 0)
    assert rows(queue_log.open_queue(log).drop("opened")) == rows(frontier)
    outcomes = spark.createDataFrame(
        [(f"u{i}", ("stored", "rejected", "fetch_error")[i % 3]) for i in range(20)] + [("u2", "fetch_error"), ("other", "stored")],
        "url string, status string",
    )
    tried = log.unionByName(queue_log.attempt_rows(queue_log.open_queue(log), outcomes))
    assert tried.count() == 30 + 21  # one attempt writes one row
    left = dequeue(count_attempts(frontier, outcomes.select("url")), outcomes)
    assert rows(queue_log.open_queue(tried).drop("opened")) == rows(left)
    assert rows(queue_log.open_queue(queue_log.compacted(tried))) == rows(queue_log.open_queue(tried))
    known = spark.createDataFrame([("u2",), ("u25",), ("none",)], "url string")
    gone = tried.unionByName(queue_log.settled_rows(queue_log.open_queue(tried), known))
    nothing = known.limit(0)
    assert rows(queue_log.open_queue(gone).drop("opened")) == rows(purge(left, known, nothing))


def test_url_that_comes_back_starts_anew(spark, rows):
    now = F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00"))
    first = queue_log.snapshot_rows(frontier_of(spark, ["a", "b"]), 1)
    outcomes = spark.createDataFrame([("a", "fetch_error"), ("b", "stored")], "url string, status string")
    log = first.unionByName(queue_log.attempt_rows(queue_log.open_queue(first), outcomes))
    again = log.unionByName(queue_log.queued_rows(spark.createDataFrame([("b",)], "url string"), now, 5))
    wanted = enqueue(
        dequeue(count_attempts(frontier_of(spark, ["a", "b"]), outcomes.select("url")), outcomes),
        spark.createDataFrame([("b",)], "url string"),
        now,
    )
    assert rows(queue_log.open_queue(again).drop("opened")) == rows(wanted)


def test_run_that_dies_is_not_seen_and_can_be_done_again(spark, tmp_path, rows):
    root, schema = str(tmp_path), "k int"
    table = lambda n: spark.createDataFrame([(i,) for i in range(n)], schema)
    runs.publish(spark, root, 1, {"a": table(2), "b": table(3)})
    dies = table(4).select(F.when(F.col("k") < 3, F.col("k")).otherwise(F.raise_error(F.lit("killed")).cast("int")).alias("k"))
    with pytest.raises(Exception):  # noqa: B017
        runs.publish(spark, root, 2, {"a": table(5), "b": dies})
    assert runs.read_runs(spark, root, "a", schema).count() == 2 and runs.next_run(spark, root) == 2
    runs.publish(spark, root, 2, {"a": table(5), "b": table(4)})
    assert runs.read_runs(spark, root, "a", schema).count() == 7 and runs.read_runs(spark, root, "b", schema).count() == 7
    runs.publish(spark, root, 3, {"a": table(1), "b": table(1)}, bases=["a"])
    assert rows(runs.read_runs(spark, root, "a", schema)) == [(0, 3)]
    assert runs.read_runs(spark, root, "b", schema).count() == 8
    assert runs.read_runs(spark, f"{root}/none", "a", schema).count() == 0


def test_stored_urls_stay_in_their_buckets(spark, tmp_path, rows):
    tag = uuid.uuid4().hex
    stored = [(f"u{i}",) for i in range(0, 20_000, 2)]
    for name, part in (("one", stored[:7_000]), ("two", stored[7_000:])):
        buckets.write_bucketed(spark.createDataFrame(part, "url string"), f"{name}_{tag}", f"{tmp_path}/{name}", buckets=8)
    found = spark.createDataFrame([(f"u{i}",) for i in range(100)] * 2, "url string")
    new = buckets.without_bucketed(found, *[buckets.read_bucketed(spark, f"{n}_{tag}") for n in ("one", "two")])
    plan = new._jdf.queryExecution().executedPlan().toString()
    # One Exchange, of the found links; none between a stored scan and its join.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SelectedBucketsCount: 8 out of 8") == 2
    assert rows(new) == sorted((f"u{i}",) for i in range(1, 100, 2))


def test_second_day_adds_to_the_stored_sums(spark, tmp_path, rows):
    import datetime

    from broadsheet.operators.labelling import label_articles
    from broadsheet.plans import categories, keywords, report_state

    day = lambda d: datetime.date(2024, 1, d) if d else None
    made = [(f"https://a{i % 3}.com/{i}", day(i % 4), ["tion tion", "on in x", "mit", ""][i % 4 if i % 5 else 3]) for i in range(40)]
    articles = spark.createDataFrame(made, ARTICLES)
    dictionary = spark.createDataFrame([("tion", "A", 1), ("on in", "B", 2), ("no no", "B", 3), ("zz", "C", 4)], "keyword string, category string, load_pos long")
    root = str(tmp_path)
    parts = [F.col("scrape_date") == day(1), F.coalesce(F.col("scrape_date") <= day(2), F.lit(False)), F.lit(True)]
    assert [report_state.add_days(spark, root, articles.where(p), dictionary) for p in parts] == [1, 1, 2]
    again = articles.withColumn("content", F.lit("tion tion tion"))
    assert report_state.add_days(spark, root, again, dictionary) == 0
    cube = categories.category_cube(label_articles(articles, dictionary))
    assert rows(categories.categories_by_date(report_state.stored_cube(spark, root))) == rows(categories.categories_by_date(cube))
    assert rows(categories.category_totals(report_state.stored_cube(spark, root))) == rows(categories.category_totals(cube))
    assert rows(report_state.stored_keyword_totals(spark, root, dictionary)) == rows(keywords.keyword_totals(articles, dictionary))


def test_added_days_read_their_folders_only(spark, tmp_path):
    from broadsheet.plans import report_state
    from broadsheet.sources import tables

    articles = articles_of(spark, ["tion"] * 12)
    dictionary = spark.createDataFrame([("tion", "A", 1)], "keyword string, category string, load_pos long")
    tables.append_rows(articles.where("scrape_date = '2024-01-01'"), f"{tmp_path}/t", "articles")
    stored = tables.read_table(spark, f"{tmp_path}/t", "articles")
    assert report_state.add_days(spark, f"{tmp_path}/s", stored, dictionary) == 1
    tables.append_rows(articles.where("scrape_date = '2024-01-02'"), f"{tmp_path}/t", "articles")
    stored = tables.read_table(spark, f"{tmp_path}/t", "articles")
    days = report_state.new_days(spark, f"{tmp_path}/s", stored)
    assert "content" not in days._jdf.queryExecution().executedPlan().toString()
    assert [str(r[0]) for r in days.collect()] == ["2024-01-02"]


def test_a_batch_reads_the_folders_of_its_urls(spark, tmp_path):
    from broadsheet.streaming import incremental

    root = str(tmp_path)
    old = spark.createDataFrame([(f"u{i}", "stored" if i % 2 else "fetch_error") for i in range(200)], "url string, status string")
    old = old.withColumns({c: F.lit(None).cast(t) for c, t in (("reason", "string"), ("scrape_date", "date"), ("content", "string"))})
    old.withColumn("bucket", incremental.bucket_of(F.col("url"))).write.partitionBy("bucket").parquet(f"{root}/outcomes/batch=0")
    now = spark.createDataFrame([("u1",), ("u2",), ("new",)], "url string")
    found = incremental.settled_before(spark, root, 1, now)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]* IN ", plan)
    folders = {r[0] for r in now.select(incremental.bucket_of(F.col("url"))).collect()}
    got = {r["url"] for r in found.collect()}
    assert "u1" in got and "u2" not in got and len(got) <= 200 * len(folders) / incremental.BUCKETS * 4


def test_marks_of_a_text_do_not_travel_with_each_of_its_parts(spark):
    plan = postings.postings(articles_of(spark, ["a b-c d"]))._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], false", plan)
    assert carried and all(re.sub(r"#\d+", "", c) == "url, scrape_date" for c in carried)


def test_index_is_made_where_the_texts_are_read(spark, tmp_path):
    articles = articles_of(spark, ["a b-c d a", "b c"])
    index = postings.laid_out(postings.postings(articles))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = {(r["part"], r["url"]): r["places"] for r in index.collect()}
    assert found == {("a", "u0"): [0, 16], ("b", "u0"): [6], ("c", "u0"): [9], ("d", "u0"): [12], ("b", "u1"): [0], ("c", "u1"): [4]}


def test_articles_that_share_a_url_have_one_row_for_a_part(spark, rows):
    texts = [("u", "a b"), ("u", "c b c"), (None, "a b"), (None, "a b"), ("v", "a b")]
    articles = spark.createDataFrame([(u, None, t) for u, t in texts], ARTICLES)
    index = postings.postings(articles)
    assert rows(index.select("part", "url", "places")) == [
        ("a", "u", [0]), ("a", "v", [0]), ("a", None, [0, 0]),
        ("b", "u", [4, 4]), ("b", "v", [4]), ("b", None, [4, 4]), ("c", "u", [0, 8]),
    ]
    found = postings.indexed_hits(index, terms_of(spark, ["a b", "c b", "b", "b c"]))
    assert rows(found.select("term", "url", "hits")) == [
        ("a b", "u", 1), ("a b", "v", 1), ("a b", None, 1), ("b c", "u", 1), ("b", "u", 2), ("b", "v", 1), ("b", None, 2), ("c b", "u", 1),
    ]


def test_common_parts_move_once_however_many_phrases_have_them(spark):
    index = postings.postings(articles_of(spark, ["a b", "a c"]))
    found = postings.indexed_hits(index, terms_of(spark, ["a b", "a c", "a d", "b a"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Index rows go by article, before they meet the phrases.
    assert re.findall(r"Exchange hashpartitioning\((?:url|term#\d+, n)[^)]*", plan) == re.findall(r"Exchange hashpartitioning\(url#\d+, scrape_date#\d+[^)]*", plan)
    assert plan.count("Exchange hashpartitioning(url") == 1
    assert sorted((r["term"], r["url"], r["hits"]) for r in found.collect()) == [("a b", "u0", 1), ("a c", "u1", 1)]
