"""Article extraction, reject reasons, ingest and the stream."""

import os

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import extraction, sizing
from broadsheet.plans import ingest
from broadsheet.session import cut_lineage
from broadsheet.sources import tables
from broadsheet.streaming import incremental

SITES = "domain string, div_filter string, p_attr_exclusion array<string>"
TOO_FEW = "The content of the requested <div> was not worth saving (too few paragraphs: %d)."


def paragraphs(count, text="p{0}", attributes=""):
    return "".join(f"<p{attributes}>{text.format(i)}</p>" for i in range(count))


CASES = {
    "not found": (f"<div class='other'>{paragraphs(9)}</div>", None, extraction.NOT_FOUND),
    "empty": ("<div class='story'><script>x()</script></div>", None, extraction.EMPTY),
    "too few": (
        f"<div class='story'>{paragraphs(5)}<b class='paragraph'>a</b><i class='a-paragraph'>b</i></div>",
        None,
        TOO_FEW % 5,
    ),
    "marked": (
        "<div class='story'>" + paragraphs(5)
        + "".join(f"<span class='x paragraph-{i}'>m{i}</span>" for i in range(8)) + "</div>",
        "m0 m1 m2 m3 m4 m5 m6 m7",
        None,
    ),
    "captions": (
        "<div class='story'>" + paragraphs(4) + "".join(f"<figcaption><p>c{i}</p></figcaption>" for i in range(3))
        + "</div>",
        "p0 p1 p2 p3",
        None,
    ),
    "excluded values": (f"<div class='story'>{paragraphs(7, attributes=' class=promo-box')}</div>", "", None),
    "exclude inside": (
        "<div class='story'>" + paragraphs(7) + "<p>gone <i class='my-exclude'>x</i></p></div>",
        "p0 p1 p2 p3 p4 p5 p6",
        None,
    ),
    "div before article": (
        f"<article class='story'>{paragraphs(7, 'a{0}')}</article><div class='main story-body'>{paragraphs(7)}</div>",
        "p0 p1 p2 p3 p4 p5 p6",
        None,
    ),
    "article": (f"<article class='story'>{paragraphs(7)}</article>", "p0 p1 p2 p3 p4 p5 p6", None),
    "div id": (f"<div id='the-story'>{paragraphs(7)}</div>", "p0 p1 p2 p3 p4 p5 p6", None),
    "unclosed": (
        "<div class='story'>" + "".join(f"<p><b> p{i} &amp; q<br>" for i in range(7)) + "</div><p>outside</p>",
        " ".join(f"p{i} & q" for i in range(7)),
        None,
    ),
}


def test_extraction_cases(spark):
    pages = [(i, f"https://a.com/{name}", html) for i, (name, (html, _, _)) in enumerate(CASES.items())]
    pages += [(90, "https://unknown.com/x", "<p>x</p>"), (91, "https://a.com/gone", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sites = spark.createDataFrame([("a.com", "story", ["promo"])], SITES)
    found = {r["page_id"]: r for r in extraction.extract_articles(df, sites).collect()}
    for i, (name, (_, text, reason)) in enumerate(CASES.items()):
        assert (found[i]["raw_text"], found[i]["reason"]) == (text, reason), name
        assert found[i]["status"] == ("rejected" if reason else "stored"), name
    assert (found[90]["status"], found[90]["reason"]) == ("rejected", extraction.NO_RULE)
    assert found[91]["status"] == "fetch_error"


@pytest.fixture
def world(spark):
    good = "<article>" + paragraphs(7, "word{0} alpha") + "</article>"
    urls = {"ok": good, "bad": "<article><p>short</p></article>", "gone": None}
    pages = spark.createDataFrame(
        [(i, f"https://a.com/{n}", h) for i, (n, h) in enumerate(urls.items()) if h]
        + [(9, "https://a.com/ok", "<article><p>later copy</p></article>")],
        "page_id long, url string, html string",
    )
    frontier = spark.createDataFrame(
        [(f"https://a.com/{n}", None, 1) for n in [*urls, "stored"]],
        "url string, scrape_time timestamp_ntz, scrape_retries int",
    )
    stored = spark.createDataFrame([("https://a.com/stored",)], "url string")
    sites = spark.createDataFrame([("a.com", None, [])], SITES)
    return pages, frontier, stored, sites


@pytest.mark.parametrize("slice_rows", [0, 1000])
def test_ingest_settles_the_frontier(spark, world, rows, tmp_path, monkeypatch, slice_rows):
    monkeypatch.setattr(sizing, "SLICE_ROWS", slice_rows)
    pages, frontier, stored, sites = world
    result = ingest.ingest(
        frontier, pages, sites, stored, stored.where("false"),
        F.to_timestamp_ntz(F.lit("2024-02-01 12:00:00")), ["the"],
    )
    articles = result.articles.collect()
    assert [(r["url"], str(r["scrape_date"]), r["content"]) for r in articles] == [
        ("https://a.com/ok", "2024-02-01", " ".join(["alpha"] * 7))
    ]
    assert rows(result.excluded) == [("https://a.com/bad", TOO_FEW % 1)]
    assert rows(result.frontier) == [("https://a.com/gone", None, 2)]
    assert [tuple(r)[1:] for r in result.run_log.collect()] == [(1, 2)]
    root = str(tmp_path / "tables")
    left = str(tmp_path / "left")
    for _ in range(2):  # a repetition after a failure adds nothing
        ingest.append_result(result, root, left)
    assert rows(spark.read.parquet(left)) == rows(result.frontier)
    assert rows(tables.read_urls(spark, root, "articles")) == [("https://a.com/ok",)]
    assert tables.read_articles(spark, root).columns == ["url", "date", "text"]
    assert [r["value"] for r in tables.run_messages(tables.read_table(spark, root, "run_log")).collect()] == [
        "2024-02-01 12:00 stored 1, omitted 2"
    ]
    tables.export_urls(tables.read_table(spark, root, "articles"), str(tmp_path / "urls"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "urls")).collect()] == ["https://a.com/ok"]


def test_stream_takes_each_url_once(spark, world, rows, tmp_path):
    pages, _, _, sites = world
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")

    def run():
        incremental.ingest_new_pages(spark, landing, root, sites, F.to_date(F.lit("2024-02-01")), ["the"])
        return rows(incremental.read_outcomes(spark, root).select("url", "status", "batch"))

    pages.coalesce(1).write.parquet(landing)
    first = run()
    assert [(u, s) for u, s, _ in first] == [("https://a.com/bad", "rejected"), ("https://a.com/ok", "stored")]
    assert run() == first
    drop = pages.withColumn("url", F.replace("url", F.lit("bad"), F.lit("new"))).coalesce(1)
    drop.write.mode("append").parquet(landing)
    second = run()
    assert set(first) <= set(second)
    assert [(u, s) for u, s, _ in set(second) - set(first)] == [("https://a.com/new", "rejected")]


def outcome_rows(spark, landed, sites, rows):
    pages = spark.createDataFrame(landed, "page_id bigint, url string, html string")
    outcomes = ingest.page_outcomes(pages, sites, F.to_date(F.lit("2024-02-01")), ["the"])
    return rows(outcomes.select("url", "status", "content"))


@pytest.mark.parametrize("slice_rows", [0, 1000])
def test_one_outcome_for_each_landed_url(spark, world, rows, monkeypatch, slice_rows):
    monkeypatch.setattr(sizing, "SLICE_ROWS", slice_rows)
    sites = world[3]
    good, other = (f"<article>{'<p>%s</p>' % word * 7}</article>" for word in ("alpha", "beta"))
    x, y = "https://a.com/x", "https://a.com/y"
    # Equal ids of different urls: a later copy of x does not take y along.
    landed = [(1, x, good), (5, x, other), (5, y, good)]
    assert outcome_rows(spark, landed, sites, rows) == [
        (x, "stored", " ".join(["alpha"] * 7)), (y, "stored", " ".join(["alpha"] * 7))
    ]
    # A failed fetch with a lower id does not hide the page.
    assert outcome_rows(spark, [(1, x, None), (2, x, other)], sites, rows) == [(x, "stored", " ".join(["beta"] * 7))]
    assert outcome_rows(spark, [(1, x, None), (1, x, None)], sites, rows) == [(x, "fetch_error", None)]
    # Exact copies are one page.
    assert outcome_rows(spark, [(1, x, good)] * 3 + [(2, y, other)], sites, rows) == [
        (x, "stored", " ".join(["alpha"] * 7)), (y, "stored", " ".join(["beta"] * 7))
    ]
    assert outcome_rows(spark, [], sites, rows) == []


def test_stream_reads_failed_fetches_again(spark, world, rows, tmp_path):
    sites = world[3]
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    good = f"<article>{'<p>alpha</p>' * 7}</article>"

    def drop(html):
        spark.createDataFrame([(1, "https://a.com/x", html)], "page_id bigint, url string, html string").coalesce(
            1
        ).write.mode("append").parquet(landing)
        incremental.ingest_new_pages(spark, landing, root, sites, F.to_date(F.lit("2024-02-01")), ["the"])
        return rows(incremental.read_outcomes(spark, root).select("url", "status"))

    assert drop(None) == [("https://a.com/x", "fetch_error")]
    assert drop(None) == [("https://a.com/x", "fetch_error")]
    assert drop(good) == [("https://a.com/x", "stored")]
    assert drop(None) == [("https://a.com/x", "stored")]


def test_cut_lineage_writes_to_the_shared_folder(spark):
    kept = cut_lineage(spark.range(10))
    assert kept.count() == 10
    assert os.path.isdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
