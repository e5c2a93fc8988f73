"""Url forms, link filters, next-page links."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import markup, urls
from broadsheet.operators import extraction, links
from broadsheet.plans import discover

URL_CASES = [
    ("https://www.a.com:80/x", "a.com:80", "www.a.com"),
    ("http://www.a.com/x", "http:", "www.a.com"),
    ("https://wwwqa.com/x", "a.com", "wwwqa.com"),
    ("ftp://x", "ftp:", None),
]


def test_domain_and_host(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URL_CASES], "u string")
    found = df.select("u", urls.domain(F.col("u")), urls.host(F.col("u"))).collect()
    assert [tuple(r) for r in found] == URL_CASES


HREF_CASES = [
    ("/a/b?utm=1", "https://vox.com/a/b"),
    ("https://www.vox.com/a", "https://vox.com/a"),
    ("https://vox.com/", None),
    ("http://vox.com/a", None),
    ("https://other.com/a", None),
    ("//cdn/x", "https://vox.com//cdn/x"),
    ("news/a", None),
    ("/a#top", "https://vox.com/a#top"),
    ("/videos/a", None),
    ("mailto:x@vox.com", None),
]
RULES_SCHEMA = "domain string, url_filter string, url_exclusion array<string>, pagin_filter string"


@pytest.mark.parametrize("href, expected", HREF_CASES)
def test_canonical_link(spark, href, expected):
    hrefs = spark.createDataFrame([("vox.com", "/", href)] * 2, "domain string, page string, href string")
    rules = spark.createDataFrame([("vox.com", ".", ["/videos/"], "")], RULES_SCHEMA)
    found = [r["url"] for r in links.canonical_links(hrefs, rules).collect()]
    assert found == ([expected] if expected else [])


def test_url_filter_sees_the_raw_href(spark, rows):
    hrefs = spark.createDataFrame(
        [("a.com", "/", "/x?y=keep"), ("a.com", "/", "/x")], "domain string, page string, href string"
    )
    rules = spark.createDataFrame([("a.com", "keep$", None, None)], RULES_SCHEMA)
    assert rows(links.canonical_links(hrefs, rules)) == [("a.com", "https://a.com/x")]


def test_site_listings(spark, rows):
    sites = spark.createDataFrame([("a.com", ["/", "/news"])], "domain string, pages array<string>")
    assert rows(links.site_listings(sites)) == [
        ("a.com", "/", "https://www.a.com"),
        ("a.com", "/news", "https://www.a.com/news"),
    ]


NEXT_CASES = [
    # by class: the last anchor that says next or more
    ('<a class="pg one next" href="/n?page=2"></a><a class="pg next" href="/n?page=3"></a>', "?page=3"),
    ('<a class="pg" title="more" href="https://www.a.com/news?p=9"></a>', "?p=9"),
    # by class, but none says next or more: no other try
    ('<a class="pg" href="?p=1"></a><a aria-label="pg" href="?p=2"></a>', None),
    # by aria-label, the first
    ('<a aria-label="pg" href="?p=4"></a><a aria-label="pg" href="?p=5"></a>', "?p=4"),
    # any tag by exact class, first string attribute with a question mark
    ('<div class="pg" data-a="x" data-b="/news?p=6" data-c="?p=7"></div>', "?p=6"),
    ('<a class="other" href="?p=8"></a>', None),
]


@pytest.mark.parametrize("html, suffix", NEXT_CASES)
def test_next_page(spark, html, suffix):
    pages = spark.createDataFrame([("https://www.a.com/news", html)], "url string, html string")
    listings = spark.createDataFrame(
        [("a.com", "/news", "https://www.a.com/news")], "domain string, page string, url string"
    )
    rules = spark.createDataFrame([("a.com", ".", [], "pg")], RULES_SCHEMA)
    found = [r["next_url"] for r in discover.listing_next_pages(pages, listings, rules).collect()]
    assert found == ([f"https://www.a.com/news{suffix}"] if suffix else [])


def test_relative_next_page_loses_the_listing_segment(spark):
    df = spark.createDataFrame(
        [("/world/news/page/2", "a.com/world/news"), ("https://a.com/world/page/2", "a.com/world")],
        "link string, listing string",
    )
    found = [r[0] for r in df.select(urls.next_page_suffix(F.col("link"), F.col("listing"))).collect()]
    assert found == ["/world/page/2", "/page/2"]


def test_hrefs_of_all_tags(spark):
    html = (
        "<!-- <a href='/no'> --><script>var t = '<a href=\"/no\">'</script>"
        "<h3 HREF='/a&amp;b'>x</h3><a title=it's href=/c>y</a><a href>z</a><p>not a href=\"/d\"</p>"
        '<link rel="next" href="/e"/>'
    )
    df = spark.createDataFrame([(html,), (None,)], "h string")
    assert [r[0] for r in df.select(markup.page_hrefs("h")).collect()] == [["/a&b", "/c", "", "/e"], []]


def test_found_links_and_errors(spark, rows):
    pages = spark.createDataFrame(
        [("https://www.a.com", '<a href="/1">x</a><a href="/1">y</a>'), ("https://www.b.com", '<a href="/2">')],
        "url string, html string",
    )
    listings = spark.createDataFrame(
        [("a.com", "/", "https://www.a.com"), ("b.com", "/", "https://www.b.com"), ("a.com", "/x", "https://www.a.com/x")],
        "domain string, page string, url string",
    )
    rules = spark.createDataFrame([("a.com", "/", [], ""), ("b.com", "(", [], "")], RULES_SCHEMA)
    assert rows(discover.found_links(pages, listings, rules)) == [("a.com", "https://a.com/1")]
    errors = discover.discover_errors(pages, listings, rules).collect()
    assert {(r["domain"], r["page"]) for r in errors} == {("b.com", None), ("a.com", "/x")}
    known = spark.createDataFrame([("https://a.com/1",)], "url string")
    none = known.where("false")
    assert rows(discover.discover(pages, listings, rules, none, known, none)) == []
    assert rows(discover.discover(pages, listings, rules, none, none, none)) == [("https://a.com/1",)]


BARE = """
import pickle, sys
assert not any("broadsheet" in m for m in sys.modules)
try:
    import broadsheet
    raise SystemExit("the package is there")
except ModuleNotFoundError:
    pass
import pyarrow as pa
for name, args, wanted in pickle.load(sys.stdin.buffer):
    found = pickle.loads(name)(*[pa.array(*a) for a in args]).to_pylist()
    assert found == wanted, found
"""


def test_udf_code_runs_where_the_package_is_not(tmp_path):
    """Functions are sent by value; a process without the package can run them."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from broadsheet.functions import markup as m
    from broadsheet.functions import patterns as p

    html = '<a class="pg next" href="/a?x">n</a><a href="/b">m</a><article class="k">' + "<p>t</p>" * 2 + "</article>"
    assert p.hit("^/a", "/a")  # a filled cache travels too
    calls = [
        (p.pattern_hit.func, [(["/a", None],), (["^/a", "x"],)], [True, False]),
        (p.any_pattern_hit.func, [(["/a"],), ([["b", "a"]],)], [True]),
        (p.first_error.func, [([["("], ["a"]],)], ["bad pattern '(': missing ), unterminated subpattern at position 0", None]),
        (m.wanted_hrefs.func, [([html],), (["^/"],), ([["b$"]],)], [["/a?x"]]),
        (m.page_hrefs.func, [([html],)], [["/a?x", "/b"]]),
    ]
    sent = [(cloudpickle.dumps(f), args, wanted) for f, args, wanted in calls]
    for f in (m.page_tags.func, m.article_container.func):
        sent.append((cloudpickle.dumps(f), [([html],), (["zz"],)], f(*[__import__("pyarrow").array(x) for x in ([html], ["zz"])]).to_pylist()))
    done = subprocess.run([sys.executable, "-c", BARE], input=pickle.dumps(sent), cwd=tmp_path, env={}, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()[-800:]


def test_links_take_one_python_node(spark):
    pages = spark.createDataFrame([("https://www.a.com", '<a href="/1">x</a>')], "url string, html string")
    listings = spark.createDataFrame([("a.com", "/", "https://www.a.com")], "domain string, page string, url string")
    rules = spark.createDataFrame([("a.com", "/", ["x"], "pg")], RULES_SCHEMA)
    for found in (discover.found_links(pages, listings, rules), discover.listing_next_pages(pages, listings, rules)):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


BAD = ["[", "(?P<n>/x", "(?P<n>/x)(?P<n>/y)"]


@pytest.mark.parametrize("bad", BAD)
def test_a_bad_rule_stays_with_its_site(spark, rows, bad):
    schema = "domain string, url_filter string, url_exclusion array<string>, div_filter string, pagin_filter string"
    listings = spark.createDataFrame(
        [(d, "/", f"https://www.{d}") for d in ("a.com", "b.com")], "domain string, page string, url string"
    )
    html = '<a class="pg next" href="/x?page=2">n</a>' + "<article>" + "<p>alpha</p>" * 7 + "</article>"
    pages = spark.createDataFrame([(1, "https://www.a.com", html), (2, "https://www.b.com", html)], "page_id long, url string, html string")
    for field in ("url_filter", "url_exclusion", "div_filter", "pagin_filter"):
        rule = {"url_filter": "(?P<n>/x)", "url_exclusion": [], "div_filter": None, "pagin_filter": "pg"}
        wrong = rule | {field: [bad] if field == "url_exclusion" else bad}
        rules = spark.createDataFrame([("a.com", *wrong.values()), ("b.com", *rule.values())], schema)
        errors = discover.discover_errors(pages, listings, rules).collect()
        assert [r["domain"] for r in errors] == ["a.com"]
        assert rows(discover.found_links(pages, listings, rules)) == [("b.com", "https://b.com/x")]
        assert [r["domain"] for r in discover.listing_next_pages(pages, listings, rules).collect()] == ["b.com"]
        sites = rules.select("domain", "div_filter", F.lit(None).cast("array<string>").alias("p_attr_exclusion"))
        found = {r["url"]: r for r in extraction.extract_articles(pages, sites).collect()}
        assert found["https://www.b.com"]["status"] == "stored"
        if field == "div_filter":
            assert found["https://www.a.com"]["reason"].startswith("bad pattern")


def test_a_listing_that_is_there_several_times_is_read_as_one(spark, rows, monkeypatch):
    html = '<a href="/one">1</a><a href="/two">2</a>'
    pages = spark.createDataFrame([(i, "https://www.a.com/p", html) for i in range(4)], "page_id long, url string, html string")
    listings = spark.createDataFrame([("a.com", "/p", "https://www.a.com/p")] * 4 + [(None, None, None)] * 2, "domain string, page string, url string")
    rules = spark.createDataFrame([("a.com", "^/", [])], "domain string, url_filter string, url_exclusion array<string>")
    assert rows(discover.found_links(pages, listings, rules)) == [("a.com", "https://a.com/one"), ("a.com", "https://a.com/two")]
    monkeypatch.setattr(discover, "own_links", lambda hrefs: hrefs)
    # Each landed copy is parsed once.
    assert discover.found_links(pages, listings, rules).count() == 8


@pytest.mark.parametrize(
    ("parse", "wanted"),
    [("page_hrefs", []), ("wanted_hrefs", ["/", []]), ("page_tags", ["x"]), ("article_container", ["x"])],
)
def test_a_batch_of_pages_is_not_held_as_strings(parse, wanted):
    pages = pa.array([None, *["<a href='/x'>x</a>" + "word " * 10_000] * 499, ""])
    function = getattr(markup, parse).func
    rules = [pa.array([w] * len(pages), pa.list_(pa.string()) if isinstance(w, list) else pa.string()) for w in wanted]
    tracemalloc.start()
    found = function(pages, *rules)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(pages) and len(function(pages[:0], *(r[:0] for r in rules))) == 0
    assert peak < pages.nbytes / 2
