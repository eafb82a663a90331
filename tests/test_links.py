import pytest

from lineward.operators.links import (
    extract_links,
    frontier,
    reachable,
    site_links,
    site_seeds,
    site_sizes,
)

SITE = {
    "http://s.com/": '<a href="about.html">a</a><a href="/docs">d</a><a href="http://x.org/">x</a>',
    "http://s.com/about.html": '<a href="/">home</a><a href="missing.html">m</a>',
    "http://s.com/docs": '<a href="files/plan.pdf">p</a><a href="files/notes.txt">n</a>',
    "http://s.com/files/notes.txt": '<a href="/deep/1">1</a>',
    "http://s.com/deep/1": '<a href="2">2</a><a href="#top">t</a>',
    "http://s.com/deep/2": '<a href="/deep/1/">1</a>',
    "http://s.com/files/plan.pdf": '<a href="/hidden">h</a>',
    "http://t.com/a": '<a href="b">b</a><a href="http://s.com/">s</a>',
    "http://t.com/b": "",
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(SITE.items()), "url string, html string").cache()


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_search_goes_level_by_level(spark, pages):
    got = {r.url: r.depth for r in reachable(pages, seeds(spark, "http://s.com")).collect()}
    assert got == {
        "http://s.com": 0,
        "http://s.com/about.html": 1,
        "http://s.com/docs": 1,
        "http://s.com/missing.html": 2,
        "http://s.com/files/plan.pdf": 2,
        "http://s.com/files/notes.txt": 2,
        "http://s.com/deep/1": 3,
        "http://s.com/deep/2": 4,
    }


def test_sizes_of_sites(spark, pages):
    found = reachable(pages, seeds(spark, "http://s.com", "http://t.com/a"))
    got = {(r.site, r.depth): r.addresses for r in site_sizes(found).collect()}
    assert got["s.com", 0] == 1 and got["s.com", 1] == 2 and got["s.com", 2] == 3
    assert got["t.com", 0] == got["t.com", 1] == 1


def test_frontier_is_what_is_new(spark, pages):
    visited = seeds(spark, *[u.rstrip("/") for u in SITE])
    got = {r.link: r.skipped for r in frontier(site_links(pages), visited).collect()}
    assert got == {"http://s.com/missing.html": False, "http://s.com/hidden": False}


def test_links_keep_their_order_of_writing_and_foreign_sites(pages):
    got = [(r.href, r.link) for r in extract_links(pages.where("url = 'http://s.com/'")).collect()]
    assert got == [
        ("about.html", "http://s.com/about.html"),
        ("/docs", "http://s.com/docs"),
        ("http://x.org/", "http://x.org/"),
    ]


def test_seeds(pages):
    got = {(r.site, r.url) for r in site_seeds(pages).collect()}
    assert got == {("s.com", "http://s.com"), ("t.com", "http://t.com/a")}


def test_many_levels_merge(spark):
    chain = {f"http://c.com/{i}": f'<a href="/{i + 1}">n</a>' for i in range(14)}
    df = spark.createDataFrame(list(chain.items()), "url string, html string")
    got = {r.url: r.depth for r in reachable(df, seeds(spark, "http://c.com/0")).collect()}
    assert got == {f"http://c.com/{i}": i for i in range(15)}
