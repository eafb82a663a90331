import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.html import page_note, tokenized_text, with_html_text
from lineward.functions.urls import absolute_url, canonical_url, hrefs, is_skipped, same_site
from lineward.plans.web import scan_pages

PAGES = {
    "plain": ("<p>a<b>b</b> c</p>", "a\nb\nc"),
    "title": ("<!DOCTYPE html><html><head><title>T</title></head><body>x</body></html>", "T\nx"),
    "breaks": ("<div>\n 1<br>\n 2: <b>k</b>d<br/>3</div>", "1\n2:\nk\nd\n3"),
    "dropped": (
        "<nav>n</nav><header id=x>h</header>a<script>var s='</p>';</script><style>p{}</style>"
        "<footer>f</footer>b",
        "a\nb",
    ),
    "class is no element": ('<div class="nav">kept</div><navigation>k</navigation>', "kept\nk"),
    "comments": ("a<!-- <nav> --><!-- x -->b", "a\nb"),
    "comment in script": ("<script><!-- </script>a<!-- x -->b", "a\nb"),
    "references": ("&lt;a&gt; &amp;lt; &copy; &nbsp;x", "<a> &lt; © \xa0x"),
    "numeric reference": ("a&#20445;&#x5bc6;b", "a保密b"),
    "rare reference": ("a&Eacute;b &unknown; & c", "aÉb &unknown; & c"),
    "nested": ("<nav>1<nav>2</nav>3</nav>4", "4"),
    "unclosed": ("a<nav>b<p>c", "a"),
    "closed by parent": ("<div>a<nav>b</div>c", "a\nc"),
    "crossing": ("<header>a<nav>b</header>c</nav>d", "c\nd"),
    "bracket in attribute": ('<a title="x>y">t</a><a title=\'p>q\'>u</a>', "t\nu"),
    "empty": ("", ""),
    "only dropped": ("<script>x</script>", ""),
    "spaces": ("　<p>\xa0 a  </p>", "a"),
    "upper case": ("<NAV>n</NAV><SCRIPT>s</SCRIPT>a", "a"),
    "less than": ("1 < 2 <b>and</b> 3 > 2", "1 < 2\nand\n3 > 2"),
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(name, html) for name, (html, _) in PAGES.items()]
    df = spark.createDataFrame(rows, "name string, html string")
    out = with_html_text(df, "html", "text").withColumn("note", page_note(F.col("text")))
    return {r.name: r for r in out.collect()}


@pytest.mark.parametrize("name", PAGES)
def test_page_text(texts, name):
    html, expected = PAGES[name]
    assert texts[name].text == expected
    assert tokenized_text(html) == expected
    assert texts[name].note == ("" if expected else "无法读取页面内容")


def test_page_hits_count_text_nodes_as_lines(spark):
    page = "<p>第一行：<b>机密</b>清单<br>第三：无</p>"
    df = spark.createDataFrame([("u", page)], "url string, html string")
    row = scan_pages(df, ScanConfig()).first()
    assert [(h.line, h.keyword, h.content) for h in row.hits] == [(2, "机密", "机密")]


def test_versions_of_an_address_merge(spark):
    rows = [("u", "<p>秘密</p>"), ("u", "<p>x</p>"), ("v", "<p>y</p>")]
    df = spark.createDataFrame(rows, "url string, html string")
    once = sorted((r.url, len(r.hits)) for r in scan_pages(df, ScanConfig()).collect())
    again = sorted(
        (r.url, len(r.hits)) for r in scan_pages(df.orderBy(F.desc("html")), ScanConfig()).collect()
    )
    assert [u for u, _ in once] == ["u", "v"] and once == again


LINKS = [
    "about.html",
    "/root/x?q=1#f",
    "//other.org/p",
    "https://Example.com:8080/a/",
    "../up/./x",
    "a/../b",
    "?only=query",
    "#frag",
    "",
    "mailto:a@b.c",
    "javascript:void(0)",
    "dir//double",
    "/a/../../b",
    " spaced ",
    "http:relative",
    "a:b/c",
    "资料/保密.html",
    "..",
    ".",
    "../",
    "../../..",
    "./",
    "a//b/../c//d.html?x=../y#z/..",
    "/..",
    "/.",
    "/a/./b//c/..",
    "/a//b",
    "...",
    "a/.../b",
    ".hidden",
    "..x/y",
]
BASES = [
    "http://site.com",
    "http://site.com/",
    "http://site.com/d/e.html?x=/y#z",
    "https://site.com/d/",
    "http://site.com/a/b//c/d",
    "http://site.com/a/../b/c",
]


def test_links_resolve_as_in_the_standard_library(spark):
    from urllib.parse import urljoin

    rows = [(b, h.strip()) for b in BASES for h in LINKS if h != "http:relative"]
    df = spark.createDataFrame(rows, "base string, href string")
    got = df.select("base", "href", absolute_url(F.col("base"), F.col("href")).alias("u")).collect()
    for r in got:
        assert r.u == urljoin(r.base, r.href), (r.base, r.href)


def test_anchor_targets(spark):
    html = (
        "<a href='one.html'>1</a><A class=x HREF=\"two.html?a=1&amp;b=2\">2</A><a href=three>3</a>"
        "<a name=n>no</a><a data-href='no'>no</a><!-- <a href='no'>no</a> -->"
        "<script>'<a href=\"no\">'</script><abbr href='no'>no</abbr><a\nhref = ' four '>4</a>"
    )
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(hrefs(F.col("html")).alias("h")).first().h == [
        "one.html",
        "two.html?a=1&b=2",
        "three",
        "four",
    ]


def test_addresses(spark):
    rows = ["http://a.b/c/#x", "http://a.b/", "http://a.b/c?", "http://a.b:80/c//", "ftp://a.b/x.PDF"]
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    url = F.col("u")
    got = df.select(
        canonical_url(url).alias("c"), same_site(url, F.lit("a.b")).alias("s"), is_skipped(url).alias("k")
    ).collect()
    assert [r.c for r in got] == ["http://a.b/c", "http://a.b", "http://a.b/c", "http://a.b:80/c", "ftp://a.b/x.PDF"]
    assert [r.s for r in got] == [True, True, True, False, False]
    assert [r.k for r in got] == [False, False, False, False, True]
