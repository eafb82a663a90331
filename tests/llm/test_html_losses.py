"""Article text that layout names, nesting and link lists must not hide; pages that never close their tags."""

import time

import pytest

from lineward.llm.html_extract import main_text

LONG = ["The first paragraph has some words, and a comma.", "The second one goes on, as they do.", "A third, to end it all."]
PAGES = {
    "nested": ("<body>" + "".join("<div>" * 8 + f"<p>{t}</p>" + "</div>" * 8 for t in LONG) + "</body>", LONG),
    "layout": (
        f"<div class='layout with-sidebar'><p>{LONG[0]}</p><p>{LONG[1]}</p><div class='sidebar'><p>Beside it.</p></div></div>",
        LONG[:2],
    ),
    "wrapper": (
        f"<div class='widget'><p>{LONG[0]}</p><p>{LONG[1]}</p><div class='sidebar'><p>Beside it.</p></div></div>",
        LONG[:2],
    ),
    "sources": (
        f"<article><p>{LONG[0]}</p><ul><li><a href='a'>Source A</a></li><li><a href='b'>Source B</a></li></ul></article>",
        [LONG[0], "Source A", "Source B"],
    ),
    "menu": (
        f"<ul><li><a href='a'>Home</a></li><li><a href='b'>News</a></li></ul><div><p>{LONG[0]}</p><p>{LONG[1]}</p></div>",
        LONG[:2],
    ),
    "closing": (f"<body><div><p>{LONG[0]}</p><p>{LONG[1]}</p></div><div><p>That is all.</p></div></body>", [*LONG[:2], "That is all."]),
    "formula": ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, as before.</p></article>", ["Let x=2 hold, as before."]),
    "notice": (f"<div class='notice'><p>{LONG[0]}</p></div><div><p>{LONG[1]}</p></div>", [LONG[1]]),
    "sidebar": (f"<div class='sidebar'><p>{LONG[0]}</p></div><div class='no-sidebar'><p>{LONG[1]}</p></div>", [LONG[1]]),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_is_kept(name):
    page, want = PAGES[name]
    assert main_text(page) == "\n".join(want)


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 100_000 + "text" + "</i>" * 100_000,
        "<i><div>" + "<b>" * 100_000 + "text" + "</i>" * 100_000,
        "<span>" * 100_000 + "<p>text, and more" * 100_000,
        "<div>" * 100_000 + "<p>text",
        "<ul>" + "<b><li>text" * 50_000,
    ],
)
def test_unclosed_tags_cost_no_more(page):
    started = time.process_time()
    assert "text" in main_text(page)
    assert time.process_time() - started < 5
