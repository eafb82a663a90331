"""Visible text of an HTML page.

The rule: drop the subtrees of a few elements, collect the remaining text nodes, strip each, drop
the empty ones and put each on a line of its own. Comments, doctypes and processing instructions
carry no text; a title does.

Ordinary pages go through a chain of regular expressions inside the JVM. Pages that this chain cannot
be trusted with (nested or unclosed dropped elements, rare character references, ``>`` in an attribute)
are found by three tests and go through the tokenizer of the standard library in an Arrow function;
for all other pages that function receives null.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.functions.text import STRIP_CHARS, strip

# Elements whose whole subtree is ignored.
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "header")

# Elements whose text is not page text (templates, ruby annotations).
_SILENT_ELEMENTS = ("template", "rt", "rp")

# Elements without end tag, those of the HTML standard and the obsolete ones its parsing rules name.
_VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)

# Character references resolved in the JVM; `&amp;` must stay last.
_REFERENCES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\xa0",
    "copy": "©",
    "reg": "®",
    "middot": "·",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "laquo": "«",
    "raquo": "»",
    "amp": "&",
}

# A noncharacter stands for "a tag was here".
_BREAK = "\ufdd0"

_OPAQUE = (
    r"(?is)<!--.*?-->"
    r"|<script(?:[\s/][^>]*)?>.*?</script\s*>"
    r"|<style(?:[\s/][^>]*)?>.*?</style\s*>"
)
_TAG = r"(?s)</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>"
_LEFTOVER = (
    r"(?i)</?(?:" + "|".join(DROPPED_ELEMENTS + _SILENT_ELEMENTS) + r")[\s/>]|<!--|<!\[CDATA\["
)
_SPLIT_ATTRIBUTE = r"""<[a-zA-Z][^>]*=\s*(?:"[^">]*|'[^'>]*)>"""
_RARE_REFERENCE = r"&(?!(?:" + "|".join(_REFERENCES) + r");)[#a-zA-Z]"


def resolve_references(col: Column) -> Column:
    for name, char in _REFERENCES.items():
        col = F.replace(col, F.lit(f"&{name};"), F.lit(char))
    return col


def without_opaque(html: Column) -> Column:
    """The page without comments, scripts and style sheets, in which ``<`` may mean anything."""
    return F.regexp_replace(html, _OPAQUE, _BREAK)


def _without_dropped(html: Column) -> Column:
    for name in ("nav", "footer", "header"):
        html = F.regexp_replace(
            html, rf"(?is)<{name}(?:[\s/][^>]*)?>.*?</{name}\s*>", _BREAK
        )
    return html


def _needs_tokenizer(pruned: Column) -> Column:
    return (
        pruned.rlike(_LEFTOVER) | pruned.rlike(_SPLIT_ATTRIBUTE) | pruned.rlike(_RARE_REFERENCE)
    )


def _text_nodes(pruned: Column) -> Column:
    bare = resolve_references(F.regexp_replace(pruned, _TAG, _BREAK))
    nodes = F.transform(F.split(bare, _BREAK, -1), strip)
    return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")


class _TextNodes(HTMLParser):
    """Collects text nodes; an end tag closes everything opened since its start tag."""

    ignored = frozenset(DROPPED_ELEMENTS + _SILENT_ELEMENTS)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[str] = []
        self.pending: list[str] = []

    def end_node(self):
        node = "".join(self.pending).strip(STRIP_CHARS)
        self.pending.clear()
        if node:
            self.nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in _VOID_ELEMENTS:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.ignored.isdisjoint(self.open):
            self.pending.append(data)

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_node()
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self.end_node()


def tokenized_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser.end_node()
    return "\n".join(parser.nodes)


@F.pandas_udf(T.StringType())
def _tokenizer_text(pages: pd.Series) -> pd.Series:
    return pages.map(tokenized_text, na_action="ignore")


def html_text(html: Column) -> Column:
    """Text of an ordinary page, inside the JVM only."""
    return _text_nodes(_without_dropped(without_opaque(html)))


def with_html_text(df: DataFrame, html: str, text: str) -> DataFrame:
    """Add column ``text`` with the visible text of column ``html``, exact for every page."""
    pruned = df.withColumn("_pruned", _without_dropped(without_opaque(F.col(html))))
    tested = pruned.withColumn("_odd", _needs_tokenizer(F.col("_pruned")))
    tokenized = tested.withColumn(
        text,
        F.when(F.col("_odd"), _tokenizer_text(F.when(F.col("_odd"), F.col(html)))).otherwise(
            F.when(~F.col("_odd"), _text_nodes(F.col("_pruned")))
        ),
    )
    return tokenized.drop("_pruned", "_odd")


# Fixed value: the note on a page that yields no text.
NO_PAGE_TEXT = "无法读取页面内容"


def page_note(text: Column) -> Column:
    return F.when(text == "", F.lit(NO_PAGE_TEXT)).otherwise(F.lit(""))
