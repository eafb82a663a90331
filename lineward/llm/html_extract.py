"""Main text of web pages by tree scoring.

A page is read into nodes and blocks of text. Parts that are never article text go first: by element
(menus, headers, footers, forms, scripts) and by the words of class, id and role (sidebars, notices,
adverts, comments), unless the part holds the article. Then every block gives points for its length and
its commas to the nodes above it, less with each level and less the more of it is link text. The node with
the most points and its siblings that are alike are the article; their blocks are the text, in page order. Of containers with equal points the outermost is taken; pages and blocks
that are repeated are each read by themselves, and an empty table gives an empty one.

Character references are decoded, white space inside a block is one space, blocks are joined by a line
feed. Null, empty and markup-only pages give an empty text. Unclosed, misnested and cut-off markup is read
as browsers do in the common cases. A page is read in one pass and never as a nested call, so deep pages
are safe; nothing is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

PAGES_AT_ONCE = 500

# Elements of the HTML standard by their role here; fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg annotation select button".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = set("nav header footer aside form menu dialog head".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What an opening tag closes when it stands open below the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class, id and role that name parts beside the article.
BESIDE = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar"
    " sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription social share sharing related recommended recommendations comment comments commentlist"
    " disqus replies reply respond pagination pager toolbar widget widgets login signup search form hidden"
    " complementary contentinfo toc".split()
)
ARTICLE_WORDS = set("article content entry post story text body main page prose".split())
# Reader comments may be longer than the article, and single ones may be article elements themselves.
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
STRONG_WORDS = set("article post story main".split())
# Behind these a name tells what stands next to the part, not what the part is.
LAYOUT_WORDS = set("with has no without".split())
# What a container hands on to the one above it, where that holds other text as well.
HANDED_ON = 0.5
SENTENCE_END = tuple(".!?\u2026\u3002\uff01\uff1f")

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "beside", "comments", "holds_main", "score", "size", "article_words", "holds_beside", "own")

    def __init__(self, tag: str, parent: int, words: set[str] = frozenset()):
        self.tag, self.parent = tag, parent
        self.beside = not words.isdisjoint(BESIDE)
        self.comments = not words.isdisjoint(COMMENT_WORDS)
        self.article_words = not words.isdisjoint(ARTICLE_WORDS)
        aside_article = tag == "article" and self.beside and words.isdisjoint(STRONG_WORDS)
        self.holds_main = tag in MAIN and not aside_article or tag == "h1"
        self.score = self.own = 0.0
        self.size = 0
        self.holds_beside = False


class Block:
    __slots__ = ("node", "text", "links", "size")

    def __init__(self, node: int, text: str, links: int, size: int):
        self.node, self.text, self.links, self.size = node, text, links, size


def _named_parts(attributes: str) -> set[str]:
    """The words of class, id and role; `hidden` for parts that are not shown."""
    found: set[str] = set()
    for name, double, single, bare in _NAMED.findall(attributes):
        name, value = name.lower(), double or single or bare
        if name in ("class", "id", "role"):
            for part in value.split():
                words = [w.lower() for w in _WORDS.findall(part)]
                found |= {w for before, w in zip(["", *words], words) if before not in LAYOUT_WORDS}
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            found.add("hidden")
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden")
    return found


def read_page(html: str) -> tuple[list[Node], list[Block]]:
    """The nodes and the blocks of text of a page, in page order."""
    nodes = [Node("", -1)]
    blocks: list[Block] = []
    open_nodes = [0]
    block_nodes = [0]
    block_depths = [0]
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open nodes of each tag
    parts: list[str] = []
    links = in_link = 0

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(block_nodes[-1], text, links, len(text)))
        parts, links = [], 0

    def close(depth: int) -> None:
        nonlocal in_link
        while len(open_nodes) > depth:
            node = open_nodes.pop()
            tag = nodes[node].tag
            depths[tag].pop()
            if tag in BLOCK:
                end_block()
                block_nodes.pop()
                block_depths.pop()
            elif tag == "a":
                in_link -= 1

    def add_text(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text.strip())

    position = 0
    while position < len(html):
        found = _TOKEN.search(html, position)
        if not found:
            add_text(html[position:])
            break
        add_text(html[position : found.start()])
        position = found.end()
        ending, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            # An inline end tag does not close the block around it.
            if depths[tag] and (tag in BLOCK or depths[tag][-1] > block_depths[-1]):
                close(depths[tag][-1])
            if tag == "p" or tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                until = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(html, position)
                position = until.end() if until else len(html)
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
            if nodes[block_nodes[-1]].tag == "p":
                close(block_depths[-1])
            heads, bounds = CLOSES.get(tag, ((), ()))
            bound = max((depths[name][-1] for name in bounds if depths[name]), default=0)
            above = [d[bisect_right(d, bound)] for d in (depths[name] for name in heads) if d and d[-1] > bound]
            if above:
                close(min(above))
        elif tag == "a" and in_link:
            close(depths["a"][-1])
        nodes.append(Node(tag, open_nodes[-1], _named_parts(attributes) if attributes.strip() else frozenset()))
        if attributes.rstrip().endswith("/"):
            continue
        depths[tag].append(len(open_nodes))
        open_nodes.append(len(nodes) - 1)
        if tag in BLOCK:
            block_nodes.append(len(nodes) - 1)
            block_depths.append(len(open_nodes) - 1)
        elif tag == "a":
            in_link += 1
    close(1)
    end_block()
    return nodes, blocks


def _points(block: Block) -> float:
    density = min(block.links / block.size, 1.0)
    return (1 + block.text.count(",") + min(block.size / 100, 10)) * (1 - density)


def main_text(html: str | None) -> str:
    """The article of a page as text; empty if there is none."""
    if not html:
        return ""
    nodes, blocks = read_page(html)
    for block in blocks:
        nodes[block.node].size += block.size
        nodes[block.node].own += _points(block)
    for node in reversed(nodes[1:]):
        nodes[node.parent].holds_main |= node.holds_main
        nodes[node.parent].size += node.size
        aside = node.beside or node.tag in NEVER_TEXT
        nodes[node.parent].holds_beside |= aside or node.holds_beside
        # Points of named parts stay with them: what is left above is the text beside which they stand.
        nodes[node.parent].own += 0.0 if node.beside and not node.holds_beside or node.tag in NEVER_TEXT else node.own
    dropped = [False] * len(nodes)
    for i, node in enumerate(nodes):
        if i:
            by_tag = node.tag in NEVER_TEXT and not (node.tag == "form" and node.holds_main)
            # A part that is named for the article too, and holds most of the text, is the article.
            is_most = node.article_words and not node.comments and 2 * node.size > nodes[0].size
            # So is one that stands around named parts, and holds most points outside them.
            is_layout = node.holds_beside and not node.comments and 2 * node.own > nodes[0].own > 0
            by_name = node.beside and not node.holds_main and not is_most and not is_layout
            dropped[i] = dropped[node.parent] or by_tag or by_name and node.tag not in ("html", "body")
    lists = _link_lists(nodes, blocks)
    kept = [b for b in blocks if not dropped[b.node] and b.node not in lists]
    if not kept:
        return ""
    sizes = [0] * len(nodes)
    for block in kept:
        sizes[block.node] += block.size
        if nodes[block.node].tag in HEADINGS:
            continue
        at = nodes[block.node].parent
        if nodes[block.node].tag not in ("p", "pre", "blockquote", "li", "td", "dd"):
            at = block.node  # text that stands in its container without an element of its own
        nodes[max(at, 0)].score += _points(block)
    for i in range(len(nodes) - 1, 0, -1):
        sizes[nodes[i].parent] += sizes[i]
    for i in range(len(nodes) - 1, 0, -1):
        # A wrapper of nothing else is no level, however often it is nested.
        above = nodes[i].parent
        nodes[above].score += nodes[i].score * (1 if sizes[above] == sizes[i] else HANDED_ON)
    for node in nodes:
        if node.tag in MAIN:
            node.score = node.score * 2 + 25
        elif node.article_words and node.tag not in ("html", "body"):
            node.score = node.score * 1.25
    best = max(range(1, len(nodes)), key=lambda i: (not dropped[i]) * nodes[i].score, default=0)
    if not best or nodes[best].score <= 0:
        return "\n".join(b.text for b in kept)
    chosen = {best} | _siblings(nodes, kept, best, dropped)
    inside = [False] * len(nodes)
    for i in range(1, len(nodes)):
        inside[i] = i in chosen or inside[nodes[i].parent]
    return "\n".join(b.text for b in kept if inside[b.node])


def _siblings(nodes: list[Node], blocks: list[Block], best: int, dropped: list[bool]) -> set[int]:
    """Siblings of the best node that belong to the article: as good a container, or a paragraph or heading."""
    parent, out = nodes[best].parent, set()
    branch = [0] * len(nodes)  # the child of the parent that a node lies in
    for i in range(1, len(nodes)):
        branch[i] = i if nodes[i].parent == parent else branch[nodes[i].parent]
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    prose: dict[int, bool] = {}
    for block in blocks:
        at = branch[block.node]
        if at > 0:
            size[at] = size.get(at, 0) + block.size
            links[at] = links.get(at, 0) + block.links
            is_prose = nodes[block.node].tag == "p" and (block.size >= 25 or block.text.endswith(SENTENCE_END))
            prose[at] = prose.get(at, True) and is_prose
    for at, n in size.items():
        if at == best or dropped[at]:
            continue
        density = links[at] / n
        alike = nodes[at].score >= max(10.0, 0.2 * nodes[best].score) and density < 0.3
        paragraph = prose[at] and density < 0.25
        heading = nodes[at].tag in ("h1", "h2") and at < best
        if alike or paragraph or heading:
            out.add(at)
    return out


def _link_lists(nodes: list[Node], blocks: list[Block]) -> set[int]:
    """Nodes of the blocks of lists that are nearly all links: menus without a name. Lists of an article are its own."""
    size: dict[int, list[int]] = {}
    owner: dict[int, int] = {}
    lists = [0] * len(nodes)
    for i in range(1, len(nodes)):
        if nodes[i].tag != "article":
            lists[i] = i if nodes[i].tag in ("ul", "ol") and lists[nodes[i].parent] >= 0 else lists[nodes[i].parent]
        else:
            lists[i] = -1
    for block in blocks:
        at = lists[block.node]
        if at > 0:
            owner[block.node] = at
            total = size.setdefault(at, [0, 0, 0])
            total[0] += block.size
            total[1] += block.links
            total[2] += 1
    menus = {at for at, (n, linked, items) in size.items() if items >= 2 and linked >= 0.8 * n}
    return {node for node, at in owner.items() if at in menus}


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text and n_chars, its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(first, PAGES_AT_ONCE)
                texts = [main_text(html.as_py()) for html in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    page_id, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {page_id}, url {url}, text string, n_chars long"
    )
