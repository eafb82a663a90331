"""Link and address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineward.functions.html import resolve_references, without_opaque
from lineward.functions.text import strip

# A link that contains one of these anywhere is noted but not followed.
SKIPPED_EXTENSIONS = (".zip", ".rar", ".7z", ".exe", ".msi", ".pdf", ".docx")

_ANCHOR_HREF = (
    r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
)
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def hrefs(html: Column) -> Column:
    """Targets of all anchors of a page, as written, stripped."""
    quoted = F.regexp_extract_all(without_opaque(html), F.lit(_ANCHOR_HREF), F.lit(1))
    return F.transform(
        quoted,
        lambda h: strip(resolve_references(F.regexp_replace(h, "^[\"']|[\"']$", ""))),
    )


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port and user part, as written."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def _needs_walk(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.\.?(?:/|$)") | path.contains("//")


def _walked(segments: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that ends in either names a folder."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda path, s: F.when(s == ".", path)
        .when(s == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))
        .otherwise(F.array_append(path, s)),
    )
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    walked = F.concat(F.array_join(kept, "/"), F.when(F.size(kept) > 0, folder).otherwise(F.lit("")))
    return F.when(walked.startswith("/"), walked).otherwise(F.concat(F.lit("/"), walked))


def _inner_filtered(segments: Column) -> Column:
    """Empty segments count at the ends of a joined path only."""
    last = F.size(segments)
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == last - 1))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against the address of its page, by the rules of the URL standard."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    rooted = F.when(
        _needs_walk(target), F.concat(origin, _walked(F.split(target, "/", -1)), rest)
    ).otherwise(F.concat(origin, href))
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), target)
    relative = F.when(
        _needs_walk(joined),
        F.concat(origin, _walked(_inner_filtered(F.split(joined, "/", -1))), rest),
    ).otherwise(F.concat(origin, joined, rest))
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), rooted)
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href))
        .otherwise(relative)
    )


def canonical_url(url: Column) -> Column:
    """Without fragment, empty query and trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"\?$", "")
    return F.rtrim(bare, F.lit("/"))


def same_site(url: Column, site: Column) -> Column:
    return (netloc(url) == site) & scheme(url).isin("http", "https")


def is_skipped(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for extension in SKIPPED_EXTENSIONS:
        out = out | F.contains(low, F.lit(extension))
    return out
