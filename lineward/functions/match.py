"""The two keyword matchers as Column expressions.

Noise-tolerant ("fuzzy") matching of a keyword ``c1 c2 .. cn`` on a lower-cased line: take the
shortest stretch that starts at the first ``c1`` and holds the other letters in order, go on behind
it, and accept the first stretch with at most ``max_insert`` letters in between in total. Stretches
never overlap, so a long stretch can swallow a short one; that is part of the definition.

Two observations keep this linear in the line:

* if no stretch starts at the first possible ``c1``, none starts at a later one either, so the
  pattern swallows the rest of the line instead of retrying every start;
* an accepted stretch has at most ``max_insert`` letters in each gap, so a line that fails the
  bounded pattern cannot hit. That pattern is tested once per text and once per line, for all
  keywords together, before any keyword is looked at on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.config import ScanConfig
from lineward.functions.text import let, lines_of, strip

HIT_TYPE = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("matched_text", T.StringType()),
    ]
)
HITS_TYPE = T.ArrayType(HIT_TYPE)

# Up to this many keywords a chain of substring searches beats one alternation.
_SUBSTRING_CHAIN = 16


def literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def _stretch_pattern(keyword: str) -> str:
    """Group 1 is the next stretch; the second branch ends the search."""
    first, rest = literal(keyword[0]), keyword[1:]
    if not rest:
        return f"({first})"
    body = first + "".join(f"[^{literal(c)}]*+{literal(c)}" for c in rest)
    return f"(?s)({body})|{first}.*+"


def bounded_pattern(keywords: Iterable[str], max_insert: int) -> str:
    """Any keyword with at most ``max_insert`` letters in each gap, within one line."""
    gap = f"[^\\n]{{0,{max_insert}}}?" if max_insert > 0 else ""
    tails: dict[str, list[str]] = {}
    for keyword in keywords:
        tail = "".join(gap + literal(c) for c in keyword[1:])
        tails.setdefault(literal(keyword[0]), []).append(tail)
    branches = "|".join(f"(?<={c})(?:{'|'.join(t)})" for c, t in tails.items())
    return f"[{''.join(tails)}](?:{branches})"


def has_charset(low: Column, keyword: str) -> Column:
    """Every letter of the keyword occurs somewhere in the (lower-cased) text."""
    found = F.lit(True)
    for char in dict.fromkeys(keyword.lower()):
        found = found & F.contains(low, F.lit(char))
    return found


def _any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _stretches(low: Column, keywords: Sequence[str], max_insert: int) -> Column:
    """Per keyword, in list order: its name, its size, and its accepted stretches, left to right."""
    tries = [
        F.struct(
            F.lit(k).alias("keyword"),
            F.lit(len(k)).alias("size"),
            F.when(
                low.rlike(bounded_pattern([k], max_insert)),
                F.regexp_extract_all(low, F.lit(_stretch_pattern(k)), F.lit(1)),
            ).alias("found"),
        )
        for k in keywords
    ]
    return F.transform(
        F.array(*tries),
        lambda t: F.struct(
            t["keyword"].alias("keyword"),
            t["size"].alias("size"),
            F.filter(
                t["found"], lambda m: F.length(m).between(t["size"], t["size"] + max_insert)
            ).alias("accepted"),
        ),
    )


def fuzzy_hit(low: Column, keywords: Sequence[str], max_insert: int) -> Column:
    """``struct(keyword, matched_text)`` of the first keyword, in list order, that hits; else null."""
    named = F.transform(
        _stretches(low, keywords, max_insert),
        lambda t: F.struct(
            t["keyword"].alias("keyword"), F.get(t["accepted"], F.lit(0)).alias("matched_text")
        ),
    )
    return F.get(F.filter(named, lambda n: n["matched_text"].isNotNull()), F.lit(0))


def exact_hit(line: Column, keywords: Sequence[str]) -> Column:
    """The occurrence that ends first, the longest on a tie; else null."""
    places = F.array(
        *[
            F.struct(
                (F.instr(line, F.lit(k)) + (len(k) - 1)).alias("end"),
                F.lit(-len(k)).alias("rank"),
                F.lit(k).alias("keyword"),
            )
            for k in dict.fromkeys(keywords)
        ]
    )
    best = F.array_min(F.filter(places, lambda p: p["end"] > -p["rank"] - 1))
    return let(
        best["keyword"],
        lambda k: F.when(
            k.isNotNull(), F.struct(k.alias("keyword"), k.alias("matched_text"))
        ),
    )


def line_hit(line: Column, config: ScanConfig) -> Column:
    """The hit of a single line under the configured matcher."""
    keywords = config.keyword_list
    if not keywords:
        return F.lit(None).cast("struct<keyword:string,matched_text:string>")
    if config.is_fuzzy:
        return let(F.lower(line), lambda low: fuzzy_hit(low, keywords, config.max_insert))
    return exact_hit(line, keywords)


def may_hit(text: Column, config: ScanConfig) -> Column:
    """A necessary condition on a text or line (lower-cased for the fuzzy matcher)."""
    keywords = config.keyword_list
    if config.is_fuzzy:
        return text.rlike(bounded_pattern(keywords, config.max_insert))
    if len(keywords) <= _SUBSTRING_CHAIN:
        return _any_of([F.contains(text, F.lit(k)) for k in keywords])
    return text.rlike(bounded_pattern(keywords, 0))


def text_may_hit(text: Column, config: ScanConfig) -> Column:
    """``may_hit`` for a whole text, behind cheaper tests: its size, and its letters.

    Nearly every text holds the plain Latin letters, so for such keywords the letter test only
    costs time. Letters of other scripts are rare enough to rule out most texts by substring search.
    """
    keywords = config.keyword_list
    possible = F.octet_length(text) >= min(len(k.encode()) for k in keywords)
    if config.is_fuzzy and all(any(ord(c) > 127 for c in k) for k in keywords):
        possible = possible & _any_of([has_charset(text, k) for k in keywords])
    return possible & may_hit(text, config)


def searched(text: Column, config: ScanConfig) -> Column:
    """The form of a text that the matcher looks at."""
    return F.lower(text) if config.is_fuzzy else text


def hits(text: Column, config: ScanConfig) -> Column:
    """All hits of a text as ``ARRAY<STRUCT<line, keyword, content, matched_text>>``.

    At most one hit per line, in line order, empty array when there is none. The array is built
    inside the row, so grouping hits by their text needs no shuffle.
    """
    keywords = config.keyword_list
    empty = F.array().cast(HITS_TYPE)
    if not keywords:
        return empty

    def judged(lines: Column) -> Column:
        numbered = F.transform(
            lines, lambda l, i: F.struct((i + 1).alias("line"), l.alias("text"))
        )
        candidates = F.filter(numbered, lambda c: may_hit(c["text"], config))

        def judge(c: Column) -> Column:
            hit = (
                fuzzy_hit(c["text"], keywords, config.max_insert)
                if config.is_fuzzy
                else exact_hit(c["text"], keywords)
            )
            return F.struct(c["line"].alias("line"), c["text"].alias("text"), hit.alias("hit"))

        return F.filter(F.transform(candidates, judge), lambda c: c["hit"].isNotNull())

    def report(found: Column, content_of) -> Column:
        return F.transform(
            found,
            lambda c: F.struct(
                c["line"].alias("line"),
                c["hit"]["keyword"].alias("keyword"),
                strip(content_of(c)).alias("content"),
                c["hit"]["matched_text"].alias("matched_text"),
            ),
        )

    def fuzzy(low: Column) -> Column:
        # The matcher works on the lower-cased line, the report quotes the original one.
        reported = let(
            lines_of(text),
            lambda raw: report(judged(lines_of(low)), lambda c: F.get(raw, c["line"] - 1)),
        )
        return F.when(text_may_hit(low, config), reported)

    if config.is_fuzzy:
        found = let(F.lower(text), fuzzy)
    else:
        found = F.when(text_may_hit(text, config), report(judged(lines_of(text)), lambda c: c["text"]))
    return F.coalesce(found, empty)


def inserts_needed(low: Column, keywords: Sequence[str], ceiling: int) -> Column:
    """Smallest noise budget, up to ``ceiling``, under which any keyword hits the line; else null."""

    needs = F.transform(
        _stretches(low, keywords, ceiling),
        lambda t: F.array_min(F.transform(t["accepted"], F.length)) - t["size"],
    )
    return F.array_min(needs)
