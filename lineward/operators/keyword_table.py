"""Scanning with a keyword list that arrives as a table and may be long.

Every keyword is filed under an anchor: a few of its letters that must stand in any line it hits. Of all
anchors a keyword could have, it gets those that are rarest in a sample of the texts. A line lists the
anchors it holds, each once, and only the ones in use; these meet the keywords in a join, and each pair is checked on
the line. Nothing is dropped: a keyword can only hit where its anchor is listed.

* A keyword looked for exactly has one anchor, up to three letters of it.
* With up to ``n`` letters of noise, at least one of any ``n + 1`` neighbouring pairs of its letters stands
  together in the line, so it has that many pairs as anchors. A keyword with fewer pairs has one letter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.match import bounded_pattern, literal
from lineward.functions.text import let, lines_of, strip
from lineward.operators.scan import numbered_lines
from lineward.session import stored

# Letters of an anchor at most.
ANCHOR_LETTERS = 3
# Texts, and letters of each, in which the frequency of anchors is measured. It decides how fast a scan
# is, never what it finds.
SAMPLE_TEXTS = 50
SAMPLE_LETTERS = 2_000
# Up to so many anchors are one pattern.
PATTERN_ANCHORS = 2_000
# So many keywords are tried first on a line, to see how much of it needs to be searched.
LIKELY_KEYWORDS = 200
# Slots of the filter that tells which anchors are in use, a byte each.
SLOTS = 1 << 17
# A part of the keyword table up to this size, as measured, is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def _letters(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))


def _windows(col: Column, letters: int) -> Column:
    """The distinct runs of up to ``letters`` letters, one from every place."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{1,{letters}}}))"), F.lit(1)))


def _frequencies(df: DataFrame, text: str, config: ScanConfig) -> DataFrame:
    """``(anchor, lines)``: in how many sampled lines each possible anchor is."""
    sampled = df.select(F.left(F.col(text), F.lit(SAMPLE_LETTERS)).alias("text")).limit(SAMPLE_TEXTS)
    lines = sampled.select(F.explode(lines_of(F.col("text"))).alias("content"))
    searched = F.lower("content") if config.is_fuzzy else F.col("content")
    sizes = F.array(*[F.lit(n) for n in range(1, ANCHOR_LETTERS + 1)])
    grams = F.flatten(
        F.transform(
            sizes,
            lambda n: F.array_distinct(
                F.transform(_windows(searched, ANCHOR_LETTERS), lambda w: F.left(w, n))
            ),
        )
    )
    return lines.select(F.explode(grams).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("lines"))


def _with_patterns(keywords: DataFrame) -> DataFrame:
    """The letters of each keyword, and the pattern of its stretches (see ``functions.match``)."""
    quoted = F.transform(
        _letters(F.col("keyword")),
        lambda c: F.regexp_replace(c, r"([\x00-\x7f&&[^A-Za-z0-9]])", r"\\$1"),
    )
    kw = keywords.withColumn("_quoted", quoted)
    first = F.element_at("_quoted", 1)
    rest = F.transform(
        F.slice("_quoted", F.lit(2), F.size("_quoted")),
        lambda c: F.concat(F.lit("[^"), c, F.lit("]*+"), c),
    )
    stretch = F.concat(
        F.lit("(?s)("), first, F.array_join(rest, ""), F.lit(")|"), first, F.lit(".*+")
    )
    return kw.select(
        "*",
        F.when(F.size("_quoted") > 1, stretch)
        .otherwise(F.concat(F.lit("("), first, F.lit(")")))
        .alias("stretch"),
        F.array_distinct(_letters(F.col("keyword"))).alias("letters"),
    ).drop("_quoted")


def anchored(keywords: DataFrame, frequencies: DataFrame, config: ScanConfig) -> DataFrame:
    """``(ord, keyword, lines, anchor, size)``, one row for each anchor of a keyword, written."""
    kw = (
        keywords.where(F.length("keyword") > 0).groupBy("keyword").agg(F.min("ord").alias("ord"))
    )
    letters = F.length("keyword")
    if config.is_fuzzy:
        paired = letters >= config.max_insert + 2
        size, picks = F.when(paired, 2).otherwise(1), F.when(paired, config.max_insert + 1).otherwise(1)
    else:
        size, picks = F.least(letters, F.lit(ANCHOR_LETTERS)), F.lit(1)
    places = F.transform(
        F.sequence(F.lit(1), letters - size + 1), lambda i: F.substring(F.col("keyword"), i, size)
    )
    possible = kw.select("keyword", "ord", picks.alias("picks"), F.posexplode(places).alias("at", "anchor"))
    rated = possible.join(frequencies, "anchor", "left")
    rarest = F.array_sort(
        F.collect_list(F.struct(F.coalesce("lines", F.lit(0)).alias("lines"), "at", "anchor"))
    )
    chosen = rated.groupBy("keyword", "ord", "picks").agg(rarest.alias("rarest"))
    each = F.explode(F.array_distinct(F.slice("rarest", F.lit(1), F.col("picks"))["anchor"]))
    filed = chosen.select("ord", "keyword", F.get("rarest", F.lit(0))["lines"].alias("lines"), each.alias("anchor"))
    filed = filed.withColumn("size", F.length("anchor"))
    return stored(_with_patterns(filed) if config.is_fuzzy else filed, "anchors")


def _slot(anchor: Column) -> Column:
    return F.pmod(F.xxhash64(anchor), F.lit(SLOTS)).cast("int")


def _anchor_pattern(anchors: Sequence[str]) -> str:
    """Matches, without taking it, any of some anchors of one length."""

    def tree(tails: Sequence[str]) -> str:
        if len(tails[0]) == 1:
            return f"[{''.join(map(literal, tails))}]"
        heads: dict[str, list[str]] = {}
        for tail in tails:
            heads.setdefault(tail[0], []).append(tail[1:])
        return "(?:" + "|".join(literal(h) + tree(t) for h, t in heads.items()) + ")"

    firsts = "".join(literal(c) for c in dict.fromkeys(a[0] for a in anchors))
    return f"(?s)(?=[{firsts}])(?=({tree(anchors)}))"


def _listed(searched: Column, kw: DataFrame) -> Column:
    """The distinct anchors of a line that are in use, and maybe some that are not.

    Few anchors are one pattern. Of many, the driver sees at most SLOTS numbers of slots, and a line's runs of
    letters are looked up there.
    """
    few = kw.select("size", "anchor").distinct().limit(PATTERN_ANCHORS + 1).collect()
    if not few:
        return F.array().cast("array<string>")
    sizes = sorted({r["size"] for r in few})
    if len(few) <= PATTERN_ANCHORS:
        of = {n: sorted(r["anchor"] for r in few if r["size"] == n) for n in sizes}
        each = [F.regexp_extract_all(searched, F.lit(_anchor_pattern(of[n])), F.lit(1)) for n in sizes]
        return F.array_distinct(F.concat(*each))
    used = kw.select("size", _slot(F.col("anchor")).alias("slot")).distinct().collect()
    sizes = sorted({r["size"] for r in used})
    filters = {n: bytearray(SLOTS) for n in sizes}
    for row in used:
        filters[row["size"]][row["slot"]] = 1

    def in_use(grams: Column, size: int) -> Column:
        one = F.lit(bytearray(b"\x01"))
        return F.filter(grams, lambda g: F.substring(F.lit(filters[size]), _slot(g) + 1, F.lit(1)) == one)

    def begins(windows: Column, size: int) -> Column:
        return F.array_distinct(F.transform(windows, lambda w: F.left(w, F.lit(size))))

    def of_all_sizes(windows: Column) -> Column:
        return F.concat(*[in_use(windows if n == sizes[-1] else begins(windows, n), n) for n in sizes])

    return let(_windows(searched, sizes[-1]), of_all_sizes)


def _up_to_a_hit(content: Column, kw: DataFrame) -> Column:
    """The line up to the end of an exact hit, if one of the keywords that are likely to hit is in it.

    What ends later cannot be the first to end, so the rest of the line need not be looked at. Which keywords
    are tried here decides nothing else.
    """
    likely = kw.orderBy(F.desc("lines"), "keyword").limit(LIKELY_KEYWORDS).collect()
    if not likely:
        return content
    pattern = bounded_pattern([r["keyword"] for r in likely], 0)

    def cut(found: Column) -> Column:
        end = F.instr(content, found) + F.length(found) - 1
        return F.when(found == "", content).otherwise(F.left(content, end))

    return let(F.regexp_extract(content, pattern, 0), cut)


def _exact_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that hit, with the end of the first occurrence and the length: the best one is the least."""
    placed = pairs.withColumn("at", F.instr(F.col("searched"), F.col("keyword"))).where("at > 0")
    rank = F.struct(
        (F.col("at") + F.length("keyword") - 1).alias("end"),
        (-F.length("keyword")).alias("longest"),
        "keyword",
        F.col("keyword").alias("matched_text"),
    )
    return placed.withColumn("best", rank)


def _fuzzy_pairs(pairs: DataFrame, max_insert: int) -> DataFrame:
    """Pairs of which a stretch is accepted; the best keyword is the first in list order."""
    size = F.length("keyword")
    stretches = F.filter(
        F.regexp_extract_all(F.col("searched"), F.col("stretch"), F.lit(1)),
        lambda m: F.length(m).between(size, size + max_insert),
    )
    possible = F.forall("letters", lambda c: F.contains(F.col("searched"), c))
    matched = pairs.withColumn("matched_text", F.when(possible, F.get(stretches, F.lit(0))))
    best = F.struct("ord", "keyword", "matched_text")
    return matched.where(F.col("matched_text").isNotNull()).withColumn("best", best)


def join_keywords(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    keywords: DataFrame,
    config: ScanConfig,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hits ``(keys..., line, keyword, content, matched_text)`` for a keyword table ``(ord, keyword)``.

    ``config`` gives the algorithm and the noise budget. Keywords are sent to the lines, which are never
    shuffled: in one part if the table's measured size is within ``broadcast_bytes``, else in as many parts
    as it takes, each with a scan of its own. What the parts find of a line is merged.
    """
    kw = anchored(keywords, _frequencies(df, text, config), config)
    width = sum((F.octet_length(F.col(c).cast("string")) for c in kw.columns), F.lit(64))
    size = kw.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-size // max(broadcast_bytes, 1)))
    whole = numbered_lines(df, keys, text).where(F.col("content") != "")

    def found_by(part: DataFrame) -> DataFrame:
        searched = F.lower("content") if config.is_fuzzy else _up_to_a_hit(F.col("content"), part)
        lines = whole.withColumn("searched", searched)
        listed = lines.withColumn("anchor", F.explode(_listed(F.col("searched"), part)))
        pairs = listed.join(F.broadcast(part), "anchor")
        judged = _fuzzy_pairs(pairs, config.max_insert) if config.is_fuzzy else _exact_pairs(pairs)
        return judged.select(*keys, "line", "best", "content")

    each = [found_by(kw.where(F.pmod(F.hash("keyword"), F.lit(parts)) == i)) for i in range(parts)]
    merged = reduce(DataFrame.unionByName, each).groupBy(*keys, "line")
    best = merged.agg(F.min("best").alias("best"), F.any_value("content").alias("content"))
    content = strip(F.col("content")).alias("content")
    return best.select(*keys, "line", "best.keyword", content, "best.matched_text")


def scan_keyword_table(
    df: DataFrame, keys: Sequence[str], text: str, keywords: DataFrame, config: ScanConfig
) -> DataFrame:
    """The scan of ``df`` with a keyword table of any length, see ``join_keywords``."""
    return join_keywords(df, keys, text, keywords.select("ord", "keyword"), config)
