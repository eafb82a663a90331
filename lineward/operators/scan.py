"""Scanning texts: the table-level form of the matchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.match import hits, inserts_needed, text_may_hit
from lineward.functions.text import let, lines_of


def numbered_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``(keys..., line, content)``: every line with its number from 1."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("pos", "content")).select(
        *keys, (F.col("pos") + 1).alias("line"), "content"
    )


def scan_targets(
    df: DataFrame, keys: Sequence[str], text: str, config: ScanConfig, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per target with all its hits in an array: ``(keys..., keep..., hits)``.

    A projection: each row is scanned where it is read, and no shuffle follows.
    """
    return df.select(*keys, *keep, hits(F.col(text), config).alias("hits"))


def flat_hits(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., line, keyword, content, matched_text)``, one row per hit.

    The outer form with a filter behind it: the inner one makes the optimizer test the array for
    emptiness first, which would run the whole scan a second time.
    """
    return targets.select(*keys, F.inline_outer("hits")).where(F.col("line").isNotNull())


def scan_text(df: DataFrame, keys: Sequence[str], text: str, config: ScanConfig) -> DataFrame:
    """One row per hit of a text column."""
    return flat_hits(scan_targets(df, keys, text, config), keys)


def scan_all(df: DataFrame, keys: Sequence[str], text: str, config: ScanConfig) -> DataFrame:
    """``(keys..., hits)`` with every keyword of every line, not only the first found on it.

    Each keyword is looked for on its own, so none hides another; hits are in the order of lines, then
    of keywords.
    """
    each = [
        F.transform(
            hits(F.col(text), ScanConfig((keyword,), config.algorithm, config.max_insert)),
            lambda h, place=place: F.struct(
                h["line"].alias("line"), F.lit(place).alias("place"), h.alias("hit")
            ),
        )
        for place, keyword in enumerate(config.keyword_list)
    ]
    if not each:
        return scan_targets(df, keys, text, config)
    ordered = F.array_sort(F.concat(*each))
    return df.select(*keys, F.transform(ordered, lambda o: o["hit"]).alias("hits"))


def full_check(df: DataFrame, keys: Sequence[str], text: str, config: ScanConfig) -> DataFrame:
    """Hits of each target and the number of distinct lines they are on."""
    return scan_targets(df, keys, text, config).select(
        *keys,
        "hits",
        F.size(F.array_distinct(F.transform("hits", lambda h: h["line"]))).alias(
            "total_danger_lines"
        ),
    )


def insert_sweep(
    df: DataFrame, text: str, config: ScanConfig, low: int = 0, high: int = 10
) -> DataFrame:
    """Lines that hit under each noise budget from ``low`` to ``high``: ``(max_insert, lines)``.

    The budget a line needs is computed once; a line that needs ``n`` counts for all budgets from
    ``n`` on. The counts per needed budget are at most eleven rows before they are spread.
    """
    keywords = config.keyword_list
    widest = ScanConfig(keywords, "regex", high)

    def needs(lowered: Column) -> Column:
        per_line = F.transform(
            lines_of(lowered), lambda l: inserts_needed(l, keywords, high)
        )
        return F.when(text_may_hit(lowered, widest), F.filter(per_line, lambda n: n.isNotNull()))

    needed = df.select(F.explode(let(F.lower(F.col(text)), needs)).alias("need"))
    counted = needed.groupBy("need").agg(F.count("*").alias("lines"))
    return (
        counted.select(
            F.explode(F.sequence(F.greatest("need", F.lit(low)), F.lit(high))).alias("max_insert"),
            "lines",
        )
        .groupBy("max_insert")
        .agg(F.sum("lines").alias("lines"))
    )
