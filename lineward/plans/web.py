"""Stored pages to hits and report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.html import page_note, with_html_text
from lineward.functions.match import hits
from lineward.operators.report import target_report
from lineward.operators.store import Scan, known_results, scan_with_store, with_fingerprint


def scan_pages(pages: DataFrame, config: ScanConfig) -> DataFrame:
    """``(url, hits, note)`` for every distinct address.

    Pages are scanned where they are read, and versions of an address are merged afterwards: that
    way only hits go through the shuffle, never page sources. An address has the hits of all its
    distinct versions, version by version, and a note only if all of them have it.
    """
    texts = with_html_text(pages.select("url", "html"), "html", "text")
    scanned = texts.select(
        "url",
        F.md5("html").alias("version"),
        hits(F.col("text"), config).alias("hits"),
        page_note(F.col("text")).alias("note"),
    )
    versions = F.array_sort(F.collect_set(F.struct("version", "hits", "note"))).alias("versions")
    return scanned.groupBy("url").agg(versions).select(
        "url",
        F.flatten("versions.hits").alias("hits"),
        F.array_min("versions.note").alias("note"),
    )


def page_texts_scan(config: ScanConfig) -> Scan:
    """The scan of page sources in a column ``html``."""

    def scan(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        texts = with_html_text(df.select(*keep, "html"), "html", "text")
        return texts.select(
            *keep,
            hits(F.col("text"), config).alias("hits"),
            page_note(F.col("text")).alias("note"),
            F.lit("").alias("file_type"),
        )

    return scan


def scan_new_pages(
    pages: DataFrame, store: DataFrame, config: ScanConfig, as_of: datetime
) -> DataFrame:
    """``(url, fp, hits, note, reused)``: stored results under today's addresses, the rest scanned.

    One row for each address and distinct content of it.

    The fingerprint covers the page source, so an unchanged page is not even reduced to text.
    """
    rows = with_fingerprint(pages.select("url", "html"), "html", config)
    known = known_results(store, "web", as_of)
    results = scan_with_store(rows, ["url"], "html", known, page_texts_scan(config))
    one = F.any_value(F.struct("hits", "note", "reused")).alias("one")
    return results.groupBy("url", "fp").agg(one).select("url", "fp", "one.*")


def page_report(results: DataFrame, checked_at: str, fmt: str = "md") -> DataFrame:
    return target_report(results, "web", "url", "网页爬取检查", checked_at, fmt)
