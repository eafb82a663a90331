"""Stored web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per address: of several versions always the same one, that of the smallest MD5."""
    return pages.groupBy("url").agg(F.min_by("html", F.md5("html")).alias("html"))
