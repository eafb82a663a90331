"""Writing hits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Report formats and their media types; Markdown is the default.
REPORT_MEDIA_TYPES = {"md": "text/markdown", "txt": "text/plain"}
DEFAULT_REPORT_FORMAT = "md"

REPORT_ORDER = ("section", "target_no", "seq", "sort_key")


def write_hits(hits: DataFrame, path: str, fmt: str = "parquet") -> None:
    hits.write.mode("overwrite").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write report lines as text files whose names sort in reading order.

    The sort is distributed, so a report may be larger than any one machine; ``cat path/part-*``
    is the report.
    """
    report.orderBy(*REPORT_ORDER).select("line").write.mode("overwrite").text(path)
