"""Recognised text of images and recordings to report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lineward.operators.report import target_report


def image_report(results: DataFrame, checked_at: str, fmt: str = "md") -> DataFrame:
    """Images in path order."""
    return target_report(results, "image", "path", "图片路径检查", checked_at, fmt)


def audio_report(
    results: DataFrame, checked_at: str, fmt: str = "md", order: str = "path"
) -> DataFrame:
    """Recordings by path, or by an upload index kept in the results."""
    return target_report(results, "audio", "path", "音频路径检查", checked_at, fmt, [order])
