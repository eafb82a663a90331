"""Images and audio, once their text is there: recognised text arrives as a column."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.match import hits
from lineward.functions.sniff import image_type, is_audio, is_image
from lineward.functions.text import strip
from lineward.operators.store import known_results, scan_with_store, with_fingerprint

# Notes on images and recordings of another type or without text.
NO_IMAGE = "不是图片文件"
EMPTY_IMAGE = "文件为空"
NO_AUDIO = "不是音频文件"
NO_IMAGE_TEXT = "图片中未检测到文字"
NO_AUDIO_TEXT = "语音识别未能提取文字"


def image_results(
    images: DataFrame,
    text: str,
    config: ScanConfig,
    keep: Sequence[str] = (),
    ocr_note: str = "",
    uploaded: bool = False,
) -> DataFrame:
    """``(path, keep..., file_type, hits, note)`` from ``(path, content, <recognised text>)``.

    A file that is no image by its first bytes has no hits and says so; ``uploaded`` tells an empty one apart.
    """
    clean = strip(F.coalesce(F.col(text), F.lit("")))
    notes = F.concat_ws(
        "；",
        F.when(F.lit(ocr_note != ""), F.lit(ocr_note)),
        F.when(clean == "", F.lit(NO_IMAGE_TEXT)),
    )
    body = F.coalesce("content", F.lit(bytearray()))
    empty = F.lit(uploaded) & (F.octet_length(body) == 0)
    other = ~is_image(body)
    return images.select(
        "path",
        *keep,
        F.when(empty, F.lit("empty"))
        .when(other, F.lit("unknown"))
        .otherwise(image_type(body))
        .alias("file_type"),
        hits(F.when(~other, clean), config).alias("hits"),
        F.when(empty, F.lit(EMPTY_IMAGE))
        .when(other, F.lit(NO_IMAGE))
        .otherwise(notes)
        .alias("note"),
    )


def audio_results(
    recordings: DataFrame,
    text: str,
    config: ScanConfig,
    keep: Sequence[str] = (),
    content: str | None = None,
) -> DataFrame:
    """``(path, keep..., file_type, hits, note)`` from ``(path, <transcript>)``.

    Where ``content`` names the bytes, a file that is no recording by its first bytes has no hits and says so.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    other = F.lit(False)
    if content:
        other = ~is_audio(F.coalesce(content, F.lit(bytearray())))
    silent = F.when(words == "", F.lit(NO_AUDIO_TEXT)).otherwise(F.lit(""))
    return recordings.select(
        "path",
        *keep,
        F.when(other, F.lit("unknown")).otherwise(F.lit("audio")).alias("file_type"),
        hits(F.when(~other, words), config).alias("hits"),
        F.when(other, F.lit(NO_AUDIO)).otherwise(silent).alias("note"),
    )


def scan_new_media(
    files: DataFrame,
    text: str,
    store: DataFrame,
    kind: str,
    config: ScanConfig,
    as_of: datetime,
    extractor: str = "",
) -> DataFrame:
    """``(path, fp, hits, note, file_type, reused)`` of ``(path, content, <recognised text>)``.

    ``kind`` is ``image`` or ``audio``. The fingerprint covers the bytes and ``extractor``, so a stored result is
    found under any name, and not by another recogniser.
    """

    def scan(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        kept = [k for k in keep if k != "path"]
        results = (
            image_results(df, text, config, kept)
            if kind == "image"
            else audio_results(df, text, config, kept, "content")
        )
        return results.select(*keep, "hits", "note", "file_type")

    rows = with_fingerprint(files.select("path", "content", text), "content", config, extractor)
    return scan_with_store(rows, ["path"], "content", known_results(store, kind, as_of), scan)
