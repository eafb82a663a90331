"""A folder of files to hits, notes and report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.match import hits
from lineward.functions.sniff import base_name, extension, extension_mismatch, file_type, is_hidden
from lineward.operators.report import target_report
from lineward.operators.store import Scan, known_results, scan_with_store, with_fingerprint
from lineward.sources.files import SPLIT_BYTES, read_text_splits, with_file_text
from lineward.sources.office import zip_encryption

# Notes on files. The last one goes with uploads in the oldest slide format.
UNREADABLE = "无法读取文件"
HIDDEN = "隐藏文件"
ENCRYPTED = "加密"
PSEUDO_ENCRYPTED = "伪加密"
EMPTY_FILE = "空文件"
NO_FILE_TEXT = "无法读取文本内容"
LEGACY_SLIDES = "legacy .ppt requires LibreOffice soffice"


def _encryption_note(encrypted: Column, pseudo: Column) -> Column:
    return F.when(
        encrypted, F.when(pseudo, F.lit(PSEUDO_ENCRYPTED)).otherwise(F.lit(ENCRYPTED))
    )


def file_note(length: Column, hidden: Column, encrypted: Column, pseudo: Column) -> Column:
    """Note on a file found in a folder."""
    return F.concat_ws(
        "，",
        F.when(length == 0, F.lit(UNREADABLE)),
        F.when(hidden, F.lit(HIDDEN)),
        _encryption_note(encrypted, pseudo),
    )


def upload_note(
    length: Column, text: Column, suffix: Column, encrypted: Column, pseudo: Column
) -> Column:
    """Note on a file that was handed in by itself."""
    unreadable = (length > 0) & (F.coalesce(text, F.lit("")) == "")
    return F.concat_ws(
        "，",
        F.when(length == 0, F.lit(EMPTY_FILE)),
        F.when(unreadable, F.lit(NO_FILE_TEXT)),
        F.when(unreadable & (suffix == "ppt"), F.lit(LEGACY_SLIDES)),
        _encryption_note(encrypted, pseudo),
    )


def classify_files(files: DataFrame) -> DataFrame:
    """``(path, content, file_type, is_hidden, is_encrypted, is_pseudo, ext_mismatch)``."""
    flagged = files.select("path", F.coalesce("content", F.lit(bytearray())).alias("content"))
    typed = flagged.withColumn("file_type", file_type(F.col("content"))).withColumn(
        "_zip", zip_encryption(extension(F.col("path")), F.col("content"))
    )
    return typed.select(
        "path",
        "content",
        "file_type",
        is_hidden(F.col("path")).alias("is_hidden"),
        F.col("_zip.is_encrypted").alias("is_encrypted"),
        F.col("_zip.is_pseudo").alias("is_pseudo"),
        extension_mismatch(F.col("file_type"), F.col("path")).alias("ext_mismatch"),
    )


def scan_files(files: DataFrame, config: ScanConfig, uploaded: bool = False) -> DataFrame:
    """``(path, hits, file_type, note, is_encrypted, is_hidden, is_pseudo, ext_mismatch)``.

    ``uploaded`` is for files handed in by name: they are never hidden, and their notes tell an
    empty file from one without text.
    """
    texts = with_file_text(classify_files(files), "content", "text", "file_type")
    size = F.octet_length("content")
    encrypted, pseudo = F.col("is_encrypted"), F.col("is_pseudo")
    if uploaded:
        suffix = extension(base_name(F.col("path")))
        note = upload_note(size, F.col("text"), suffix, encrypted, pseudo)
    else:
        note = file_note(size, F.col("is_hidden"), encrypted, pseudo)
    return texts.select(
        "path",
        hits(F.col("text"), config).alias("hits"),
        "file_type",
        note.alias("note"),
        "is_encrypted",
        (F.lit(False) if uploaded else F.col("is_hidden")).alias("is_hidden"),
        "is_pseudo",
        "ext_mismatch",
    )


def file_contents_scan(config: ScanConfig) -> Scan:
    """The scan of file contents in a column ``content``: what depends on the bytes alone."""

    def scan(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        body = F.coalesce("content", F.lit(bytearray())).alias("content")
        typed = df.select(*keep, body).withColumn("file_type", file_type(F.col("content")))
        texts = with_file_text(typed, "content", "text", "file_type")
        none = F.lit("").alias("note")
        return texts.select(*keep, hits(F.col("text"), config).alias("hits"), none, "file_type")

    return scan


def scan_new_files(
    files: DataFrame, store: DataFrame, config: ScanConfig, as_of: datetime
) -> DataFrame:
    """``(path, fp, hits, file_type, note, is_encrypted, is_hidden, is_pseudo, ext_mismatch, reused)``.

    Hits and types come from the store under today's paths where it knows the content. What depends on
    the path as well is told anew for every file: whether it is hidden, and whether it is an encrypted archive.
    """
    body = F.coalesce("content", F.lit(bytearray()))
    told = files.select("path", body.alias("content")).withColumn(
        "_zip", zip_encryption(extension(F.col("path")), F.col("content"))
    )
    rows = with_fingerprint(told, "content", config).withColumn("_size", F.octet_length("content"))
    known = known_results(store, "file", as_of)
    keys = ["path", "_size", "_zip"]
    found = scan_with_store(rows, keys, "content", known, file_contents_scan(config))
    hidden = is_hidden(F.col("path"))
    encrypted, pseudo = F.col("_zip.is_encrypted"), F.col("_zip.is_pseudo")
    return found.select(
        "path",
        "fp",
        "hits",
        "file_type",
        file_note(F.col("_size"), hidden, encrypted, pseudo).alias("note"),
        encrypted.alias("is_encrypted"),
        hidden.alias("is_hidden"),
        pseudo.alias("is_pseudo"),
        extension_mismatch(F.col("file_type"), F.col("path")).alias("ext_mismatch"),
        "reused",
    )


def scan_text_files(
    spark: SparkSession,
    folder: str,
    config: ScanConfig,
    files: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """``(path, line, keyword, content, matched_text)`` of text files of any size, see ``read_text_splits``."""
    pieces = read_text_splits(spark, folder, files, split_bytes)
    found = pieces.select("path", "first_line", F.inline_outer(hits(F.col("text"), config)))
    found = found.where(F.col("line").isNotNull())
    line = (F.col("first_line") + F.col("line") - 1).alias("line")
    return found.select("path", line, "keyword", "content", "matched_text")


def file_report(
    results: DataFrame, checked_at: str, fmt: str = "md", uploaded: bool = False
) -> DataFrame:
    mode = "文件上传检查" if uploaded else "文件路径检查"
    return target_report(results, "file", "path", mode, checked_at, fmt)
