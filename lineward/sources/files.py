"""Files as rows of ``(path, length, content)``, and their text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from lineward.functions.sniff import OFFICE_MEMBERS, office_kind
from lineward.session import cut, stored
from lineward.sources.office import gathered, office_text

# Bytes of file content handed to Spark at a time by one reading task.
_BATCH_BYTES = 64 * 1024 * 1024


def read_visible_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder except those whose name starts with a dot (Spark skips them)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "content")
    )


def _prefix(folder: str) -> str:
    """What stands before a path inside the file system to make it a full location."""
    _, root = pafs.FileSystem.from_uri(folder)
    return folder[: -len(root)] if folder.endswith(root) else ""


def _lister(folder: str):
    schema = pa.schema(
        [("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64())]
    )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for parent in batch.column("path").to_pylist():
                # A folder that cannot be listed fails the task: a retry may help, silence would not.
                found = filesystem.get_file_info(pafs.FileSelector(parent))
                if isinstance(filesystem, pafs.LocalFileSystem):  # links to folders are not followed
                    found = [
                        f for f in found if f.type != pafs.FileType.Directory or not os.path.islink(f.path)
                    ]
                columns = {
                    "path": [f.path for f in found],
                    "is_folder": [f.type == pafs.FileType.Directory for f in found],
                    "length": [f.size for f in found],
                }
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return entries


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of every file below a folder, hidden ones included.

    Folders are listed level by level, the folders of a level in parallel; names never pass through
    the driver. ``folder`` is a location that every executor sees (``file:///...``, ``s3://...``).
    """
    folder = folder.rstrip("/")
    _, root = pafs.FileSystem.from_uri(folder)
    level = spark.createDataFrame([(root,)], "path string")
    files = None
    while True:
        listing = level.mapInArrow(
            _lister(folder), "path string, is_folder boolean, length bigint"
        )
        found = cut(listing)
        here = found.where(~F.col("is_folder")).select("path", "length")
        files = here if files is None else files.unionByName(here)
        folders = found.where("is_folder").select("path")
        if folders.isEmpty():
            break
        # A listing is mostly waiting, so spread the folders of a level over all cores.
        level = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    return files.select(F.concat(F.lit(_prefix(folder)), "path").alias("path"), "length")


def _opener(folder: str, prefix: str):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                try:
                    with filesystem.open_input_stream(row["path"][len(prefix) :]) as stream:
                        content = stream.read()
                except OSError:
                    content = b""
                rows.append({**row, "content": content})
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return contents


def read_files(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """``(path, length, content)`` of all files below a folder, hidden ones included.

    Files are opened where the tasks run; an unreadable file has empty content.
    """
    tasks = partitions or spark.sparkContext.defaultParallelism * 4
    listed = list_files(spark, folder).repartition(tasks, "path")
    return listed.mapInArrow(
        _opener(folder, _prefix(folder.rstrip("/"))), "path string, length bigint, content binary"
    )


@F.arrow_udf(T.StringType())
def _fallback_text(contents: pa.Array) -> pa.Array:
    def decode(content):
        if content is None:
            return None
        try:
            return content.decode("gbk")
        except UnicodeDecodeError:
            return content.decode("utf-8", errors="ignore")

    return gathered(decode(c.as_py()) for c in contents)


def decode_text(content: Column) -> Column:
    """UTF-8; bytes that are no UTF-8 as GBK; bytes that are neither as UTF-8 without the bad ones."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, text).otherwise(_fallback_text(F.when(~valid, content)))


# Leading bytes of formats that hold no plain text and have no reader here.
_OPAQUE_HEADS = (b"%PDF-", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")


def with_file_text(
    df: DataFrame, content: str, text: str, file_type: str | None = None
) -> DataFrame:
    """Add the text of each file: office archives by their reader, everything else decoded.

    ``file_type`` names a column with the type of the content, where it is known already.
    """
    body = F.col(content)
    if file_type:
        kind = F.when(F.col(file_type).isin(*OFFICE_MEMBERS), F.col(file_type))
    else:
        kind = office_kind(body)
    opaque = F.lit(False)
    for head in _OPAQUE_HEADS:
        opaque = opaque | F.startswith(body, F.lit(bytearray(head)))
    kinds = df.withColumn("_kind", kind)
    return kinds.withColumn(
        text,
        F.when(F.col("_kind").isNotNull(), office_text(F.col("_kind"), body))
        .when(opaque, F.lit(""))
        .otherwise(decode_text(F.when(F.col("_kind").isNull() & ~opaque, body))),
    ).drop("_kind")


# Bytes of a text file that one task reads at a time.
SPLIT_BYTES = 64 * 1024 * 1024


def _lines_from(stream, start: int, end: int, length: int, ahead: int = 1 << 16) -> bytes:
    """The lines of a file that begin between two places, each with the line feed that ends it."""
    before = min(start, 1)  # what ends the line before may be the very byte before
    stream.seek(start - before)
    data = stream.read(end - start + before)
    if before:
        first = data.find(b"\n") + 1
        if not first:
            return b""  # a longer line stretches over all of it
        data = data[first:]
    while data and not data.endswith(b"\n") and stream.tell() < length:
        more = stream.read(ahead)
        at = more.find(b"\n") + 1
        data += more[:at] if at else more
        if at:
            break
    return data


def _is(encoding: str, data: bytes) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _splits(folder: str, prefix: str):
    """Of each split (path, length, start, end): line feeds, whether it is UTF-8 and GBK, lines begin in it."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with filesystem.open_input_file(row["path"][len(prefix) :]) as stream:
                    data = _lines_from(stream, row["start"], row["end"], row["length"])
                row |= {"feeds": data.count(b"\n"), "utf8": _is("utf-8", data), "gbk": _is("gbk", data)}
                rows.append(row | {"is_used": bool(data) or row["start"] == 0})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return measured


def _texts(folder: str, prefix: str):
    schema = pa.schema([("path", pa.string()), ("first_line", pa.int64()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem.open_input_file(row["path"][len(prefix) :]) as stream:
                    data = _lines_from(stream, row["start"], row["end"], row["length"])
                text = data.decode(row["encoding"], errors="ignore")
                if not row["is_last"]:  # the line feed at its end begins no line here
                    text = text.removesuffix("\n")
                columns = {"path": [row["path"]], "first_line": [row["first_line"]], "text": [text]}
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return read


def read_text_splits(
    spark: SparkSession, folder: str, files: DataFrame | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(path, first_line, text)``: text files in pieces of whole lines, read by many tasks.

    ``files`` are ``(path, length)`` as ``list_files`` gives them; all of ``folder`` by default. A piece has the lines
    that begin within its range of bytes, and the number of the first. Whether a file is UTF-8, GBK or neither is
    decided over all its pieces, as ``decode_text`` does for a whole file. Line feeds are no part of another character
    in either encoding. Files are read twice, first for their encoding and line counts, of
    which there is one row for each piece. A single line is never divided.
    """
    folder = folder.rstrip("/")
    prefix = _prefix(folder)
    listed = list_files(spark, folder) if files is None else files
    last_start = F.greatest(F.col("length") - 1, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), last_start, F.lit(split_bytes).cast("bigint")))
    ranges = listed.select("path", "length", starts.alias("start")).withColumn(
        "end", F.least(F.col("start") + split_bytes, F.col("length"))
    )
    tasks = spark.sparkContext.defaultParallelism * 4
    columns = "path string, length bigint, start bigint, end bigint"
    measured = ranges.repartition(tasks, "path", "start").mapInArrow(
        _splits(folder, prefix), f"{columns}, feeds bigint, utf8 boolean, gbk boolean, is_used boolean"
    )
    measured = stored(measured, "splits")
    encodings = measured.groupBy("path").agg(
        F.when(F.bool_and("utf8") | ~F.bool_and("gbk"), "utf-8").otherwise("gbk").alias("encoding"),
        F.max(F.when(F.col("is_used"), F.col("start"))).alias("last"),
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = measured.withColumn("first_line", F.coalesce(F.sum("feeds").over(before), F.lit(0)) + 1)
    pieces = counted.where("is_used").join(encodings, "path").select(
        "path", "length", "start", "end", "first_line", "encoding", (F.col("start") == F.col("last")).alias("is_last")
    )
    return pieces.repartition(tasks, "path", "start").mapInArrow(
        _texts(folder, prefix), "path string, first_line bigint, text string"
    )
