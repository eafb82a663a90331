"""Inputs that Spark derives from the given tables: file names, file bytes, archives."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape
from zipfile import ZIP_STORED, ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.sources.tables import read_spread
from lineward.functions.sniff import AUDIO_SIGNATURES, FILE_SIGNATURES, IMAGE_SIGNATURES


# Tables with long texts, and the column to deal them out by when they come as a single split.
SPREAD_BY = {"documents": "doc_id", "pages": "url", "conversations": "conv_id"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    if name in SPREAD_BY:
        return read_spread(spark, path, SPREAD_BY[name])
    return spark.read.parquet(path)


def _picked(number: Column, choices: list) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (number % len(choices) + 1).cast("int"))


def _headed(documents: DataFrame, heads: list[bytes]) -> DataFrame:
    """Documents as files that start with the bytes of one of several formats, in turn."""
    head = _picked(F.col("doc_id"), [bytearray(h) for h in heads])
    return documents.select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"))


# Types whose leading bytes are ASCII, so that what follows them still reads as UTF-8.
READABLE_SIGNATURES = {k: v for k, v in FILE_SIGNATURES.items() if v.isascii()}


def signed_files(documents: DataFrame, signatures: dict[str, bytes] = FILE_SIGNATURES) -> DataFrame:
    """``(doc_id, path, content)``: every signature in turn, then plain content; hidden by length."""
    head = _picked(F.col("doc_id"), [bytearray(h) for h in [*signatures.values(), b""]])
    path = F.concat(
        F.col("source"),
        F.lit("/"),
        F.when(F.col("n_chars") % 2 == 0, F.lit(".")).otherwise(F.lit("")),
        F.col("doc_id").cast("string"),
        F.lit("."),
        _picked(F.col("n_chars"), ["txt", "pdf", "png", "zip", "html"]),
    )
    content = F.concat(head, F.encode("text", "UTF-8"))
    return documents.select("doc_id", content.alias("content"), path.alias("path"))


# Bytes of documents turned into files at a time.
PIECE_BYTES = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about PIECE_BYTES each, whatever the rows Spark sends at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _encoded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        contents = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            content = text.encode()
            if doc_id % 3 == 1:
                try:
                    content = text.encode("gbk")
                except UnicodeEncodeError:
                    pass
            elif doc_id % 3 == 2 and text.isascii():
                content += b"\xff"
            contents.append(content)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(contents, pa.binary())], ["doc_id", "content"]
        )


def encoded_files(documents: DataFrame) -> DataFrame:
    """``(doc_id, content)``: texts as UTF-8, as GBK where that has all their letters, and with a byte
    behind them that is neither."""
    return documents.select("doc_id", "text").mapInArrow(_encoded_batches, "doc_id bigint, content binary")


def image_files(documents: DataFrame) -> DataFrame:
    return _headed(documents, [*IMAGE_SIGNATURES, b""])


def audio_files(documents: DataFrame) -> DataFrame:
    return _headed(documents, [*AUDIO_SIGNATURES, b"\x00\x00\x00\x20ftypisom", b""])


def _archive(members: dict[str, bytes]) -> bytes:
    out = BytesIO()
    with ZipFile(out, "w", ZIP_STORED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
_SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def relations(targets: dict[str, str]) -> bytes:
    """A relationship part: target and kind, numbered from 1."""
    entries = "".join(
        f'<Relationship Id="r{i}" Type="{_RELATIONS}/{kind}" Target="{target}"/>'
        for i, (target, kind) in enumerate(targets.items(), 1)
    )
    return f'<Relationships xmlns="{_PACKAGE}">{entries}</Relationships>'.encode()


def docx_bytes(lines: list[str]) -> bytes:
    runs = "".join(f"<w:p><w:r><w:t>{escape(l)}</w:t></w:r></w:p>" for l in lines)
    body = f'<w:document xmlns:w="{_WORD}"><w:body>{runs}</w:body></w:document>'
    main = relations({"word/document.xml": "officeDocument"})
    return _archive({"_rels/.rels": main, "word/document.xml": body.encode()})


def xlsx_bytes(lines: list[str]) -> bytes:
    """A row per line: shared strings for even rows, inline strings for odd ones."""
    shared = "".join(f"<si><t>{escape(l)}</t></si>" for l in lines)
    rows = "".join(
        f'<row><c t="s"><v>{i}</v></c></row>'
        if i % 2 == 0
        else f'<row><c t="inlineStr"><is><t>{escape(l)}</t></is></c></row>'
        for i, l in enumerate(lines)
    )
    return _archive(
        {
            "_rels/.rels": relations({"xl/workbook.xml": "officeDocument"}),
            "xl/_rels/workbook.xml.rels": relations(
                {"worksheets/sheet1.xml": "worksheet", "sharedStrings.xml": "sharedStrings"}
            ),
            "xl/workbook.xml": (
                f'<workbook xmlns="{_SHEET}" xmlns:r="{_RELATIONS}"><sheets><sheet r:id="r1"/></sheets></workbook>'
            ).encode(),
            "xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}">{shared}</sst>'.encode(),
            "xl/worksheets/sheet1.xml": (
                f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>'.encode()
            ),
        }
    )


def pptx_bytes(lines: list[str]) -> bytes:
    """A slide per line."""
    listed = "".join(f'<p:sldId r:id="r{i}"/>' for i in range(1, len(lines) + 1))
    members = {
        "_rels/.rels": relations({"ppt/presentation.xml": "officeDocument"}),
        "ppt/_rels/presentation.xml.rels": relations(
            {f"slides/slide{i}.xml": "slide" for i in range(1, len(lines) + 1)}
        ),
        "ppt/presentation.xml": (
            f'<p:presentation xmlns:p="{_SLIDES}" xmlns:r="{_RELATIONS}">{listed}</p:presentation>'
        ).encode(),
    }
    for number, line in enumerate(lines, 1):
        members[f"ppt/slides/slide{number}.xml"] = (
            f'<p:sld xmlns:p="{_SLIDES}" xmlns:a="{_DRAWING}"><p:sp><p:txBody><a:p><a:r><a:t>'
            f"{escape(line)}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"
        ).encode()
    return _archive(members)


_WRITERS = [docx_bytes, xlsx_bytes, pptx_bytes]


def _office_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("content", pa.binary())])
    for batch in _pieces(batches):
        rows = []
        for row in batch.to_pylist():
            kind = row["doc_id"] % 3
            lines = [l for l in row["text"].split("\n") if l]
            suffix = ("docx", "xlsx", "pptx")[kind]
            rows.append(
                {
                    "doc_id": row["doc_id"],
                    "path": f"{row['doc_id']}.{suffix}",
                    "content": _WRITERS[kind](lines),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def office_files(documents: DataFrame) -> DataFrame:
    """``(doc_id, path, content)``: each document as a docx, xlsx or pptx file, in turn."""
    return documents.select("doc_id", "text").mapInArrow(
        _office_batches, "doc_id bigint, path string, content binary"
    )


def _flagged(data: bytes, signature: bytes, flag_at: int) -> bytes:
    out = bytearray(data)
    at = data.find(signature)
    out[at + flag_at] |= 1
    return bytes(out)


def _zip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("content", pa.binary())])
    for batch in _pieces(batches):
        rows = []
        for row in batch.to_pylist():
            data = _archive({"text.txt": row["text"].encode()})
            kind = row["n_chars"] % 3
            if kind == 1:
                data = _flagged(data, b"PK\x03\x04", 6)
            if kind >= 1:
                data = _flagged(data, b"PK\x01\x02", 8)
            hidden = "." if row["n_chars"] % 2 == 0 else ""
            suffix = "zip" if row["doc_id"] % 4 else "dat"
            path = f"{row['source']}/{hidden}{row['doc_id']}.{suffix}"
            rows.append({"doc_id": row["doc_id"], "path": path, "content": data})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def zip_files(documents: DataFrame) -> DataFrame:
    """``(doc_id, path, content)``: each document zipped; plain, encrypted and pseudo-encrypted
    by length, three in four of them named ``.zip``."""
    return documents.select("doc_id", "n_chars", "source", "text").mapInArrow(
        _zip_batches, "doc_id bigint, path string, content binary"
    )
