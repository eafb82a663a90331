"""Text of OOXML office files, and the encryption flags of ZIP archives.

Both work on the bytes of one file at a time, in Arrow functions. An office file is read the way its format
names its parts: from the package's relationships to the main part, and from there to sheets, shared
strings, slides and notes. Parts are read as events, never as whole trees.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from io import BytesIO
from posixpath import dirname, join, normpath
from xml.etree.ElementTree import ParseError, iterparse
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the namespace of relationship ids in the parts.
_RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


# Characters of text held as Python strings at a time, beside the Arrow column they go to.
PIECE_CHARS = 1 << 20


class Package:
    """The parts of an office file."""

    def __init__(self, archive: ZipFile):
        self.archive = archive
        self.parts = set(archive.namelist())

    def ends(self, part: str) -> Iterator[tuple[str, object]]:
        """Local name and element of everything that ends in a part, in document order."""
        with self.archive.open(part) as stream:
            for _, element in iterparse(stream):
                yield element.tag.rpartition("}")[2], element

    def related(self, part: str) -> list[tuple[str, str, str]]:
        """Id, kind and target part of each relationship of ``part`` ('' is the package itself)."""
        folder, name = dirname(part), part.rpartition("/")[2]
        relations = join(folder, "_rels", f"{name}.rels")
        if relations not in self.parts:
            return []
        found = []
        for tag, element in self.ends(relations):
            if tag == "Relationship" and element.get("TargetMode") != "External":
                target = element.get("Target", "")
                target = target[1:] if target.startswith("/") else normpath(join(folder, target))
                found.append((element.get("Id", ""), element.get("Type", "").rpartition("/")[2], target))
        return [r for r in found if r[2] in self.parts]

    def main(self) -> str:
        return next(target for _, kind, target in self.related("") if kind == "officeDocument")

    def listed(self, part: str, tag: str) -> list[str]:
        """The parts that the elements ``tag`` of ``part`` refer to, in their order."""
        targets = {i: target for i, _, target in self.related(part)}
        named = [element.get(_RELATION_ID) for name, element in self.ends(part) if name == tag]
        return [targets[i] for i in named if i in targets]


def _document_text(package: Package) -> str:
    """Every text run on a line of its own."""
    return "\n".join(e.text for tag, e in package.ends(package.main()) if tag == "t" and e.text)


def _strings(package: Package, workbook: str) -> list[str]:
    out, runs = [], []
    for part in (target for _, kind, target in package.related(workbook) if kind == "sharedStrings"):
        for tag, element in package.ends(part):
            if tag == "t":
                runs.append(element.text or "")
            elif tag == "si":
                out.append("".join(runs))
                runs = []
    return out


def _workbook_text(package: Package) -> str:
    """A line per row, cells separated by tabs, sheets in the order of the workbook."""
    workbook = package.main()
    strings = _strings(package, workbook)
    lines = []
    for sheet in package.listed(workbook, "sheet"):
        cells: list[str] = []
        value, inline = "", None
        for tag, element in package.ends(sheet):
            if tag == "v":
                value = element.text or ""
            elif tag == "t":
                inline = (inline or "") + (element.text or "")
            elif tag == "c":
                if element.get("t") == "s" and value:
                    cells += strings[int(value) : int(value) + 1]
                elif value or inline is not None:
                    cells.append(value or inline)
                value, inline = "", None
            elif tag == "row":
                if cells:
                    lines.append("\t".join(cells))
                cells = []
                element.clear()
    return "\n".join(lines)


def _paragraphs(package: Package, part: str) -> list[str]:
    """The paragraphs of a slide or of its notes; a line break inside a paragraph stays one."""
    out, pieces = [], []
    try:
        for tag, element in package.ends(part):
            if tag == "t":
                pieces.append(element.text or "")
            elif tag == "br":
                pieces.append("\n")
            elif tag == "p":
                out.append("".join(pieces).strip())
                pieces = []
    except ParseError:  # a damaged part has no text, the others keep theirs
        return []
    return [text for text in out if text]


def _presentation_text(package: Package) -> str:
    """Slides in the order of the presentation under a header line, notes behind each slide."""
    lines = []
    for number, slide in enumerate(package.listed(package.main(), "sldId"), 1):
        notes = [target for _, kind, target in package.related(slide) if kind == "notesSlide"]
        texts = [text for part in (slide, *notes) for text in _paragraphs(package, part)]
        if texts:
            lines += [f"===== Slide {number} =====", *texts]
    return "\n".join(lines)


_READERS = {"docx": _document_text, "xlsx": _workbook_text, "pptx": _presentation_text}


def read_office(kind: str, content: bytes) -> str:
    """Text of one office file; a broken file has none."""
    try:
        with ZipFile(BytesIO(content)) as archive:
            return _READERS[kind](Package(archive))
    except Exception:  # any damage inside a foreign file means "no text"
        return ""


def gathered(texts: Iterable[str | None]) -> pa.Array:
    """The texts as a column; no more than PIECE_CHARS of them and one more are held as Python strings at a time."""
    pieces, waiting, size = [], [], 0
    for text in texts:
        waiting.append(text)
        size += len(text or "")
        if size >= PIECE_CHARS:
            pieces.append(pa.array(waiting, pa.string()))
            waiting, size = [], 0
    return pa.concat_arrays([*pieces, pa.array(waiting, pa.string())])


@F.arrow_udf(T.StringType())
def _office_text(kinds: pa.Array, contents: pa.Array) -> pa.Array:
    return gathered(
        None if kind is None else read_office(kind, content.as_py())
        for kind, content in zip(kinds.to_pylist(), contents)
    )


def office_text(kind: Column, content: Column) -> Column:
    """Text of office archives, null where ``kind`` is null. Other content never reaches Python."""
    return _office_text(kind, F.when(kind.isNotNull(), content))


# Fixed values of the ZIP format: where an archive's directory is told, an entry of it, an entry's own
# header; sizes without the variable parts.
_END, _ENTRY, _HEADER = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _ENTRY_SIZE, _HEADER_SIZE = 22, 46, 30
_ENCRYPTED_BITS = 0x01 | 0x40


def _flag_words(data: bytes) -> Iterator[tuple[int, int]]:
    """The flags of each entry of the directory, and those of its own header (0 where there is none).

    The directory stands right before its end record; what was put before the archive moves all offsets.
    """
    end = data.rfind(_END)
    if end < 0 or len(data) < end + _END_SIZE:
        return
    size, offset = struct.unpack_from("<II", data, end + 12)
    at = end - size
    moved = at - offset
    while 0 <= at <= end - _ENTRY_SIZE and data.startswith(_ENTRY, at):
        (flags,) = struct.unpack_from("<H", data, at + 8)
        lengths = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0] + moved
        own = 0
        if 0 <= header <= end - _HEADER_SIZE and data.startswith(_HEADER, header):
            (own,) = struct.unpack_from("<H", data, header + 6)
        yield flags, own
        at += _ENTRY_SIZE + sum(lengths)


def zip_flags(data: bytes) -> dict[str, bool]:
    """Encrypted if any entry says so; pseudo-encrypted if only the directory does."""
    words = list(_flag_words(data))
    listed = any(flags & _ENCRYPTED_BITS for flags, _ in words)
    own = any(flags & _ENCRYPTED_BITS for _, flags in words)
    return {"is_encrypted": listed or own, "is_pseudo": listed and not own}


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("is_encrypted", T.BooleanType()),
            T.StructField("is_pseudo", T.BooleanType()),
        ]
    )
)
def _zip_flags(contents: pa.Array) -> pa.Array:
    none = {"is_encrypted": False, "is_pseudo": False}
    flags = (zip_flags(c.as_py()) if c.is_valid else none for c in contents)
    return pa.array(flags, pa.struct([("is_encrypted", pa.bool_()), ("is_pseudo", pa.bool_())]))


def zip_encryption(extension: Column, content: Column) -> Column:
    """``struct(is_encrypted, is_pseudo)``; only files named ``.zip`` are looked into."""
    return _zip_flags(F.when(extension == "zip", content))
