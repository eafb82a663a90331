"""File classification from leading bytes, as expressions over a BINARY column."""

from __future__ import annotations

from io import BytesIO
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading bytes by file type, tried in this order.
FILE_SIGNATURES = {
    "pdf": b"%PDF",
    "zip": b"PK\x03\x04",
    "gzip": b"\x1f\x8b",
    "png": b"\x89PNG\r\n\x1a\n",
    "jpg": b"\xff\xd8\xff",
    "bmp": b"BM",
    "gif": b"GIF8",
    "xml": b"<?xml",
    "html": b"<htm",
    "rtf": b"{\\rtf",
    "exe": b"MZ",
    "elf": b"\x7fELF",
    "ole2": b"\xd0\xcf\x11\xe0",
    "7z": b"7z\xbc\xaf\x27\x1c\x00",
    "rar": b"Rar!\x1a\x07",
}

# The member that tells the kinds of office archive apart, tried in this order.
OFFICE_MEMBERS = {
    "docx": "word/document.xml",
    "xlsx": "xl/workbook.xml",
    "pptx": "ppt/presentation.xml",
}

# Leading bytes of images.
IMAGE_SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": "png",
    b"\xff\xd8\xff": "jpg/jpeg",
    b"GIF8": "gif",
    b"BM": "bmp",
    b"RIFF": "webp",
    b"\xff\xd8": "jpeg",
}

# Leading bytes of audio files, and the brands of an MP4 box that count as audio.
AUDIO_SIGNATURES = {
    b"ID3": "mp3",
    b"\xff\xfb": "mp3",
    b"RIFF": "wav",
    b"fLaC": "flac",
    b"OggS": "ogg",
    b"\x00\x00\x00\x18ftyp": "m4a",
    b"\x00\x00\x00\x14ftyp": "m4a",
    b"\x00\x00\x00\x1cftyp": "m4a",
}
AUDIO_BRANDS = ("M4A ", "M4B ", "mp42", "isom", "3gp5", "3gp6")


def _begins(content: Column, magic: bytes) -> Column:
    return F.startswith(content, F.lit(bytearray(magic)))


def _first_signature(content: Column, pairs) -> Column:
    """Name of the first matching signature, null when none does."""
    return F.coalesce(*[F.when(_begins(content, magic), F.lit(name)) for name, magic in pairs])


def _latin1(content: Column, length: int) -> Column:
    """Leading bytes as a string with one character per byte."""
    return F.decode(F.substring(content, 1, length), "ISO-8859-1")


def is_text(content: Column) -> Column:
    """No zero byte and at least 70 % printable ASCII in the whole content; empty content is not text."""
    letters = F.decode(content, "ISO-8859-1")  # one character per byte
    readable = F.length(F.regexp_replace(letters, r"[^\x20-\x7e\t\n\r]", ""))
    zero_free = ~F.contains(letters, F.lit("\x00"))
    return (F.octet_length(content) > 0) & zero_free & (readable * 10 >= F.octet_length(content) * 7)


@F.arrow_udf(T.StringType())
def _office_kind(archives: pa.Array) -> pa.Array:
    def kind(content):
        if content is None:
            return None
        try:
            with ZipFile(BytesIO(content)) as archive:
                members = set(archive.namelist())
        except (BadZipFile, OSError, ValueError, NotImplementedError):
            return None
        return next((k for k, member in OFFICE_MEMBERS.items() if member in members), None)

    return pa.array((kind(a.as_py()) for a in archives), pa.string())  # one archive is copied at a time


def office_kind(content: Column) -> Column:
    """docx, xlsx or pptx for an office archive, else null. Only archives reach Python."""
    return _office_kind(F.when(_begins(content, FILE_SIGNATURES["zip"]), content))


def file_type(content: Column) -> Column:
    """Type by content: office archive, signature, then text or binary."""
    return F.coalesce(
        office_kind(content),
        F.when(F.octet_length(content) == 0, F.lit("empty")),
        _first_signature(content, FILE_SIGNATURES.items()),
        F.when(is_text(content), F.lit("text")),
        F.lit("binary"),
    )


def image_type(content: Column) -> Column:
    named = [(name, magic) for magic, name in IMAGE_SIGNATURES.items()]
    return F.coalesce(_first_signature(content, named), F.lit("unknown"))


def is_image(content: Column) -> Column:
    return image_type(content) != "unknown"


def audio_type(content: Column) -> Column:
    """Audio type by content, null for anything else."""
    named = [(name, magic) for magic, name in AUDIO_SIGNATURES.items()]
    box = F.substring(content, 5, 4) == F.lit(bytearray(b"ftyp"))
    brand = F.substring(content, 9, 4).isin([F.lit(bytearray(b.encode())) for b in AUDIO_BRANDS])
    return F.coalesce(_first_signature(content, named), F.when(box & brand, F.lit("m4a")))


def is_audio(content: Column) -> Column:
    return audio_type(content).isNotNull()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*\.([^.]*)$", 1))


def is_hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


# Extensions that go with a content type under other names than its own.
_EXTENSION_ALIASES = {
    "jpg": ("jpg", "jpeg"),
    "html": ("html", "htm"),
    "gzip": ("gz", "tgz", "gzip"),
    "exe": ("exe", "dll"),
    "ole2": ("doc", "xls", "ppt"),
    "elf": ("", "so", "o", "elf"),
}
_PLAIN_TYPES = ("text", "binary", "empty")


def extension_mismatch(file_type: Column, path: Column) -> Column:
    """The content has a recognised type and the file name claims another one."""
    suffix = extension(path)
    fits = suffix == file_type
    for name, suffixes in _EXTENSION_ALIASES.items():
        fits = fits | ((file_type == name) & suffix.isin(*suffixes))
    return ~file_type.isin(*_PLAIN_TYPES) & ~fits
