import gzip
import os
import struct
from io import BytesIO
from zipfile import ZipFile

import brute
import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.sniff import (
    AUDIO_BRANDS,
    AUDIO_SIGNATURES,
    FILE_SIGNATURES,
    IMAGE_SIGNATURES,
    audio_type,
    extension,
    extension_mismatch,
    file_type,
    image_type,
    is_audio,
    is_hidden,
    is_image,
    is_text,
)
from lineward.plans.files import file_report, scan_files, scan_text_files
from lineward.operators.report import report_text
from lineward.sources.files import decode_text, list_files, read_files, read_text_splits, read_visible_files
from lineward.sources.office import read_office, zip_flags
from lineward.sources.tables import read_whole_texts
from registry.derived import docx_bytes, pptx_bytes, relations, xlsx_bytes

UTF8_CHINESE = "第一行\n本文件属于机密资料".encode()


def archive(members):
    out = BytesIO()
    with ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def flagged(data, signature, at, bit=1):
    out = bytearray(data)
    place = data.find(signature)
    out[place + at] |= bit
    return bytes(out)


PLAIN_ZIP = archive({"a.txt": b"hello", "b.txt": b"world"})
LOCAL_ENCRYPTED = flagged(PLAIN_ZIP, b"PK\x03\x04", 6)
PSEUDO_ENCRYPTED = flagged(PLAIN_ZIP, b"PK\x01\x02", 8, 0x40)

FILES = {
    "a/plain.txt": b"first line\nthis is SECRET\n",
    "a/chinese.txt": UTF8_CHINESE,
    "a/gbk.txt": "内部资料".encode("gbk"),
    "a/broken.bin": b"\xff\xfe\xff" + "机密".encode() + b"\x81",
    "a/.hidden.txt": "机密".encode(),
    "a/空 格/report.docx": docx_bytes(["第一段", "绝密文件"]),
    "a/空 格/sheet.xlsx": xlsx_bytes(["编号", "保密协议", "3"]),
    "a/空 格/slides.pptx": pptx_bytes(["封面", "涉密内容"]),
    "a/空 格/damaged.docx": docx_bytes(["绝密文件"])[:-30],
    "plain.zip": PLAIN_ZIP,
    "locked.zip": LOCAL_ENCRYPTED,
    "pseudo.ZIP": PSEUDO_ENCRYPTED,
    "locked.dat": LOCAL_ENCRYPTED,
    "picture.txt": b"\x89PNG\r\n\x1a\n123",
    "empty": b"",
    ".config/.deep/x": "秘密".encode(),
    "scan.pdf": b"%PDF-1.4 \xe7\xa7\x98\xe5\xaf\x86",
    "no_suffix": b"int main() {}\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


@pytest.mark.parametrize("prefix", ["file://", ""])
def test_listing_finds_hidden_files_at_every_level(spark, folder, prefix):
    got = {r.path: r.length for r in list_files(spark, prefix + folder).collect()}
    assert got == {f"{prefix}{folder}/{n}": len(d) for n, d in FILES.items()}


def test_reading_files(spark, folder):
    got = {r.path: bytes(r.content) for r in read_files(spark, "file://" + folder, 3).collect()}
    assert got == {f"file://{folder}/{n}": d for n, d in FILES.items()}


def test_unreadable_file_is_empty(spark, folder, tmp_path):
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "here").write_bytes(b"x")
    results = scan_files(read_files(spark, str(tmp_path)), ScanConfig()).collect()
    notes = {os.path.basename(r.path): (r.file_type, r.note) for r in results}
    assert notes["here"] == ("text", "")
    assert notes.get("gone", ("empty", "无法读取文件")) == ("empty", "无法读取文件")


def test_visible_files_and_whole_texts(spark, folder):
    visible = {os.path.relpath(r.path[5:], folder) for r in read_visible_files(spark, folder).collect()}
    assert ".config/.deep/x" not in visible and "a/plain.txt" in visible
    texts = read_whole_texts(spark, f"{folder}/a/plain.txt").collect()
    assert [t.text for t in texts] == ["first line\nthis is SECRET\n"]


def test_scan_of_a_folder(spark, folder):
    results = scan_files(read_files(spark, "file://" + folder), ScanConfig())
    got = {r.path[len("file://" + folder) + 1 :]: r for r in results.collect()}

    def hit(name):
        return [(h.line, h.keyword) for h in got[name].hits]

    assert hit("a/plain.txt") == []
    assert hit("a/chinese.txt") == [(2, "机密")]
    assert hit("a/gbk.txt") == [(1, "内部")]
    assert hit("a/.hidden.txt") == [(1, "机密")] and got["a/.hidden.txt"].note == "隐藏文件"
    assert hit("a/broken.bin") == [(1, "机密")]
    assert hit("a/空 格/report.docx") == [(2, "绝密")]
    assert hit("a/空 格/sheet.xlsx") == [(2, "保密")]
    assert hit("a/空 格/slides.pptx") == [(4, "涉密")]
    assert hit(".config/.deep/x") == [(1, "秘密")] and not got[".config/.deep/x"].is_hidden
    assert hit("scan.pdf") == []
    types = {n: r.file_type for n, r in got.items()}
    assert types["a/空 格/report.docx"] == "docx" and types["a/空 格/slides.pptx"] == "pptx"
    assert types["a/空 格/damaged.docx"] == "zip" and types["plain.zip"] == "zip"
    assert types["picture.txt"] == "png" and got["picture.txt"].ext_mismatch
    assert types["a/chinese.txt"] == "binary" and types["no_suffix"] == "text"
    assert types["empty"] == "empty" and got["empty"].note == "无法读取文件"
    flags = {n: (r.is_encrypted, r.is_pseudo, r.note) for n, r in got.items()}
    assert flags["plain.zip"] == (False, False, "")
    assert flags["locked.zip"] == (True, False, "加密")
    assert flags["pseudo.ZIP"] == (True, True, "伪加密")
    assert flags["locked.dat"] == (False, False, "")


def test_uploaded_files(spark):
    rows = [(".a.txt", "机密".encode()), ("b.txt", b""), ("c.ppt", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1.."), ("d.zip", PSEUDO_ENCRYPTED)]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: (r.note, r.is_hidden) for r in scan_files(files, ScanConfig(), uploaded=True).collect()}
    assert got == {
        ".a.txt": ("", False),
        "b.txt": ("空文件", False),
        "c.ppt": ("无法读取文本内容，legacy .ppt requires LibreOffice soffice", False),
        "d.zip": ("伪加密", False),
    }
    assert "**目标" not in report_text(file_report(scan_files(files, ScanConfig(), True), "t", "md", True))


def contents(spark, values):
    return spark.createDataFrame(
        [(i, bytearray(v)) for i, v in enumerate(values)], "id int, content binary"
    )


def test_every_signature(spark):
    names = list(FILE_SIGNATURES)
    df = contents(spark, [FILE_SIGNATURES[n] + b" tail" for n in names])
    got = df.select("id", file_type(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == names


def test_text_or_binary(spark):
    cases = {
        b"plain\tascii\r\n": True,
        b"": False,
        b"zero\x00byte": False,
        b"a" * 1200 + b"\x00": False,
        b"a" * 70 + b"\x80" * 30: True,
        b"a" * 69 + b"\x80" * 31: False,
        UTF8_CHINESE: False,
    }
    df = contents(spark, list(cases))
    got = df.select("id", is_text(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == list(cases.values())


def test_images_and_audio(spark):
    values = [*IMAGE_SIGNATURES, b"", b"none"]
    df = contents(spark, values)
    body = F.col("content")
    got = df.select("id", image_type(body).alias("t"), is_image(body).alias("i")).orderBy("id").collect()
    assert [r.t for r in got] == [*IMAGE_SIGNATURES.values(), "unknown", "unknown"]
    assert [r.i for r in got] == [True] * len(IMAGE_SIGNATURES) + [False, False]
    values = [*AUDIO_SIGNATURES, *[b"\x00\x00\x00\x20ftyp" + b.encode() for b in AUDIO_BRANDS], b"\x00\x00\x00\x20ftypqt  ", b""]
    df = contents(spark, values)
    got = df.select("id", audio_type(body).alias("t"), is_audio(body).alias("i")).orderBy("id").collect()
    assert [r.t for r in got] == [*AUDIO_SIGNATURES.values(), *["m4a"] * len(AUDIO_BRANDS), None, None]
    assert [r.i for r in got][-2:] == [False, False]


def test_names(spark):
    rows = [("a/b.TXT", "text"), ("a/.bashrc", "text"), ("x.jpeg", "jpg"), ("x.doc", "docx"), ("x", "pdf"), ("a.b/c", "zip")]
    df = spark.createDataFrame(rows, "path string, t string")
    got = df.select(
        extension(F.col("path")).alias("e"),
        is_hidden(F.col("path")).alias("h"),
        extension_mismatch(F.col("t"), F.col("path")).alias("m"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("txt", False, False),
        ("", True, False),
        ("jpeg", False, False),
        ("doc", False, True),
        ("", False, True),
        ("", False, True),
    ]


def plain_decode(data):
    for codec in ("utf-8", "gbk"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", errors="ignore")


def test_decoding(spark):
    values = [b"", b"ascii", "保密".encode(), "保密".encode("gbk"), b"\xff\xfe\xff", gzip.compress(b"x" * 50), bytes(range(256)), "保".encode()[:2], b"a\xed\xa0\x80b"]
    got = contents(spark, values).select("id", decode_text(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == [plain_decode(v) for v in values]


def test_zip_headers():
    assert zip_flags(PLAIN_ZIP) == {"is_encrypted": False, "is_pseudo": False}
    assert zip_flags(LOCAL_ENCRYPTED) == {"is_encrypted": True, "is_pseudo": False}
    assert zip_flags(PSEUDO_ENCRYPTED) == {"is_encrypted": True, "is_pseudo": True}
    second = PLAIN_ZIP.rfind(b"PK\x03\x04")
    late = bytearray(PLAIN_ZIP)
    struct.pack_into("<H", late, second + 6, 0x40)
    assert zip_flags(bytes(late))["is_encrypted"]
    assert zip_flags(b"") == zip_flags(b"PK\x03\x04") == {"is_encrypted": False, "is_pseudo": False}


def test_office_details():
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = (
        f'<worksheet xmlns="{sheet}"><sheetData><row><c><v>1</v></c><c t="inlineStr"><is><r><t>a</t></r>'
        "<r><t>b</t></r></is></c></row><row><c/></row></sheetData></worksheet>"
    )
    rid = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    without_shared = archive(
        {
            "_rels/.rels": relations({"xl/workbook.xml": "officeDocument"}),
            "xl/_rels/workbook.xml.rels": relations({"/xl/worksheets/sheet1.xml": "worksheet"}),
            "xl/workbook.xml": f'<workbook xmlns="{sheet}" {rid}><sheet r:id="r1"/></workbook>'.encode(),
            "xl/worksheets/sheet1.xml": body.encode(),
        }
    )
    assert read_office("xlsx", without_shared) == "1\tab"
    slides = pptx_bytes([f"s{i}" for i in range(1, 12)])
    assert read_office("pptx", slides).split("\n")[-2:] == ["===== Slide 11 =====", "s11"]
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    text = "<p:txBody><a:p><a:r><a:t>{}</a:t></a:r><a:br/><a:fld><a:t>f</a:t></a:fld></a:p><a:p/></p:txBody>"
    slide = (
        f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:sp>{text.format("top")}</p:sp><p:grpSp><p:sp>{text.format("in")}'
        "</p:sp></p:grpSp><a:tbl><a:tc><a:txBody><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:txBody></a:tc></a:tbl></p:sld>"
    )
    notes = f'<p:notes xmlns:p="{p}" xmlns:a="{a}"><p:sp><p:txBody><a:p><a:r><a:t>note</a:t></a:r></a:p></p:txBody></p:sp></p:notes>'
    deck = archive(
        {
            "_rels/.rels": relations({"ppt/presentation.xml": "officeDocument"}),
            "ppt/_rels/presentation.xml.rels": relations({"slides/b.xml": "slide", "slides/a.xml": "slide"}),
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" {rid}><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:presentation>'.encode(),
            "ppt/slides/b.xml": slide.encode(),
            "ppt/slides/_rels/b.xml.rels": relations({"../notesSlides/n.xml": "notesSlide"}),
            "ppt/notesSlides/n.xml": notes.encode(),
            "ppt/slides/a.xml": b"<broken",
        }
    )
    assert read_office("pptx", deck) == "===== Slide 1 =====\ntop\nf\nin\nf\ncell\nnote"
    assert read_office("docx", b"no zip") == ""


@pytest.mark.parametrize("split_bytes", [1, 3, 7, 64, 10_000])
def test_text_files_in_pieces_equal_whole_ones(spark, tmp_path, split_bytes):
    config = ScanConfig("秘密,tion", "regex", 1)
    contents = {
        "utf8.txt": "一 秘密\n\nx\r\nna tion 秘1密\nend".encode(),
        "gbk.txt": "第一行\n机密 秘密\n".encode("gbk"),
        "neither.txt": b"\xff\xfe tion\n" + "秘密".encode() + b"\xff\n\n",
        "empty.txt": b"",
        "feeds.txt": b"\n\n\n",
        "one line": ("long " * 40 + "tion").encode(),
        ".hidden": b"tion",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    folder = f"file://{tmp_path}"
    found = scan_text_files(spark, folder, config, split_bytes=split_bytes).collect()
    whole = spark.createDataFrame(list(contents.items()), "name string, content binary")
    texts = {r.name: r.text for r in whole.select("name", decode_text(F.col("content")).alias("text")).collect()}
    want = sorted((n, *h) for n, t in texts.items() for h in brute.hits(t, config))
    assert sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in found) == want and len(want) == 7


def test_pieces_of_a_file_go_to_many_tasks(spark, tmp_path):
    (tmp_path / "large.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    pieces = read_text_splits(spark, f"file://{tmp_path}", split_bytes=4096)
    rows = pieces.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 8
    assert sorted((r.first_line, r.text.split("\n")[0]) for r in rows if r.text)[-1][1].startswith("line 19")
    assert all(r.text.startswith(f"line {r.first_line - 1}") for r in rows if r.text)
