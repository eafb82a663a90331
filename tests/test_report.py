import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.match import HITS_TYPE
from lineward.operators.media import audio_results, image_results
from lineward.operators.numbering import numbered
from lineward.operators.report import combined_report, report_text, target_report
from lineward.operators.summary import line_list, overview, per_source, source_summary, verdict
from lineward.plans.media import audio_report, image_report
from lineward.sources.sinks import DEFAULT_REPORT_FORMAT, REPORT_MEDIA_TYPES, write_hits, write_report

AT = "2026-05-12 19:30:00"


def results(spark, rows):
    """Rows of (name, file_type, note, hits)."""
    df = spark.createDataFrame(rows, "path string, file_type string, note string, h array<string>")
    made = F.transform(
        "h",
        lambda h: F.struct(
            F.split(h, r"\|")[0].cast("int").alias("line"),
            F.split(h, r"\|")[1].alias("keyword"),
            F.split(h, r"\|")[2].alias("content"),
            F.split(h, r"\|")[1].alias("matched_text"),
        ),
    )
    return df.withColumn("hits", made.cast(HITS_TYPE)).drop("h")


def both(spark, rows, kind, mode):
    df = results(spark, rows)
    return [report_text(target_report(df, kind, "path", mode, AT, fmt)) for fmt in ("txt", "md")]


def test_page_report(spark):
    txt, md = both(
        spark,
        [("http://example.test", "", "", ["3|秘密|包含秘密内容"]), ("http://z", "", "无法读取页面内容", [])],
        "web",
        "网页爬取检查",
    )
    assert txt.split("\n") == [
        "=" * 60,
        "          网页涉密数据检查报告",
        "=" * 60,
        "检查模式: 网页爬取检查",
        f"检查时间: {AT}",
        "共检查网页数: 2",
        "发现涉密网页数: 1",
        "涉密数据总条数: 1",
        "-" * 60,
        "",
        "【网页 1】http://example.test",
        "  涉密信息 (1 处):",
        "    第3行 | 关键词 [秘密] → 包含秘密内容",
        "",
        "【网页 2】http://z",
        "  备注: 无法读取页面内容",
        "  未发现涉密数据。",
        "=" * 60,
        "报告结束",
    ]
    assert md.split("\n") == [
        "# 网页涉密数据检查报告",
        "",
        "## 检查摘要",
        "",
        "| 项目 | 内容 |",
        "| --- | --- |",
        "| 检查模式 | 网页爬取检查 |",
        f"| 检查时间 | {AT} |",
        "| 共检查网页数 | 2 |",
        "| 发现涉密网页数 | 1 |",
        "| 涉密数据总条数 | 1 |",
        "",
        "## 详细结果",
        "",
        "### 网页 1",
        "**目标：** http://example.test",
        "- **涉密信息：** 1 处",
        "- 第3行 | 关键词 `秘密` | 包含秘密内容",
        "",
        "### 网页 2",
        "**目标：** http://z",
        "- **备注：** 无法读取页面内容",
        "未发现涉密数据。",
    ]


def test_file_report_lists_only_files_with_hits(spark):
    rows = [("clean.txt", "text", "", []), ("demo.txt", "text", "隐藏文件", ["7|绝密|绝密项目"])]
    txt, md = both(spark, rows, "file", "文件路径检查")
    assert "clean.txt" not in txt + md
    assert (
        "检查文件数: 2\n发现涉密文件数: 1\n" + "-" * 60 + "\n详细结果：\n\n【文件】demo.txt\n  类型: text\n"
        "  备注: 隐藏文件\n  涉密信息 (1 处):\n    第7行 | 关键词 [绝密] → 绝密项目\n"
    ) in txt
    assert (
        "### 文件：demo.txt\n- **类型：** text\n- **备注：** 隐藏文件\n- **涉密信息：** 1 处\n"
        "- 第7行 | 关键词 `绝密` | 绝密项目"
    ) in md


@pytest.mark.parametrize("kind, phrase", [("file", "未发现涉密数据。"), ("web", "没有扫描任何网页。")])
def test_empty_reports_say_so(spark, kind, phrase):
    rows = [("a", "text", "", [])] if kind == "file" else []
    txt, md = both(spark, rows, kind, "m")
    assert phrase in txt and phrase in md
    assert "无详细结果。" in both(spark, [], "audio", "m")[1]


def test_image_report_counts_types(spark):
    config = ScanConfig()
    df = spark.createDataFrame(
        [
            ("demo.png", bytearray(b"\x89PNG\r\n\x1a\n"), "机密截图"),
            ("a.jpg", bytearray(b"\xff\xd8\xff"), " "),
            ("b.png", bytearray(b"\x89PNG\r\n\x1a\n"), None),
        ],
        "path string, content binary, ocr string",
    )
    found = image_results(df, "ocr", config, ocr_note="缺少中文OCR语言包")
    notes = {r.path: (r.file_type, r.note) for r in found.collect()}
    assert notes["a.jpg"] == ("jpg/jpeg", "缺少中文OCR语言包；图片中未检测到文字")
    txt = report_text(image_report(found, AT, "txt"))
    assert "扫描图片数: 3\n图片类型分布: \n   jpg/jpeg: 1\n   png: 2\n发现涉密图片数: 1\n涉密数据总行数: 1" in txt
    assert "    区域 1 | 关键词 [机密] → 机密截图" in txt and "备注" not in txt
    md = report_text(image_report(found, AT, "md"))
    assert "### 图片类型分布\n\n| 类型 | 数量 |\n| --- | --- |\n| jpg/jpeg | 1 |\n| png | 2 |" in md
    assert "### 图片 3\n**目标：** demo.png\n- **涉密信息：** 1 处\n- 区域 1 | 关键词 `机密` | 机密截图" in md


def test_audio_report_follows_the_upload_order(spark):
    df = spark.createDataFrame([("z.wav", 0, "泄密语音"), ("a.wav", 1, "")], "path string, i int, words string")
    found = audio_results(df, "words", ScanConfig("泄密"), keep=["i"])
    txt = report_text(audio_report(found, AT, "txt", order="i"))
    assert "【音频 1】z.wav\n  涉密信息 (1 处):\n    时间 1s | 关键词 [泄密] → 泄密语音\n\n【音频 2】a.wav\n  未发现涉密数据。" in txt
    assert [r.note for r in found.orderBy("i").collect()] == ["", "语音识别未能提取文字"]
    assert "- 时间 1s | 关键词 `泄密` | 泄密语音" in report_text(audio_report(found, AT))


def test_markdown_cells_are_escaped(spark):
    _, md = both(spark, [], "web", "a|b\nc")
    assert "| 检查模式 | a\\|b<br>c |" in md


def test_combined_report(spark):
    web = results(spark, [("http://a", "", "", ["10|机密|" + "长" * 81]), ("http://b", "", "", [])])
    rows = spark.createDataFrame([("users", 1000), ("empty", 0)], "table string, total_rows long")
    fields = spark.createDataFrame(
        [("users", 1000, 5, "note", ["机密1", "机密2"])],
        "table string, total_rows long, sensitive_rows long, column string, samples array<string>",
    )
    text = report_text(combined_report({"web": (web, "path")}, AT, ("mysql://db", rows, fields)))
    for fragment in (
        "  检查类型：web, db\n  检查目标总数：3\n  发现涉密信息条目总数：6\n",
        "  │ 网页" + " " * 19 + " │ 2         │ 1         │",
        "  ── 🌐 网页 ──\n\n    1. 来源：http://a\n      发现 1 处涉密信息：\n"
        "        → 第 10 行：关键词“机密”，匹配内容“机密”\n          原文：" + "长" * 81 + "\n\n"
        "    2. 来源：http://b\n      无涉密内容\n\n  ── 🗄️ 数据库 ──\n\n    1. 来源：mysql://db\n      共检查 2 个表：\n",
        "        • 表 users：总计 1000 行，涉密 5 行\n          字段 'note' 包含涉密文本（例如：机密1；机密2）\n\n【三、结论与建议】\n"
        "   ⚠️ 共发现 6 处涉密信息，请立即核查并处理。\n   建议：\n",
    ):
        assert fragment in text, fragment
    assert text.endswith("=" * 70 + "\n报告结束\n" + "=" * 70)
    safe = report_text(combined_report({"web": (web.where("path = 'http://b'"), "path")}, AT))
    assert "   ✅ 未发现涉密信息，安全可靠。" in safe and "数据库" not in safe


def test_rollups(spark):
    df = results(spark, [("a", "text", "", ["1|k|x", "4|k|y"]), ("b", "text", "", [])])
    assert source_summary(df).first().asDict() == {"targets": 2, "hit_targets": 1, "hits": 2}
    lines = {r.path: r.l for r in df.select("path", line_list(F.col("hits")).alias("l")).collect()}
    assert lines == {"a": "第1行; 第4行", "b": "无"}
    rolled = overview(per_source(df, "web", "path"), per_source(df, "file", "path")).collect()
    assert {(r.kind, r.sources, r.hits) for r in rolled} == {("web", 2, 2), ("file", 2, 2), (None, 4, 4)}
    words = spark.createDataFrame([(0,), (3,)], "n long").select(verdict(F.col("n")).alias("v")).collect()
    assert [w.v for w in words] == ["未发现涉密信息，安全可靠。", "共发现 3 处涉密信息，请立即核查并处理。"]


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(1000).select(F.format_string("%04d", F.col("id") * 7919 % 1000).alias("k"))
    got = [(r.k, r.n) for r in numbered(df, ["k"], "n").collect()]
    assert sorted(got) == [(f"{i:04d}", i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_numbers_of_ties_are_the_same_in_every_run(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    first, again = ({r.id: r.n for r in numbered(d, ["k"], "n").collect()} for d in (df, df.repartition(5)))
    assert first == again and sorted(first.values()) == list(range(1, 3001))
    keys = {i: "hot" if i % 3 == 0 else str(i) for i in first}
    assert [keys[i] for i in sorted(first, key=first.get)] == sorted(keys.values())


def test_reports_and_hits_on_disk(spark, tmp_path):
    df = results(spark, [(f"p{i:03d}", "", "", ["1|k|x"]) for i in range(50)])
    report = target_report(df, "web", "path", "m", AT, "txt")
    write_report(report, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == report_text(report) + "\n"
    flat = df.select("path", F.inline("hits"))
    for fmt in ("parquet", "json"):
        write_hits(flat, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 50
    assert DEFAULT_REPORT_FORMAT == "md" and REPORT_MEDIA_TYPES["txt"] == "text/plain"
