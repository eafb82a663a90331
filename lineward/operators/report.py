"""Reports as tables of lines, ``(section, target_no, seq, sort_key, line)``.

Sorting by the first four columns gives the reading order, so a report is built, sorted and written
in parallel. Section 0 is the head with the summary, 1 the details, 2 the foot. Both formats are
rendered from the results themselves.

Times are parameters: a report of the same results is the same report.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineward.functions.text import md_cell, strip
from lineward.operators.numbering import numbered
from lineward.operators.summary import (
    SAFE_VERDICT,
    database_source,
    overview,
    per_source,
    source_summary,
)
from lineward.session import cut
from lineward.sources.sinks import REPORT_ORDER


@dataclass(frozen=True)
class Layout:
    """The wording of one kind of report."""

    title: str
    indent: int
    mode: str
    summary: tuple[str, ...]
    label: str
    place: str
    lists_clean_targets: bool
    type_counts: str = ""
    shows_type: bool = False
    shows_note: bool = False


# Titles, labels and phrases of the reports. The summary labels stand for targets,
# targets with a hit and hits in total, in this order.
LAYOUTS = {
    "web": Layout(
        "网页涉密数据检查报告", 10, "检查模式",
        ("共检查网页数", "发现涉密网页数", "涉密数据总条数"),
        "网页", "第%s行", True, shows_note=True,
    ),
    "file": Layout(
        "文件涉密数据检查报告", 11, "检查方式",
        ("检查文件数", "发现涉密文件数"),
        "文件", "第%s行", False, shows_type=True, shows_note=True,
    ),
    "image": Layout(
        "图片涉密数据检查报告", 10, "检查模式",
        ("扫描图片数", "发现涉密图片数", "涉密数据总行数"),
        "图片", "区域 %s", True, type_counts="图片类型分布",
    ),
    "audio": Layout(
        "音频涉密数据检查报告", 10, "检查模式",
        ("扫描音频数", "发现涉密音频数"),
        "音频", "时间 %ss", True,
    ),
    "db": Layout(
        "数据库涉密数据检查报告", 10, "数据库信息",
        ("扫描表数", "涉密数据条数", "涉及表数"),
        "表名", "行 %s", False,
    ),
}
CHECKED_AT = "检查时间"
NOTHING_FOUND = "未发现涉密数据。"
NOTHING_SCANNED = "没有扫描任何网页。"
DETAILS = "详细结果："
REPORT_END = "报告结束"
RULE = "=" * 60
THIN_RULE = "-" * 60
MD_SUMMARY = "## 检查摘要"
MD_DETAILS = "## 详细结果"
MD_NO_DETAILS = "无详细结果。"
MD_SUMMARY_TABLE = ("| 项目 | 内容 |", "| --- | --- |")
MD_TYPE_TABLE = ("| 类型 | 数量 |", "| --- | --- |")
KIND_LABELS = {"web": "网页", "file": "文件", "image": "图片", "audio": "音频", "db": "数据库"}
KIND_HEADINGS = {
    "web": "🌐 网页",
    "file": "📄 文件",
    "image": "🖼️ 图片",
    "audio": "🎵 音频",
    "db": "🗄️ 数据库",
}

HEAD, BODY, FOOT = 0, 1, 2


def _texts(*lines: str | Column) -> Column:
    return F.array(*[F.lit(l) if isinstance(l, str) else l for l in lines])


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _maybe(condition: Column, lines: Column) -> Column:
    """``lines`` or no lines at all."""
    return F.when(condition, lines).otherwise(_no_lines())


def _frame(df: DataFrame, section: int, lines: Column, target_no: Column | None = None) -> DataFrame:
    """One report line per element of ``lines``."""
    number = F.lit(0) if target_no is None else target_no
    return df.select(
        F.lit(section).alias("section"),
        number.cast("bigint").alias("target_no"),
        F.posexplode(lines).alias("pos", "line"),
    ).select(
        "section",
        "target_no",
        F.col("pos").cast("bigint").alias("seq"),
        F.lit("").alias("sort_key"),
        "line",
    )


def _stack(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _pair(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def _md_row(*values: Column | str) -> Column:
    cells = [md_cell(F.lit(v) if isinstance(v, str) else v.cast("string")) for v in values]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _summary_row(results: DataFrame, layout: Layout) -> DataFrame:
    """One row: the counts, and for images the list of types with their counts."""
    if not layout.type_counts:
        return source_summary(results)
    # One row per file type, of which there are a handful.
    found = F.size("hits")
    per_type = results.groupBy("file_type").agg(
        F.count("*").alias("targets"),
        F.count_if(found > 0).alias("hit_targets"),
        F.sum(found).alias("hits"),
    )
    return per_type.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
        F.sort_array(F.collect_list(F.struct("file_type", F.col("targets")))).alias("types"),
    )


_COUNTS = ("targets", "hit_targets", "hits")


def _head_txt(layout: Layout, mode: str, checked_at: str) -> Column:
    pairs = [_texts(_pair(label, F.col(c))) for label, c in zip(layout.summary, _COUNTS)]
    if layout.type_counts:
        listed = F.transform(
            "types", lambda t: F.concat(F.lit("   "), t["file_type"], F.lit(": "), t["targets"].cast("string"))
        )
        pairs.insert(1, F.concat(_texts(f"{layout.type_counts}: "), listed))
    return F.concat(
        _texts(
            RULE,
            " " * layout.indent + layout.title,
            RULE,
            f"{layout.mode}: {mode}",
            f"{CHECKED_AT}: {checked_at}",
        ),
        *pairs,
        _texts(THIN_RULE),
    )


def _head_md(layout: Layout, mode: str, checked_at: str) -> Column:
    rows = [_md_row(label, F.col(c)) for label, c in zip(layout.summary, _COUNTS)]
    parts = [
        _texts(
            f"# {layout.title}", "", MD_SUMMARY, "", *MD_SUMMARY_TABLE,
            _md_row(layout.mode, mode), _md_row(CHECKED_AT, checked_at), *rows, "",
        )
    ]
    if layout.type_counts:
        parts.append(_texts(f"### {layout.type_counts}", "", *MD_TYPE_TABLE))
        parts.append(F.transform("types", lambda t: _md_row(t["file_type"], t["targets"])))
        parts.append(_texts(""))
    parts.append(_texts(MD_DETAILS, ""))
    return F.concat(*parts)


def _number(hit: Column, layout: Layout) -> Column:
    return F.format_string(layout.place, hit["line"].cast("string"))


def _target_txt(layout: Layout, name: str) -> Column:
    number = F.lit("")
    if layout.lists_clean_targets:
        number = F.concat(F.lit(" "), F.col("target_no").cast("string"))
    found = F.transform(
        "hits",
        lambda h: F.concat(
            F.lit("    "), _number(h, layout), F.lit(" | 关键词 ["), h["keyword"], F.lit("] → "), h["content"]
        ),
    )
    note = F.coalesce(F.col("note"), F.lit(""))
    return F.concat(
        _texts("", F.concat(F.lit(f"【{layout.label}"), number, F.lit("】"), F.col(name))),
        _texts(_pair("  类型", F.col("file_type"))) if layout.shows_type else _no_lines(),
        _maybe((note != "") & F.lit(layout.shows_note), _texts(_pair("  备注", note))),
        F.when(
            F.size("hits") > 0,
            F.concat(_texts(F.format_string("  涉密信息 (%d 处):", F.size("hits"))), found),
        ).otherwise(_texts(f"  {NOTHING_FOUND}")),
    )


def _target_md(layout: Layout, name: str) -> Column:
    target = strip(F.col(name))
    if not layout.lists_clean_targets:
        heading = _texts(F.concat(F.lit(f"### {layout.label}："), target))
    else:
        heading = _texts(
            F.concat(F.lit(f"### {layout.label} "), F.col("target_no").cast("string")),
            F.concat(F.lit("**目标：** "), target),
        )
    found = F.transform(
        "hits",
        lambda h: F.concat(
            F.lit("- "), _number(h, layout), F.lit(" | 关键词 `"), h["keyword"], F.lit("` | "), h["content"]
        ),
    )
    note = F.coalesce(F.col("note"), F.lit(""))
    return F.concat(
        _maybe(F.col("target_no") > 1, _texts("")),
        heading,
        _texts(F.concat(F.lit("- **类型：** "), F.col("file_type"))) if layout.shows_type else _no_lines(),
        _maybe((note != "") & F.lit(layout.shows_note), _texts(F.concat(F.lit("- **备注：** "), note))),
        F.when(
            F.size("hits") > 0,
            F.concat(_texts(F.format_string("- **涉密信息：** %d 处", F.size("hits"))), found),
        ).otherwise(_texts(NOTHING_FOUND)),
    )


def target_report(
    results: DataFrame,
    kind: str,
    name: str,
    mode: str,
    checked_at: str,
    fmt: str = "md",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Report on web, file, image or audio results.

    ``results`` has one row per target: column ``name``, ``hits``, ``note``, and ``file_type`` for
    files and images. Targets are numbered in ``order`` (by name unless given). File reports list
    only files with hits, the others all targets.
    """
    layout = LAYOUTS[kind]
    # Written once: the summary, the numbering and the details all read this copy, not the scan.
    results = cut(results)
    listed = results if layout.lists_clean_targets else results.where(F.size("hits") > 0)
    ranked = numbered(listed, [*(order or ()), name], "target_no")
    summary = _summary_row(results, layout)
    if fmt == "txt":
        head, target = _head_txt(layout, mode, checked_at), _target_txt(layout, name)
        empty = {"web": [NOTHING_SCANNED], "file": [NOTHING_FOUND]}.get(kind, [])
        some = _texts(DETAILS) if kind == "file" else _no_lines()
        foot = [RULE, REPORT_END]
    else:
        head, target = _head_md(layout, mode, checked_at), _target_md(layout, name)
        empty = {"web": [NOTHING_SCANNED], "file": [NOTHING_FOUND]}.get(kind, [MD_NO_DETAILS])
        some = _no_lines()
        foot = []
    shown = F.col("targets") if layout.lists_clean_targets else F.col("hit_targets")
    nothing = F.array(*[F.lit(l) for l in empty]).cast("array<string>")
    frames = [
        _frame(summary, HEAD, F.concat(head, F.when(shown == 0, nothing).otherwise(some))),
        _frame(ranked, BODY, target, F.col("target_no")),
    ]
    if foot:
        frames.append(_frame(summary, FOOT, _texts(*foot)))
    return _stack(*frames)


def table_report(
    found: DataFrame, stats: DataFrame, source: str, checked_at: str, fmt: str = "md"
) -> DataFrame:
    """Report on a database: ``found`` from ``table_scan``, ``stats`` from ``table_stats``.

    Hits stay one row each and are put in order by the final sort, so a table with very many hits
    is no single row or task.
    """
    layout = LAYOUTS["db"]
    summary = stats.agg(
        F.count("*").alias("targets"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hit_targets"),
        F.count_if("affected").alias("hits"),
    )
    # One row per table of the database.
    affected = stats.where("affected").select(
        "table", "hits", F.row_number().over(Window.orderBy("table")).alias("target_no")
    )
    count = F.format_string("共 %d 条", "hits")
    if fmt == "txt":
        head = _head_txt(layout, source, checked_at)
        some, nothing, foot = _texts(DETAILS), _texts(NOTHING_FOUND), [RULE, REPORT_END]
        heading = _texts("", F.concat(F.lit("【表名】"), "table", F.lit(" ("), count, F.lit(")")))
        line = F.concat(
            F.lit("  行 "), "row_pk", F.lit(" | 字段 "), "column",
            F.lit(" | 关键词 ["), "keyword", F.lit("] → "), "content",
        )
    else:
        head = _head_md(layout, source, checked_at)
        some, nothing, foot = _no_lines(), _texts(NOTHING_FOUND), []
        heading = F.concat(
            _maybe(F.col("target_no") > 1, _texts("")),
            _texts(F.concat(F.lit("### 表名："), "table"), F.concat(F.lit("- **命中数：** "), count)),
        )
        line = F.concat(
            F.lit("- 行 `"), "row_pk", F.lit("` | 字段 `"), "column",
            F.lit("` | 关键词 `"), "keyword", F.lit("` | "), "content",
        )
    detail = found.join(F.broadcast(affected.select("table", "target_no")), "table").select(
        F.lit(BODY).alias("section"),
        F.col("target_no").cast("bigint").alias("target_no"),
        F.lit(10).cast("bigint").alias("seq"),
        F.concat_ws("\x01", "row_pk", "column", "keyword", "content").alias("sort_key"),
        line.alias("line"),
    )
    frames = [
        _frame(summary, HEAD, F.concat(head, F.when(F.col("hit_targets") == 0, nothing).otherwise(some))),
        _frame(affected, BODY, heading, F.col("target_no")),
        detail,
    ]
    if foot:
        frames.append(_frame(summary, FOOT, _texts(*foot)))
    return _stack(*frames)


# Frame and phrases of the combined report.
_WIDE_RULE = "=" * 70
_BOX_TOP = "  ┌───────────────────────┬───────────┬───────────┐"
_BOX_HEAD = "  │ 类型                  │ 目标数量  │ 涉密条目  │"
_BOX_MID = "  ├───────────────────────┼───────────┼───────────┤"
_BOX_END = "  └───────────────────────┴───────────┴───────────┘"
_ADVICE = (
    "   建议：",
    "     1. 对涉密文件/数据进行脱敏或隔离；",
    "     2. 修改相关权限设置，限制访问；",
    "     3. 提交审计追踪，追究责任。",
)


def combined_report(
    targets: dict[str, tuple[DataFrame, str]],
    generated_at: str,
    database: tuple[str, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Overview of several kinds of sources in three parts.

    ``targets`` maps a kind to ``(results, name column)``; ``database`` is ``(source, table rows,
    field stats)``. A kind without any target does not appear.
    """
    kinds = list(KIND_LABELS)
    targets = {
        kind: (cut(df.select(F.col(name).cast("string").alias(name), "hits")), name)
        for kind, (df, name) in targets.items()
    }
    parts = [per_source(df, kind, name) for kind, (df, name) in targets.items()]
    if database:
        parts.append(database_source(database[2], database[0]))
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    # One row per kind: five at most.
    totals = overview(*parts).agg(
        F.sort_array(
            F.collect_list(
                F.when(F.col("kind").isNotNull(), F.struct(rank.alias("rank"), "kind", "sources", "hits"))
            )
        ).alias("kinds"),
        F.coalesce(F.max(F.when(F.col("kind").isNull(), F.col("sources"))), F.lit(0)).alias("sources"),
        F.coalesce(F.max(F.when(F.col("kind").isNull(), F.col("hits"))), F.lit(0)).alias("hits"),
    )
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    box = F.transform(
        "kinds",
        lambda k: F.concat(
            F.lit("  │ "), F.rpad(labels[k["kind"]], 21, " "),
            F.lit(" │ "), F.rpad(k["sources"].cast("string"), 9, " "),
            F.lit(" │ "), F.rpad(k["hits"].cast("string"), 9, " "), F.lit(" │"),
        ),
    )
    head = F.concat(
        _texts(
            _WIDE_RULE, "        涉密信息检查报告", _WIDE_RULE, f"生成时间：{generated_at}", "",
            "【一、总览】",
            F.concat(F.lit("  检查类型："), F.array_join(F.col("kinds.kind"), ", ")),
            F.concat(F.lit("  检查目标总数："), F.col("sources").cast("string")),
            F.concat(F.lit("  发现涉密信息条目总数："), F.col("hits").cast("string")),
            "", _BOX_TOP, _BOX_HEAD, _BOX_MID,
        ),
        box,
        _texts(_BOX_END, "", "【二、详细结果】", ""),
    )
    alarm = F.format_string("   ⚠️ 共发现 %d 处涉密信息，请立即核查并处理。", "hits")
    foot = F.concat(
        _texts("【三、结论与建议】"),
        F.when(F.col("hits") == 0, _texts(f"   ✅ {SAFE_VERDICT}")).otherwise(_texts(alarm, *_ADVICE)),
        _texts("", _WIDE_RULE, REPORT_END, _WIDE_RULE),
    )
    frames = [_frame(totals, HEAD, head), _frame(totals, FOOT + len(kinds), foot)]

    def section_of(kind: str) -> int:
        return BODY + kinds.index(kind)

    def heading(kind: str) -> DataFrame:
        present = totals.where(F.exists("kinds", lambda k: k["kind"] == kind))
        return _frame(present, section_of(kind), _texts(f"  ── {KIND_HEADINGS[kind]} ──", ""))

    def quoted(h: Column) -> Column:
        return F.concat(
            _texts(
                F.concat(
                    F.lit("        → 第 "), h["line"].cast("string"), F.lit(" 行：关键词“"), h["keyword"],
                    F.lit("”，匹配内容“"), h["matched_text"], F.lit("”"),
                )
            ),
            _maybe(h["content"] != "", _texts(F.concat(F.lit("          原文："), h["content"]))),
        )

    for kind, (results, name) in targets.items():
        ranked = numbered(results.withColumnRenamed(name, "source"), ["source"], "target_no")
        lines = F.concat(
            _texts(F.concat(F.lit("    "), F.col("target_no").cast("string"), F.lit(". 来源："), "source")),
            F.when(F.size("hits") == 0, _texts("      无涉密内容")).otherwise(
                F.concat(
                    _texts(F.format_string("      发现 %d 处涉密信息：", F.size("hits"))),
                    F.flatten(F.transform("hits", quoted)),
                )
            ),
            _texts(""),
        )
        frames += [heading(kind), _frame(ranked, section_of(kind), lines, F.col("target_no"))]

    if database:
        source, rows, stats = database
        # One row per sensitive field of the database, three samples each.
        fields = stats.groupBy("table").agg(
            F.first("sensitive_rows").alias("sensitive_rows"),
            F.sort_array(F.collect_list(F.struct("column", "samples"))).alias("fields"),
        )
        per_table = rows.join(fields, "table", "left").select(
            "table", "total_rows", F.coalesce("sensitive_rows", F.lit(0)).alias("sensitive_rows"),
            F.coalesce("fields", F.array().cast("array<struct<column:string,samples:array<string>>>")).alias("fields"),
            (F.row_number().over(Window.orderBy("table")) + 1).alias("target_no"),
        )
        intro = rows.agg(F.count("*").alias("tables"))
        table_lines = F.concat(
            _texts(
                F.format_string("        • 表 %s：总计 %d 行，涉密 %d 行", "table", "total_rows", "sensitive_rows")
            ),
            F.transform(
                "fields",
                lambda f: F.concat(
                    F.lit("          字段 '"), f["column"], F.lit("' 包含涉密文本（例如："),
                    F.array_join(f["samples"], "；"), F.lit("）"),
                ),
            ),
        )
        frames += [
            heading("db"),
            _frame(
                intro, section_of("db"),
                F.concat(
                    _texts(f"    1. 来源：{source}"),
                    F.when(F.col("tables") == 0, _texts("      无涉密表")).otherwise(
                        _texts(F.format_string("      共检查 %d 个表：", "tables"))
                    ),
                ),
                F.lit(1),
            ),
            _frame(per_table, section_of("db"), table_lines, F.col("target_no")),
            _frame(intro, section_of("db"), _texts(""), F.lit(2**31 - 1)),
        ]
    return _stack(*frames)


def report_text(report: DataFrame) -> str:
    """A small report as one string (for display; use ``write_report`` for large ones)."""
    return "\n".join(r["line"] for r in report.orderBy(*REPORT_ORDER).select("line").collect())
