import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.operators.database import (
    field_samples,
    field_stats,
    row_key,
    scan_totals,
    table_hits,
    table_scan,
    table_stats,
)
from lineward.operators.report import report_text
from lineward.plans.database import database_report, scan_database
from lineward.sources.tables import (
    Table,
    is_text_type,
    jdbc_listing,
    jdbc_reader_options,
    read_catalog_tables,
    scanned_columns,
    text_columns,
)

CONFIG = ScanConfig()


@pytest.fixture(scope="module")
def tables(spark):
    posts = [
        (42, "标题", "保密材料\n第二行 机密" + "x" * 300),
        (43, None, ""),
        (44, "秘密", "n"),
        (45, "绝密", None),
        (46, "内部", "内部"),
        (47, "涉密", "n"),
    ]
    return [
        Table("posts", spark.createDataFrame(posts, "id int, title string, content string"), "id"),
        Table("numbers", spark.createDataFrame([(1, 2.0)], "a int, b double")),
        Table("notes", spark.createDataFrame([("无", 1), ("密级", 2)], "note string, n int")),
        Table("clean", spark.createDataFrame([("a",)], "t string")),
    ]


def test_scanned_types():
    for name in ("VARCHAR(20)", "char", "TinyText", "longblob", "json", "enum('a')", "set"):
        assert is_text_type(name)
    for name in ("int", "tinyblob", "datetime", "", None, "binary"):
        assert not is_text_type(name)


def test_text_columns_skip_everything_else(spark):
    df = spark.createDataFrame([], "a int, b string, c array<float>, d binary, e timestamp")
    assert text_columns(df) == ["b"]


def test_scan_of_all_tables(spark, tables):
    found = table_scan(tables, CONFIG).collect()
    got = sorted((r.table, r.row_pk, r.column, r.keyword) for r in found if r.table == "posts")
    assert got == [
        ("posts", "42", "content", "保密"),
        ("posts", "42", "content", "机密"),
        ("posts", "44", "title", "秘密"),
        ("posts", "45", "title", "绝密"),
        ("posts", "46", "content", "内部"),
        ("posts", "46", "title", "内部"),
        ("posts", "47", "title", "涉密"),
    ]
    assert max(len(r.content) for r in found) == 306
    keyless = tables[2]
    expected = keyless.data.where("n = 2").select(row_key(keyless).alias("k")).first().k
    assert [r.row_pk for r in found if r.table == "notes"] == [expected]


def test_statistics(spark, tables):
    found = table_hits(tables, CONFIG)
    stats = table_stats(found, tables)
    assert {r.table: (r.hits, r.affected) for r in stats.collect()} == {
        "posts": (7, True),
        "numbers": (0, False),
        "notes": (1, True),
        "clean": (0, False),
    }
    assert scan_totals(stats).first().asDict() == {"tables_scanned": 4, "tables_affected": 2, "hits": 8}
    fields = {(r.table, r.column): r for r in field_stats(found, tables).collect()}
    title = fields["posts", "title"]
    assert (title.total_rows, title.sensitive_rows) == (6, 5)
    assert title.samples == ["秘密", "绝密", "内部"]
    assert set(fields) == {("posts", "title"), ("posts", "content"), ("notes", "note")}


def test_samples_are_cut_before_the_shuffle(tables):
    plan = field_samples(table_scan(tables, CONFIG))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_only_key_and_text_columns_are_read(spark, tables, tmp_path):
    path = str(tmp_path / "wide")
    tables[0].data.withColumn("n", F.lit(1)).withColumn("d", F.lit(2.0)).write.parquet(path)
    plan = table_scan([Table("wide", spark.read.parquet(path), "id")], CONFIG)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,title:string,content:string>" in text
    assert "Exchange" not in text


def test_report(spark, tables):
    scan = scan_database(tables, CONFIG)
    lines = report_text(database_report(scan, "MySQL localhost:3306/shop", "2026-05-12 19:30:00", "txt")).split("\n")
    assert lines[:9] == [
        "=" * 60,
        "          数据库涉密数据检查报告",
        "=" * 60,
        "数据库信息: MySQL localhost:3306/shop",
        "检查时间: 2026-05-12 19:30:00",
        "扫描表数: 4",
        "涉密数据条数: 8",
        "涉及表数: 2",
        "-" * 60,
    ]
    at = lines.index("【表名】posts (共 7 条)")
    assert lines[at - 1] == "" and lines[at + 1] == "  行 42 | 字段 content | 关键词 [保密] → 保密材料"
    assert lines[9] == "详细结果：" and lines[-2:] == ["=" * 60, "报告结束"]
    md = report_text(database_report(scan, "s", "t", "md"))
    for fragment in (
        "# 数据库涉密数据检查报告",
        "| 涉密数据条数 | 8 |",
        "### 表名：posts\n- **命中数：** 共 7 条\n- 行 `42` | 字段 `content` | 关键词 `保密` | 保密材料",
    ):
        assert fragment in md
    clean = scan_database(tables[3:], CONFIG)
    assert "未发现涉密数据。" in report_text(database_report(clean, "s", "t", "txt"))
    assert "未发现涉密数据。" in report_text(database_report(clean, "s", "t", "md"))


def test_catalog_tables(spark, tables):
    tables[0].data.createOrReplaceTempView("temporary_posts")
    assert all(t.name != "temporary_posts" for t in read_catalog_tables(spark))


def test_jdbc_reads_are_partitioned():
    options = jdbc_reader_options(
        "jdbc:mysql://h/db", "posts", ["id", "title"], ("id", 1, 1000, 20), {"user": "u"}
    )
    assert options["dbtable"] == "(SELECT `id`, `title` FROM `posts`) scanned"
    assert options["numPartitions"] == "20" and options["fetchsize"] == "500"
    assert options["user"] == "u" and "partitionColumn" not in jdbc_reader_options("u", "t", ["a"])


def test_jdbc_listing_keeps_text_columns_and_the_first_key():
    listing = [
        ("posts", "id", "bigint", 1),
        ("posts", "part", "int", True),
        ("posts", "title", "VARCHAR(20)", 0),
        ("posts", "body", "longtext", False),
        ("numbers", "n", "int", 1),
        ("log", "line", "TEXT", None),
    ]
    assert scanned_columns(listing) == {
        "log": (None, ["line"]),
        "posts": ("id", ["title", "body"]),
    }


def test_jdbc_queries():
    assert "INFORMATION_SCHEMA" in jdbc_listing("mysql", "db")
    assert "sqlite_master" in jdbc_listing("sqlite")
    with pytest.raises(ValueError):
        jdbc_listing("other")
