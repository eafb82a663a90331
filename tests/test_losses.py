"""Results that must not be lost: page versions, notes of stored pages, rows with equal keys, cleared stores."""

from datetime import datetime

from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.operators.database import row_key
from lineward.operators.store import (
    clear_store,
    read_store,
    store_entries,
    with_fingerprint,
    write_store,
)
from lineward.plans.database import scan_database
from lineward.plans.web import scan_new_pages, scan_pages
from lineward.sources.files import list_files
from lineward.sources.tables import Table

CONFIG = ScanConfig("秘密,机密", "ac")
AT, NOW = datetime(2024, 1, 1), datetime(2024, 1, 1, 1)


def test_all_versions_of_a_page_count(spark):
    rows = [("http://d/", "<p>秘密</p>"), ("http://d/", "<p>nothing</p>"), ("http://d/", "<p>机密</p>"), ("http://d/", "<p>机密</p>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    found = scan_pages(pages, CONFIG).collect()
    assert len(found) == 1 and sorted(h.keyword for h in found[0].hits) == ["机密", "秘密"]


def test_stored_pages_keep_their_note(spark):
    pages = spark.createDataFrame([("http://e/", "<p></p>"), ("http://f/", "<p>秘密</p>")], "url string, html string")
    first = with_fingerprint(pages, "html", CONFIG).select("url", "fp").join(scan_pages(pages, CONFIG), "url")
    want = {r.url: r.note for r in first.collect()}
    again = scan_new_pages(pages, store_entries(first, "web", AT), CONFIG, NOW).collect()
    assert all(r.reused for r in again) and {r.url: r.note for r in again} == want
    assert want["http://e/"] != ""


def test_rows_are_counted_not_keys(spark):
    keyless = spark.createDataFrame([("秘密",), ("秘密",), ("x",)], "a string")
    turns = spark.createDataFrame([(1, "秘密"), (1, "机密"), (2, "x")], "conv int, a string")
    fields = scan_database([Table("keyless", keyless), Table("turns", turns, "conv")], CONFIG).fields
    assert {r.table: (r.total_rows, r.sensitive_rows) for r in fields.collect()} == {"keyless": (3, 2), "turns": (3, 2)}


def test_row_keys_do_not_run_together(spark):
    rows = [("a|", "b"), ("a", "|b"), (None, "b"), ("", "b")]
    table = Table("t", spark.createDataFrame(rows, "x string, y string"))
    assert table.data.select(row_key(table).alias("k")).distinct().count() == 4


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "file").write_text("x")
    (tmp_path / "a" / "b" / "loop").symlink_to(tmp_path)
    assert [r.path.rpartition("/")[2] for r in list_files(spark, f"file://{tmp_path}").collect()] == ["file"]


def test_clearing_under_dynamic_overwriting(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("k", "text")], "key string, text string")
    scanned = with_fingerprint(rows, "text", CONFIG).withColumn("hits", F.array().cast("array<struct<line:int,keyword:string,content:string,matched_text:string>>"))
    write_store(store_entries(scanned, "web", AT), path)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        clear_store(spark, path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_store(spark, path).count() == 0
