import re
from datetime import datetime, timedelta
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from lineward.config import RESULT_TTL_SECONDS, ScanConfig
from lineward.functions.fingerprint import fingerprint, store_key
from lineward.operators.scan import scan_targets
from lineward.operators.store import (
    clear_store,
    empty_store,
    flagged,
    known_results,
    live_entries,
    pending,
    prune_store,
    read_store,
    reuse_results,
    scan_incremental,
    scan_unique,
    store_entries,
    store_stats,
    with_fingerprint,
    without_kind,
    write_store,
)
import lineward.operators.store as store_module
from lineward.operators.media import scan_new_media
from lineward.plans.files import scan_new_files
from lineward.plans.web import scan_new_pages

CONFIG = ScanConfig("秘密,机密", "regex", 0)
NOW = datetime(2024, 5, 1, 12, 0, 0)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def stored(spark, kind, at, *texts):
    rows = with_fingerprint(docs(spark, *texts), "text", CONFIG)
    return store_entries(scan_targets(rows, ["id"], "text", CONFIG, ["fp"]), kind, at)


def test_fingerprint_is_the_md5_of_content_and_configuration(spark):
    df = docs(spark, "秘密 x").withColumn("raw", F.encode("text", "UTF-8"))
    row = df.select(
        fingerprint(F.col("text"), CONFIG).alias("t"),
        fingerprint(F.col("raw"), CONFIG).alias("b"),
        store_key("image", F.col("raw"), CONFIG, "eng").alias("k"),
    ).first()
    expected = md5("秘密 x秘密,机密||regex||0".encode()).hexdigest()
    assert row.t == row.b == expected
    assert row.k == "image:" + md5("秘密 x秘密,机密||ocr:eng||regex||0".encode()).hexdigest()


def test_any_change_of_configuration_changes_the_key():
    keys = {
        ScanConfig(k, a, m).fingerprint_key(o)
        for k in ("a,b", "b,a", "a, b")
        for a in ("regex", "ac")
        for m in (0, 3)
        for o in ("", "eng", "chi_sim+eng")
    }
    assert len(keys) == 36


@pytest.mark.parametrize("kind, seconds", RESULT_TTL_SECONDS.items())
def test_lifetime_ends_on_the_second(spark, kind, seconds):
    store = stored(spark, kind, NOW, "x")
    last = NOW + timedelta(seconds=seconds)
    assert live_entries(store, last - timedelta(microseconds=1)).count() == 1
    assert live_entries(store, last).count() == 0


def test_reuse_under_new_names(spark):
    known = known_results(stored(spark, "file", NOW, "一 秘密", "clean"), "file", NOW)
    rows = with_fingerprint(docs(spark, "new 机密", "clean", "一 秘密", "一 秘密"), "text", CONFIG)
    reused = {r.id: len(r.hits) for r in reuse_results(rows, ["id"], known).collect()}
    assert reused == {1: 0, 2: 1, 3: 1}
    assert [r.id for r in pending(rows, ["id"], known).collect()] == [0]
    whole = {r.id: (r.reused, len(r.hits)) for r in scan_incremental(rows, ["id"], "text", known, CONFIG).collect()}
    assert whole == {0: (False, 1), 1: (True, 0), 2: (True, 1), 3: (True, 1)}


def test_the_newest_entry_counts_and_kinds_are_apart(spark):
    old = stored(spark, "file", NOW - timedelta(days=1), "秘密")
    new = old.withColumn("scanned_at", F.lit("2024-05-01").cast("timestamp")).withColumn(
        "hits", F.array().cast(old.schema["hits"].dataType)
    )
    web = stored(spark, "web", NOW, "other")
    known = known_results(old.unionByName(new).unionByName(web), "file").collect()
    assert [len(r.known_hits) for r in known] == [0]


def test_copies_are_scanned_once_and_all_reported(spark):
    texts = ["hot 秘密"] * 200 + ["x", "机密"] + ["clean"] * 50
    got = scan_unique(docs(spark, *texts), ["id"], "text", CONFIG)
    counts = {r.id: len(r.hits) for r in got.collect()}
    assert counts == {i: int("密" in t) for i, t in enumerate(texts)}


def test_the_filter_misses_no_known_content(spark):
    known = spark.range(0, 3000, 2).select(F.md5(F.col("id").cast("string")).alias("fp"))
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("fp"))
    told = {r.id: r.maybe for r in flagged(rows, known, ["fp"], "maybe", 1500).collect()}
    assert all(told[i] for i in range(0, 3000, 2)) and sum(told.values()) < 1510
    assert not any(r.maybe for r in flagged(rows, known.limit(0), ["fp"], "maybe", 0).collect())


@pytest.mark.parametrize("entries, tags", [(0, 64), (8_000_000, 1), (8_000_000, 10**9)])
def test_reuse_without_a_filter_and_with_small_or_large_blocks(spark, monkeypatch, entries, tags):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(store_module, "FILTER_ENTRIES", entries)
    monkeypatch.setattr(store_module, "BLOCK_TAGS", tags)
    known = known_results(stored(spark, "file", NOW, "一 秘密", "clean"), "file", NOW)
    rows = with_fingerprint(docs(spark, "new 机密", "clean", None, "一 秘密"), "text", CONFIG)
    found = {r.id: (r.reused, len(r.hits)) for r in scan_incremental(rows, ["id"], "text", known, CONFIG).collect()}
    assert found == {0: (False, 1), 1: (True, 0), 2: (False, 0), 3: (True, 1)}
    assert sorted(r.id for r in pending(rows, ["id"], known).collect()) == [0, 2]
    assert sorted(r.id for r in reuse_results(rows, ["id"], known).collect()) == [1, 3]
    unique = scan_unique(docs(spark, "秘密", "x", "秘密", None, None, "x"), ["id"], "text", CONFIG)
    assert {r.id: len(r.hits) for r in unique.collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_contents_that_pass_the_filter_by_chance_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(store_module, "flagged", lambda rows, known, by, name, entries: rows.withColumn(name, F.lit(True)))
    known = known_results(stored(spark, "file", NOW, "clean"), "file", NOW)
    rows = with_fingerprint(docs(spark, "new 机密", "clean"), "text", CONFIG)
    found = {r.id: (r.reused, len(r.hits)) for r in scan_incremental(rows, ["id"], "text", known, CONFIG).collect()}
    assert found == {0: (False, 1), 1: (True, 0)}


def test_a_lookup_shuffles_no_store_and_no_text(spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(stored(spark, "file", NOW, "秘密", "x", "y"), path)
    known = known_results(read_store(spark, path), "file", NOW)
    fps = with_fingerprint(docs(spark, "秘密", "z"), "text", CONFIG).select("fp").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fps.join(known, "fp", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "result_store" in line)
    depth, above = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        found = re.search(r"\w", line)
        if found and found.start() < depth:
            depth = found.start()
            above.append(line)
    assert any("SortMergeJoin" in line for line in above) and "Bucketed: true" in plan
    assert not any("Exchange" in line for line in above)


@pytest.mark.parametrize("most_bytes", [1 << 25, -1])
def test_files_and_media_are_reused_under_other_names(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", most_bytes)
    png, mp3 = b"\x89PNG\r\n\x1a\n", b"ID3"
    rows = [("a/.x.txt", "一 秘密".encode(), None), ("b/y.png", png + b"1", "机密"), ("c/z.mp3", mp3 + b"1", "秘密"), ("d/e.txt", b"", None)]
    files = spark.createDataFrame(rows, "path string, content binary, words string")
    moved = files.withColumn("path", F.concat(F.lit("new/"), F.element_at(F.split("path", r"/\.?"), -1)))
    first = scan_new_files(files, empty_store(spark), CONFIG, NOW)
    again = scan_new_files(moved, store_entries(first, "file", NOW), CONFIG, NOW)
    got = {r.path: (r.reused, len(r.hits), r.file_type, r.note, r.is_hidden) for r in again.collect()}
    assert got["new/x.txt"] == (True, 1, "binary", "", False)
    assert {r.path: r.note for r in first.collect()}["a/.x.txt"] == "隐藏文件"
    assert got["new/e.txt"] == (True, 0, "empty", "无法读取文件", False)
    for kind, name, other in (("image", "y.png", "不是图片文件"), ("audio", "z.mp3", "不是音频文件")):
        first = scan_new_media(files, "words", empty_store(spark), kind, CONFIG, NOW)
        assert not any(r.reused for r in first.collect())
        store = store_entries(first, kind, NOW)
        got = {r.path: r for r in scan_new_media(moved, "words", store, kind, CONFIG, NOW).collect()}
        assert all(r.reused for r in got.values())
        assert [r.path for r in got.values() if len(r.hits)] == [f"new/{name}"]
        assert got["new/x.txt"].note == other and got["new/x.txt"].file_type == "unknown"
        other_reader = scan_new_media(moved, "words", store, kind, CONFIG, NOW, "eng")
        assert not any(r.reused for r in other_reader.collect())


def test_pruning_leaves_the_latest_live_entries(spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(stored(spark, "file", NOW - timedelta(days=1), "秘密", "x"), path)
    write_store(stored(spark, "file", NOW, "秘密"), path)
    write_store(stored(spark, "web", NOW - timedelta(days=2), "秘密"), path)
    prune_store(spark, path, NOW)
    left = [(r.kind, r.scanned_at) for r in read_store(spark, path).collect()]
    assert sorted(left) == [("file", NOW - timedelta(days=1)), ("file", NOW)]


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(stored(spark, "file", NOW, "秘密", "x", "x"), path)
    write_store(stored(spark, "web", NOW, "秘密"), path)
    store = read_store(spark, path)
    assert store.count() == 3 and store_stats(store).first().total_entries == 3
    plan = store.where("kind = 'web'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    assert without_kind(store, "web").count() == 2 and without_kind(store).count() == 0
    clear_store(spark, path, "file")
    assert [r.kind for r in read_store(spark, path).collect()] == ["web"]
    clear_store(spark, path)
    assert read_store(spark, path).count() == 0
    assert store_stats(empty_store(spark)).first().asDict() == {"total_entries": 0, "size_mb": 0.0}


def test_pages_are_reused_by_source(spark):
    pages = spark.createDataFrame([("u", "<p>秘密</p>"), ("v", "<p>机密</p>"), ("w", "")], "url string, html string")
    first = scan_new_pages(pages.where("url = 'u'"), empty_store(spark), CONFIG, NOW)
    store = store_entries(first, "web", NOW)
    moved = pages.withColumn("url", F.concat(F.lit("new-"), "url"))
    got = {r.url: (r.reused, len(r.hits), r.note) for r in scan_new_pages(moved, store, CONFIG, NOW).collect()}
    assert got == {
        "new-u": (True, 1, ""),
        "new-v": (False, 1, ""),
        "new-w": (False, 0, "无法读取页面内容"),
    }
    later = NOW + timedelta(days=1)
    assert not any(r.reused for r in scan_new_pages(moved, store, CONFIG, later).collect())
