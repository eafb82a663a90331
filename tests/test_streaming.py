import pytest
from pyspark.sql import functions as F

import lineward.operators.store as store
import lineward.streaming.incremental as incremental
from lineward.config import ScanConfig
from lineward.operators.scan import flat_hits, scan_text
from lineward.operators.store import read_store
from lineward.streaming.incremental import scan_arrivals, scan_stream, write_stream

CONFIG = ScanConfig("秘密,机密", "regex", 1)
ROWS = [(1, "一 秘密", 0), (2, "x", 1), (3, "一 秘密", 2), (4, "机1密\n秘密", 3)]


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "id int, text string, s int")
    df.select("id", "text", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema("id int, text string, at timestamp").parquet(folder)


def test_stream_scan_equals_batch_scan_and_goes_on_after_a_restart(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for rows in (ROWS[:2], ROWS[2:]):
        arrive(spark, inbox, rows)
        stream = scan_stream(source(spark, inbox), ["id"], "text", CONFIG)
        write_stream(stream, out, marks).awaitTermination()
    batch = scan_text(spark.read.parquet(inbox), ["id"], "text", CONFIG)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("most_bytes", [1 << 25, -1])
def test_copies_are_reported_with_stored_hits_over_restarts(spark, tmp_path, monkeypatch, most_bytes):
    monkeypatch.setattr(store, "BROADCAST_BYTES", most_bytes)
    inbox, out, marks, known = (str(tmp_path / n) for n in ("in", "out", "marks", "store"))
    for rows in (ROWS[:2], ROWS[2:], [(5, "x", 90_000), (6, "一 秘密", 90_001), (7, None, 90_002)]):
        arrive(spark, inbox, rows)
        stream = source(spark, inbox)
        scan_arrivals(stream, ["id"], "text", "at", CONFIG, known, out, marks).awaitTermination()
    found = spark.read.parquet(out)
    batch = scan_text(spark.read.parquet(inbox), ["id"], "text", CONFIG)
    assert sorted(map(tuple, flat_hits(found, ["id"]).collect())) == sorted(map(tuple, batch.collect()))
    # The third batch comes a day later, when stored results of pages have lapsed.
    assert {r.id: r.reused for r in found.collect()} == {
        1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False
    }
    entries = read_store(spark, known)
    assert entries.count() == 6 and entries.select("fp").distinct().count() == 4


def test_an_interrupted_batch_is_written_over(spark, tmp_path, monkeypatch):
    inbox, out, marks, known = (str(tmp_path / n) for n in ("in", "out", "marks", "store"))
    arrive(spark, inbox, ROWS)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "write_store", fail)
        with pytest.raises(Exception, match="lost"):
            scan_arrivals(source(spark, inbox), ["id"], "text", "at", CONFIG, known, out, marks).awaitTermination()
    scan_arrivals(source(spark, inbox), ["id"], "text", "at", CONFIG, known, out, marks).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
