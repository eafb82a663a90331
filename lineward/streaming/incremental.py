"""Scanning what arrives: the same expressions on a stream.

Matching and extraction are projections, so they run on a stream unchanged. ``scan_arrivals`` keeps what it finds
in a result store and looks every micro-batch up there: a content that arrives again under another name, in another
run or beside a batch job on the same store, is reported with the stored hits and not scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineward.config import ScanConfig
from lineward.functions.match import hits
from lineward.operators.store import (
    known_results,
    read_store,
    scan_with_store,
    store_entries,
    text_scan,
    with_fingerprint,
    write_store,
)


def scan_stream(
    arrivals: DataFrame, keys: list[str], text: str, config: ScanConfig
) -> DataFrame:
    """``(keys..., line, keyword, content, matched_text)`` of a stream of texts."""
    return arrivals.select(*keys, F.inline(hits(F.col(text), config)))


def scan_arrivals(
    arrivals: DataFrame,
    keys: Sequence[str],
    text: str,
    arrived_at: str,
    config: ScanConfig,
    store: str,
    path: str,
    checkpoint: str,
    kind: str = "web",
) -> StreamingQuery:
    """Scan a stream of texts into ``path``: ``(keys..., arrived_at, fp, hits, reused, batch)``.

    Each micro-batch is looked up in the store of that name among the results still valid at its last arrival, by the
    filters and joins of a batch run, and adds what it scans. The result of a batch is written over what an
    interrupted attempt has left of it, before the store learns of it, so a restart neither repeats nor loses
    a row; entries that the store gets twice count once.
    """

    def scan_batch(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max(arrived_at).alias("at")).first()["at"]
        if last is None:
            return
        spark = batch.sparkSession
        rows = with_fingerprint(batch.select(*keys, arrived_at, text), text, config)
        known = known_results(read_store(spark, store), kind, last)
        found = scan_with_store(rows, [*keys, arrived_at], text, known, text_scan(text, config))
        folder = f"{path}/batch={number}"
        found.drop("note", "file_type").write.mode("overwrite").parquet(folder)
        scanned = spark.read.parquet(folder).where("not reused")
        write_store(store_entries(scanned, kind, last), store)

    return (
        arrivals.writeStream.foreachBatch(scan_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_stream(hits_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet folder; restarts go on from ``checkpoint`` on shared storage."""
    return (
        hits_stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
