"""Helpers shared by the operators: reading tables, written intermediates, hash splits."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.session import checkpoint_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows with whole texts that a task holds at once.
TEXT_ROWS = 1000
# Written tables of keys up to this number of rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but for those written as ``kept``.

    What is returned from within must not read the deleted ones any more. Shuffle files of the finished jobs
    go as well, as soon as the driver drops its references to them.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for folder in scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()


def written(
    df: DataFrame, name: str, batch_rows: int | None = None, kept: bool = False, compression: str | None = None
) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    A lost executor then costs no recomputation, and every reader takes only the columns it needs.
    ``batch_rows`` bounds the rows that an Arrow function of ``df`` is given at once. ``kept`` makes the table
    outlive the innermost ``scratch``. ``compression`` is a codec of Parquet, for tables that are large on the way.
    """
    scopes = _scopes.__dict__.get("open", [])
    scopes = scopes[:-1] if kept else scopes
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scopes:
        scopes[-1].append(folder)
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, batch_rows or before)
    try:
        df.write.parquet(folder, compression=compression)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(folder)


def small(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) to be broadcast in a join, as long as its counted rows are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to ``rows`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def held_out(parts: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id in decimal, modulo ``parts``, is ``remainder``; rows without id are held out."""
    found = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == remainder
    return F.coalesce(found, F.lit(True))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until it is none of ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
