"""Consecutive numbers over a globally ordered table, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineward.session import cut

_ROW_BITS = 33  # monotonically_increasing_id() keeps the row number in its lower 33 bits


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in the given order; rows that tie go by a hash of their other columns.

    ``df`` is read twice, so it should be a table or a cut result rather than a scan. Rows are range-partitioned
    and sorted, with the hash as last key, so that one value held by very many rows is divided too; the sorted
    copy is written once, which fixes where each row stands. The offset of a partition comes from the row counts of the partitions before it, a
    table with one row per partition.
    """
    others = [f.name for f in df.schema if f.name not in order and "map<" not in f.dataType.simpleString()]
    tied = df.withColumn("_tie", F.xxhash64(*others) if others else F.lit(0).cast("long"))
    keys = [*order, "_tie"]
    # Without a fixed number of partitions, adaptive execution merges small ones.
    ordered = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    fixed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = fixed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    row = F.col("_at") - F.shiftleft("_part", _ROW_BITS)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row + 1)
        .drop("_at", "_part", "_before")
    )
