"""Scanning every text column of every table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lineward.config import ScanConfig
from lineward.functions.match import hits, searched, text_may_hit
from lineward.sources.tables import Table, text_columns

SAMPLES_PER_FIELD = 3


def row_key(table: Table) -> Column:
    """The key column as text; without one, a hash of the row (offsets mean nothing in Spark)."""
    if table.key:
        return F.col(table.key).cast("string")
    plain = [
        F.col(f.name).cast("string").alias(f.name)
        for f in table.data.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    ]
    # Written as JSON, values cannot run into each other and null differs from an empty value.
    return F.md5(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}))


def table_cells(table: Table) -> DataFrame | None:
    """``(table, row_no, row_pk, column, value)`` of all non-empty text cells; None without text columns.

    ``row_no`` tells rows apart whose keys are equal. It is only good within one written result.
    """
    columns = text_columns(table.data)
    if not columns:
        return None
    rows = table.data.select(
        F.lit(table.name).alias("table"),
        F.monotonically_increasing_id().alias("row_no"),
        row_key(table).alias("row_pk"),
        *columns,
    )
    cells = rows.unpivot(["table", "row_no", "row_pk"], columns, "column", "value")
    return cells.where(F.col("value") != "")


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_hits(tables: Sequence[Table], config: ScanConfig) -> DataFrame:
    """``(table, row_no, row_pk, column, keyword, content)`` for every hit in every text cell.

    Most cells are short and hit nothing: a filter in generated code drops those before the hits
    of the others are put into arrays.
    """
    cells = _united([c for c in (table_cells(t) for t in tables) if c is not None])
    if config.keyword_list:
        cells = cells.where(text_may_hit(searched(F.col("value"), config), config))
    found = cells.select(
        "table", "row_no", "row_pk", "column", F.inline(hits(F.col("value"), config))
    )
    return found.select("table", "row_no", "row_pk", "column", "keyword", "content")


def table_scan(tables: Sequence[Table], config: ScanConfig) -> DataFrame:
    """``(table, row_pk, column, keyword, content)`` for every hit in every text cell."""
    return table_hits(tables, config).drop("row_no")


def table_rows(tables: Sequence[Table]) -> DataFrame:
    """``(table, total_rows)`` of all tables, text columns or not; counted from file footers."""
    return _united(
        [
            t.data.agg(F.count("*").alias("total_rows")).select(
                F.lit(t.name).alias("table"), "total_rows"
            )
            for t in tables
        ]
    )


def table_stats(found: DataFrame, tables: Sequence[Table]) -> DataFrame:
    """Hits per table, zero included: ``(table, hits, affected)``."""
    names = table_rows(tables).select("table")
    counts = found.groupBy("table").agg(F.count("*").alias("hits"))
    total = F.coalesce("hits", F.lit(0))
    return names.join(counts, "table", "left").select(
        "table", total.alias("hits"), (total > 0).alias("affected")
    )


def scan_totals(stats: DataFrame) -> DataFrame:
    """Tables scanned, tables affected and hits in total."""
    return stats.agg(
        F.count("*").alias("tables_scanned"),
        F.count_if("affected").alias("tables_affected"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
    )


def field_samples(found: DataFrame, samples: int = SAMPLES_PER_FIELD) -> DataFrame:
    """The first hits of each field, by row key: ``(table, column, place, content)``.

    Spark keeps the first few rows of each group before the shuffle, so a field that holds most of
    the hits costs no more than any other.
    """
    order = Window.partitionBy("table", "column").orderBy("row_pk", "content", "keyword")
    return (
        found.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= samples)
        .select("table", "column", "place", "content")
    )


def field_stats(found: DataFrame, tables: Sequence[Table]) -> DataFrame:
    """Per sensitive field: ``(table, total_rows, sensitive_rows, column, samples)``.

    ``found`` is a written result of ``table_hits``. Rows are counted, not their keys.
    """
    rows = found.groupBy("table").agg(F.countDistinct("row_no").alias("sensitive_rows"))
    samples = (
        field_samples(found)
        .groupBy("table", "column")
        .agg(F.sort_array(F.collect_list(F.struct("place", "content"))).alias("picked"))
        .select("table", "column", F.col("picked.content").alias("samples"))
    )
    return (
        samples.join(rows, "table")
        .join(table_rows(tables), "table")
        .select("table", "total_rows", "sensitive_rows", "column", "samples")
    )
