"""All tables of a database to hits, statistics and report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lineward.config import ScanConfig
from lineward.operators.database import field_stats, table_hits, table_stats
from lineward.operators.report import table_report
from lineward.session import cut
from lineward.sources.tables import Table


@dataclass(frozen=True)
class DatabaseScan:
    hits: DataFrame
    tables: DataFrame
    fields: DataFrame


def scan_database(tables: Sequence[Table], config: ScanConfig) -> DatabaseScan:
    """Scan once; the hits are written to the checkpoint folder and all statistics read them there."""
    found = cut(table_hits(tables, config))
    return DatabaseScan(found.drop("row_no"), table_stats(found, tables), field_stats(found, tables))


def database_report(
    scan: DatabaseScan, source: str, checked_at: str, fmt: str = "md"
) -> DataFrame:
    return table_report(scan.hits, scan.tables, source, checked_at, fmt)
