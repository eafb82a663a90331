"""Reading tables: columnar files, catalog tables and JDBC databases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type-name prefixes of the columns that are scanned.
TEXT_TYPE_PREFIXES = (
    "char",
    "varchar",
    "text",
    "tinytext",
    "mediumtext",
    "longtext",
    "blob",
    "mediumblob",
    "longblob",
    "json",
    "enum",
    "set",
)

JDBC_FETCH_ROWS = 500


@dataclass(frozen=True)
class Table:
    """A table to scan: its data, its name and the first column of its primary key, if any."""

    name: str
    data: DataFrame
    key: str | None = None


def is_text_type(type_name: str) -> bool:
    """Whether a database column type, given by name, is scanned."""
    return bool(type_name) and type_name.lower().startswith(TEXT_TYPE_PREFIXES)


def text_columns(df: DataFrame) -> list[str]:
    """The scanned columns of a DataFrame: its string-typed ones."""
    kinds = (T.StringType, T.VarcharType, T.CharType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def read_spread(spark: SparkSession, path: str, *keys: str, fmt: str = "parquet") -> DataFrame:
    """Read a file or folder so that a scan of it uses all cores.

    Matching costs far more than reading, and a small table stored as a single row group would
    occupy a single core: such an input is dealt out by ``keys``. A large input has more splits
    than there are cores and is returned as it is, without a shuffle.
    """
    df = spark.read.format(fmt).load(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_folder_tables(
    spark: SparkSession,
    folder: str,
    keys: Mapping[str, str | None],
    fmt: str = "parquet",
    spread: Iterable[str] = (),
) -> list[Table]:
    """One table per file or sub-folder ``{name}.{fmt}``, with the given key columns.

    ``spread`` names the tables with long texts, see ``read_spread``.
    """
    tables = []
    for name, key in keys.items():
        path = f"{folder}/{name}.{fmt}"
        if name in spread:
            data = read_spread(spark, path, *([key] if key else []), fmt=fmt)
        else:
            data = spark.read.format(fmt).load(path)
        tables.append(Table(name, data, key))
    return tables


def read_whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of UTF-8 text files, one row per file."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_catalog_tables(
    spark: SparkSession, database: str | None = None, keys: Mapping[str, str] | None = None
) -> list[Table]:
    """Every table of a catalog database, in name order."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    prefix = f"`{database}`." if database else ""
    return [Table(n, spark.table(f"{prefix}`{n}`"), (keys or {}).get(n)) for n in names]


def jdbc_listing(flavour: str, database: str = "") -> str:
    """Query that lists ``(table_name, column_name, type_name, is_key)`` of a database."""
    if flavour == "mysql":
        schema = database.replace("'", "''")
        return (
            "SELECT TABLE_NAME AS table_name, COLUMN_NAME AS column_name, "
            "DATA_TYPE AS type_name, COLUMN_KEY = 'PRI' AS is_key "
            f"FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_SCHEMA = '{schema}'"
        )
    if flavour == "sqlite":
        return (
            "SELECT m.name AS table_name, c.name AS column_name, "
            "c.type AS type_name, c.pk > 0 AS is_key "
            "FROM sqlite_master m JOIN pragma_table_info(m.name) c WHERE m.type = 'table'"
        )
    raise ValueError(f"unknown database flavour: {flavour}")


def jdbc_reader_options(
    url: str,
    table: str,
    columns: Iterable[str],
    partition: tuple[str, int, int, int] | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read of only the key and text columns of a table.

    ``partition`` is ``(column, lower, upper, partitions)``: Spark then reads the ranges in
    parallel, each streamed in pages of 500 rows, in place of one reader that counts offsets.
    """
    picked = ", ".join(f"`{c}`" for c in columns)
    options = {
        "url": url,
        "dbtable": f"(SELECT {picked} FROM `{table}`) scanned",
        "fetchsize": str(JDBC_FETCH_ROWS),
        **(properties or {}),
    }
    if partition:
        column, lower, upper, count = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(count),
        }
    return options


def scanned_columns(listing: Iterable[tuple]) -> dict[str, tuple[str | None, list[str]]]:
    """Per table with text columns, in name order: its first key column and its text columns."""
    keys: dict[str, str] = {}
    texts: dict[str, list[str]] = {}
    for table, column, type_name, is_key in listing:
        if is_key:
            keys.setdefault(table, column)
        if is_text_type(type_name):
            texts.setdefault(table, []).append(column)
    return {table: (keys.get(table), texts[table]) for table in sorted(texts)}


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    flavour: str,
    database: str = "",
    partitions: Mapping[str, tuple[str, int, int, int]] | None = None,
    properties: Mapping[str, str] | None = None,
) -> list[Table]:
    """All tables of a MySQL or SQLite database that have text columns.

    The listing has one row per column of the database. ``partitions`` gives, per table, how its
    rows are split among readers, see ``jdbc_reader_options``.
    """
    query = jdbc_listing(flavour, database)
    listing = spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()
    tables = []
    for name, (key, texts) in scanned_columns(map(tuple, listing.collect())).items():
        split = (partitions or {}).get(name)
        needed = [key, split[0] if split else None, *texts]
        columns = list(dict.fromkeys(c for c in needed if c))
        options = jdbc_reader_options(url, name, columns, split, properties)
        data = spark.read.format("jdbc").options(**options).load()
        # A numeric or other column read for splitting only is no text and is not scanned.
        tables.append(Table(name, data, key))
    return tables
