"""Roll-ups of scan results.

Results have one row per target with a ``hits`` array, hits one row per hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of the line list and of the verdict.
LINE_ITEM = "第%d行"
NO_LINES = "无"
SAFE_VERDICT = "未发现涉密信息，安全可靠。"
UNSAFE_VERDICT = "共发现 %d 处涉密信息，请立即核查并处理。"


def source_summary(results: DataFrame) -> DataFrame:
    """Targets, targets with a hit, hits in total."""
    found = F.size("hits")
    return results.agg(
        F.count("*").alias("targets"),
        F.count_if(found > 0).alias("hit_targets"),
        F.coalesce(F.sum(found), F.lit(0)).cast("bigint").alias("hits"),
    )


def type_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("file_type").agg(F.count("*").alias("targets"))


def per_source(results: DataFrame, kind: str, source: str) -> DataFrame:
    """``(kind, source, hits)``: the input of ``overview`` for web, file, image and audio results."""
    return results.select(
        F.lit(kind).alias("kind"),
        F.col(source).cast("string").alias("source"),
        F.size("hits").cast("bigint").alias("hits"),
    )


def database_source(stats: DataFrame, source: str) -> DataFrame:
    """``(kind, source, hits)`` of a database: its sensitive rows, from ``field_stats``."""
    per_table = stats.select("table", "sensitive_rows").distinct()
    total = F.coalesce(F.sum("sensitive_rows"), F.lit(0)).cast("bigint")
    return per_table.agg(total.alias("hits")).select(
        F.lit("db").alias("kind"), F.lit(source).alias("source"), "hits"
    )


def overview(*sources: DataFrame) -> DataFrame:
    """Sources and hits per kind, and in total (``kind`` null), in one pass."""
    united = reduce(DataFrame.unionByName, sources)
    return united.rollup("kind").agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")
    )


def keyword_frequency(hits: DataFrame, target: str) -> DataFrame:
    """Hits and targets per keyword."""
    return hits.groupBy("keyword").agg(
        F.count("*").alias("hits"), F.countDistinct(target).alias("targets")
    )


def line_list(hits: Column) -> Column:
    """The hit lines of a target in words, or that there are none."""
    numbers = F.transform(hits, lambda h: F.format_string(LINE_ITEM, h["line"]))
    return F.when(F.size(hits) > 0, F.array_join(numbers, "; ")).otherwise(F.lit(NO_LINES))


def sorted_targets(results: DataFrame, *order: str) -> DataFrame:
    """Targets in report order: by path, or by upload index."""
    return results.orderBy(*order)


def verdict(total_hits: Column) -> Column:
    return F.when(total_hits == 0, F.lit(SAFE_VERDICT)).otherwise(
        F.format_string(UNSAFE_VERDICT, total_hits)
    )
