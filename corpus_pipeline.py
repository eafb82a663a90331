"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Stages decide by a hash of a row's id and text, so
rows without id, and unlike texts under one id, are judged each by itself; repeated rows (same id and
text) share their decision, and near-dedup leaves one of them. Ties between rows that differ in other columns only
go to the one with the smallest hash of all columns. An empty table stays empty. What a stage writes on the
way is deleted before it returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, fresh, scratch, small, table, written
from lineward.llm.decontaminate import decontaminate
from lineward.llm.minhash import near_duplicates
from lineward.llm.quality_classifier import classify_quality
from lineward.llm.quality_rules import quality_rules
from lineward.llm.sentencepieces import encode_documents


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _rejected(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], name: str) -> tuple[str, DataFrame, DataFrame]:
    """The keys that ``decide`` does not keep, under a name that ``docs`` hasn't, and those of repeated rows."""
    gone, again = fresh(docs.columns, "gone_key"), fresh(docs.columns, "again_key")
    with scratch(docs.sparkSession):
        decided = decide(docs.withColumn("doc_id", _key()))
        decided = written(decided.select("doc_id", "kept"), f"decided-{name}", TEXT_ROWS)
        kept = decided.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
        rejected = kept.where("not kept").select(F.col("doc_id").alias(gone))
        repeated = kept.where("kept and rows > 1").select(F.col("doc_id").alias(again))
        return gone, written(rejected, f"rejected-{name}", kept=True), written(repeated, f"again-{name}", kept=True)


def _only_kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows of ``docs`` that ``decide`` (a row for each row, ``doc_id`` and ``kept``) keeps.

    The keys that go are written first and counted. A filtering stage rejects the smaller part, so the texts
    stay where they are as long as those keys are few enough to be broadcast (``small``); a shuffle join takes
    over beyond.
    """
    gone, rejected, _ = _rejected(docs, decide, name)
    return docs.join(small(rejected), _key() == F.col(gone), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only_kept(docs, classify_quality, "classifier")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only_kept(docs, quality_rules, "rules")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, and of repeated rows one."""
    gone, rejected, repeated = _rejected(docs, lambda d: near_duplicates(d, size=5, percent=80), "dedup")
    kept = docs.join(small(rejected), _key() == F.col(gone), "left_anti")
    repeated = small(repeated)
    is_again = _key() == F.col(repeated.columns[0])
    once = kept.join(repeated, is_again, "left_anti")
    least = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    twice = kept.join(repeated, is_again, "left_semi").groupBy(_key().alias("key")).agg(least).select("row.*")
    return once.unionByName(twice)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _only_kept(docs, lambda d: decontaminate(d, benchmark), "decontamination")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned decisions and the merge agenda have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
