"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineward.llm.common import table
from lineward.llm.decontaminate import decontaminate
from lineward.llm.divergence import ORACLE as DIVERGENCE_SQL
from lineward.llm.divergence import source_divergence
from lineward.llm.html_extract import extract_pages
from lineward.llm.language_id import identify_languages
from lineward.llm.language_model import score_documents
from lineward.llm.minhash import near_duplicates
from lineward.llm.phrases import fingerprint_documents
from lineward.llm.pivots import ORACLE as PIVOTS_SQL
from lineward.llm.pivots import cluster_vectors
from lineward.llm.quality_classifier import classify_quality
from lineward.llm.quality_rules import quality_rules
from lineward.llm.sentencepieces import encode_documents
from lineward.llm.sharding import shard_documents
from lineward.llm.toxicity import score_toxicity


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), model)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sharding": op2_sharding,
    "op3_language_model": op3_language_model,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_minhash": op10_minhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op11_source_divergence": DIVERGENCE_SQL,
    "op13_centroid_clustering": PIVOTS_SQL,
}
