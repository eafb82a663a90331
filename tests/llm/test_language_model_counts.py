"""Counts of the language model beyond 16 bits, and its filter beyond one part."""

import numpy as np

from lineward.llm import language_model
from lineward.llm.language_model import score_documents


def test_counts_over_16_bits_are_whole():
    keys = np.array([5 << 40, 9 << 40], np.uint64)
    counts = np.array([1_000_000, 0xFFFF])
    packed = language_model._packed(keys, counts, 1)
    found = {}
    for k, c in zip(packed.column(1).to_pylist(), packed.column(2).to_pylist()):
        for key, n in zip(np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint16)):
            found[int(key)] = found.get(int(key), 0) + int(n)
    assert found == {5 << 40: 1_000_000, 9 << 40: 0xFFFF}


def test_a_word_after_itself_is_likely(spark):
    docs = spark.createDataFrame([(4, "again " * 1_000_000), (2, "other words in a row"), (3, "again " * 1000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in score_documents(docs).collect()}
    assert found[3]["score"] / found[3]["n_tokens"] > -0.05


def test_a_filter_of_many_parts_keeps_every_pair(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r["doc_id"]: r["score"] for r in score_documents(docs).collect()}
    monkeypatch.setattr(language_model, "PART_BITS", 1 << 16)
    parts = {r["doc_id"]: r["score"] for r in score_documents(docs).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[i] - whole[i]) < 1e-6 * abs(whole[i]) for i in whole)


def test_the_filter_grows_with_its_items(spark):
    few = language_model.filter_bits(spark.range(1).selectExpr("0 as kind", "1L as c"))
    many = language_model.filter_bits(spark.range(4_000_000).selectExpr("1 as kind", "1L as c"))
    assert few == 1 << 20 and many >= 4_000_000 * 64 * 8
