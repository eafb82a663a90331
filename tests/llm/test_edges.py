"""Every operator on odd rows and on empty tables: a result for every row, and the stated one."""

import public_tokenizers
import pytest

import corpus_pipeline
from lineward.llm.decontaminate import decontaminate
from lineward.llm.html_extract import extract_pages
from lineward.llm.language_id import identify_languages
from lineward.llm.language_model import score_documents
from lineward.llm.minhash import near_duplicates
from lineward.llm.quality_classifier import classify_quality
from lineward.llm.quality_rules import quality_rules
from lineward.llm.sentencepieces import encode_documents
from lineward.llm.sharding import shard_documents
from lineward.llm.toxicity import score_toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def labels(spark, rows=((7, 1), (8, 0), (9, None), (None, 1), (11, 0))):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, None), (2, ""), (3, "short one"), (4, "the the of of and and thing thing over"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "sharding": lambda spark, docs: shard_documents(docs),
    "language_model": lambda spark, docs: score_documents(docs),
    "language_id": lambda spark, docs: identify_languages(docs, keep_spans=True),
    "sentencepiece": lambda spark, docs: encode_documents(docs, MODEL, keep_texts=True),
    "quality_classifier": lambda spark, docs: classify_quality(docs),
    "quality_rules": lambda spark, docs: quality_rules(docs),
    "decontamination": lambda spark, docs: decontaminate(docs, benchmark(spark)),
    "toxicity": lambda spark, docs: score_toxicity(docs, labels(spark)),
    "minhash": lambda spark, docs: near_duplicates(docs, 2, 80),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    found = OPERATORS[name](spark, odd).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == want
    by_id = {r["doc_id"]: r for r in found}
    if name == "minhash":
        assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
        assert {by_id[i]["component_id"] for i in (7, 8, 9)} == {7}
        assert by_id[2]["component_id"] == 2 and by_id[2]["kept"]
    if name == "language_id":
        assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 6)] == ["und"] * 4
    if name == "sharding":
        assert by_id[1]["size"] == 8 and by_id[1]["text_crc32"] == 0
        assert len({by_id[i]["shard"] for i in (1, 2)}) == 1 == len({by_id[i]["shard"] for i in (7, 8)})
    if name == "quality_classifier":
        assert not any(by_id[i]["kept"] for i in (1, 2, 3))
    if name == "quality_rules":
        assert all(by_id[i]["base_failed"] for i in (1, 2, 3, 4))
    if name == "sentencepiece":
        assert [by_id[i]["n_tokens"] for i in (1, 2)] == [0, 0]
        assert all(r["n_corrected"] == 0 for r in found)
        texts = {r["doc_id"]: r["text"] for r in odd.collect()}
        assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in found if r["doc_id"])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).count() == 0


def test_without_labels_and_items(spark, odd):
    assert {r["score"] for r in score_toxicity(odd, labels(spark, [])).collect()} == {0.0}
    assert not any(r["contaminated"] for r in decontaminate(odd, benchmark(spark, [])).collect())


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (3, "u", "<p>a</p>", "x", 1), (3, "u", "<p>a</p>", "x", 1),
            (None, "u", "<", None, None), (5, "u", "<div>" * 3000 + "deep, text " * 20, "", 0),
            (6, "u", "<script>var x = '<p>no</p>'", "", 0)]
    found = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in found) == [
        (0, "<", 1), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (5, "deep, tex", 219), (6, "", 0),
    ]
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, odd, nothing, sf, stage):
    name, function = corpus_pipeline.STAGES[stage]
    kept = function(spark, odd, sf)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    if name == "near dedup":
        # 7 (twice), 8, 9 and the one without id are near copies.
        assert sum(i in (7, 8, 9, None) for i in ids) == 2 and {1, 2, 3, 4} <= set(ids)
    if name == "decontamination":
        assert sorted(i or 0 for i in ids) == sorted(r["doc_id"] or 0 for r in odd.collect())
    assert function(spark, nothing, sf).count() == 0


def test_unlike_texts_under_one_id_and_rows_without_id_are_kept(spark, sf, odd):
    prose = odd.where("doc_id = 8").first()["text"]
    other = " ".join(prose.split()[::-1])
    rows = [(1, prose), (1, other), (2, prose), (2, prose), (None, other.upper().lower() + " and more"), (None, "a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert len(kept) == 3 and {r["text"] for r in kept} >= {prose, "a few words"}
    assert len({r["text"] for r in kept} & {other, other + " and more"}) == 1
