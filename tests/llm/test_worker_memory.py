"""What a Python worker of the pipeline holds does not follow the size of the batch that it is given."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lineward.llm import minhash, quality_classifier, quality_rules, sentencepieces

MB = 1 << 20


class Docs:
    """Stands for a table; keeps the Arrow function that it is given."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    withColumn = select

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def batch(hosted):
    rng = np.random.default_rng(3)
    texts = ["\n".join(" ".join(f"w{i}" for i in rng.integers(0, 5000, 12)) for _ in range(40)) for _ in range(1200)]
    ids = pa.array(range(len(texts)), pa.int64())
    columns = [ids, *([pa.array(["h"] * len(texts))] if hosted else []), pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def peak(function, given):
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in function(iter([given])))
        return rows, tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(
    ("module", "operator", "hosted", "most"),
    [
        (quality_classifier, quality_classifier.described, False, 35),
        (quality_rules, quality_rules.measured, True, 35),
        (quality_rules, quality_rules.shingled, True, 35),
        (minhash, lambda docs: minhash.sketch_documents(docs, 5), False, 35),
    ],
)
def test_operators_hold_small_blocks(spark, monkeypatch, module, operator, hosted, most):
    monkeypatch.setattr(module, "written", lambda df, *args, **named: df)
    docs = Docs(spark.createDataFrame([], "doc_id long, text string").schema)
    operator(docs)
    given = batch(hosted)
    rows, held = peak(docs.function, given)
    assert rows == given.num_rows
    assert held < most


def test_scores_hold_parts_of_a_batch(spark, monkeypatch):
    """Scoring turns lists of features into wide arrays, a part of a batch at a time."""
    n, features = 10_000, 200
    keys = pa.array(np.tile(np.arange(features, dtype=np.int16), n))
    bounds = np.arange(0, n * features + 1, features, dtype=np.int32)
    given = pa.RecordBatch.from_arrays(
        [
            pa.array(range(n), pa.int64()), pa.array(np.full(n, 9)), pa.array(np.zeros(n, np.int64)),
            pa.ListArray.from_arrays(bounds, keys),
            pa.ListArray.from_arrays(bounds, pa.array(np.ones(n * features, np.float32))),
        ],
        ["doc_id", "n_words", "votes", "keys", "shares"],
    )
    docs = spark.createDataFrame([(1, "Some words of a text, and some more."), (2, "!!! ###")], "doc_id long, text string")
    found = []
    described = quality_classifier.described(docs)
    monkeypatch.setattr(quality_classifier, "described", lambda docs: described)
    monkeypatch.setattr(type(described), "mapInArrow", lambda self, function, schema: found.append(function))
    quality_classifier.classify_quality(docs)
    rows, held = peak(found[0], given)
    assert rows == n
    assert held < 25


def test_the_encoder_is_given_few_texts_at_once(spark, monkeypatch):
    asked = []

    def spy(df, name, batch_rows=None, **named):
        asked.append(batch_rows)
        return written(df, name, batch_rows, **named)

    written = getattr(sentencepieces, "written", None)
    monkeypatch.setattr(sentencepieces, "written", spy, raising=False)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, None)], "doc_id long, text string")
    found = sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert found.count() == 21
    assert asked and asked[0] is not None and asked[0] <= 1000
