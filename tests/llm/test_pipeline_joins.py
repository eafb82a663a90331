"""Stages of the pipeline leave the texts where they are while the keys that go are few."""

import corpus_pipeline
from lineward.llm import common
from pyspark.sql import functions as F


def test_texts_are_not_shuffled_for_few_keys(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"text {i}") for i in range(60)] + [(None, "no id"), (7, "text 7"), (7, "other")],
        "doc_id long, text string",
    )
    gone = {(i, f"text {i}") for i in range(0, 60, 3)}
    want = sorted(((i, t) for i, t in map(tuple, docs.collect()) if (i, t) not in gone), key=repr)

    def decide(d):
        number = F.substring_index("text", " ", -1).cast("int")
        goes = F.col("text").startswith("text ") & (number % 3 == 0)
        return d.select("doc_id", (~goes).alias("kept"))

    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the keys are more than Spark would broadcast by itself
    try:
        for rows, join in ((1000, "BroadcastHashJoin"), (5, "SortMergeJoin")):
            monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
            kept = corpus_pipeline._only_kept(docs, decide, "test")
            assert sorted(map(tuple, kept.collect()), key=repr) == want
            assert join in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)


def test_near_dedup_does_not_shuffle_texts_for_few_keys(spark, sf):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame(
        [(1, text), (2, text), (2, text), (3, "quite another text of its own with some words"), (3, "x")],
        "doc_id long, text string",
    )
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        kept = corpus_pipeline.near_dedup(spark, docs, sf)
        assert kept.where("text like 'one%'").count() == 1
        assert kept.count() == 3
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set(limit, before)
