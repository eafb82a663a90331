"""Copies of benchmark items that differ in single slots; short and slot-heavy items."""

import random

from pyspark.sql import functions as F

from lineward.llm.decontaminate import decontaminate, leaks, with_windows


def found(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}


def test_one_value_for_two_quantities(spark):
    item = "the baker has 2 apples in a basket and keeps them fresh for 2 days before he sells all of it"
    assert found(spark, item, [item.replace("2 apples", "3 apples").replace("2 days", "5 days")]) == {0}


def test_one_changed_occurrence_in_a_long_copy(spark):
    item = "then the old man met Anna near the long river and told her about the sea while little Anna sat by it"
    item += " and heard of all the ships that had gone down there in the storms of the years before the war"
    assert found(spark, item, [item.replace("Anna", "Hanna", 1), "nothing of that kind"]) == {0}


def test_short_and_slot_heavy_items(spark):
    texts = {
        "What is the capital of France?": "He asked What is the capital of France? and left",
        "Anna buys some red apples": "today Bernd buys some red apples",
        "12 + 35 = 47": "we know that 12 + 35 = 47 holds",
        "Marie Curie": "a talk on marie curie was held",
        "Anna met Bernd, Carla, Doris and Emil in Rome": "anna met bernd, carla, doris and emil in rome",
    }
    for item, text in texts.items():
        assert found(spark, item, [text, "nothing of that kind"]) == {0}, item


def test_common_words_tell_no_item(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    some = [(-i, f"{i} talks were held on Marie Curie in town") for i in range(1, 6)]
    docs = docs.union(spark.createDataFrame(some, docs.schema))
    items = [(1, "the"), (2, "Of the"), (3, "Marie Curie")]
    found = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in found} == {(-i, (3,)) for i in range(1, 6)}


def test_windows_of_every_size_tell_their_words(spark):
    words = random.Random(3).choices("ab", k=600)
    rows = spark.createDataFrame([(words,), (words[::-1],), ([],), (["a"],)], "words array<string>")
    sizes = list(range(1, 9))
    rows = with_windows(rows, F.col("words"), sizes, "w").collect()
    for size in sizes:
        seen = set()
        for row in rows:
            hashes = row[f"w_{size}"]
            assert len(hashes) == len(row["words"])
            seen |= {(tuple(row["words"][i : i + size]), hashes[i]) for i in range(len(hashes) - size + 1)}
        assert len(seen) == len({run for run, _ in seen}) == len({h for _, h in seen})


def test_item_at_the_very_end_and_start(spark):
    item = "one two three four five six seven eight"
    texts = [item, f"so {item}", f"{item}.", item[:-6], "", " ", "seven eight"]
    assert found(spark, item, texts) == {0, 1, 2}
