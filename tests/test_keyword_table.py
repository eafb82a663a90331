import random

import brute
import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig
import lineward.operators.keyword_table as keyword_table
from lineward.operators.keyword_table import join_keywords, scan_keyword_table


def make(spark, seed, alphabet):
    pick = random.Random(seed)
    texts = [
        "\n".join(
            "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 20)))
            for _ in range(pick.randint(1, 4))
        )
        for _ in range(150)
    ]
    words = {"".join(pick.choice(alphabet) for _ in range(pick.randint(1, 9))) for _ in range(60)}
    words |= {"ab", "abab", "b"}
    words = [w for w in sorted(words) if w.strip() == w and w]
    pick.shuffle(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    return texts, words, docs, table


@pytest.mark.parametrize("algorithm, max_insert", [("ac", 0), ("regex", 0), ("regex", 2)])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 4000], ids=["whole", "in parts"])
def test_join_equals_brute_force(spark, algorithm, max_insert, broadcast_bytes):
    texts, words, docs, table = make(spark, 5, "abAB.]保密𝒳 ")
    config = ScanConfig((), algorithm, max_insert)
    got = join_keywords(docs, ["id"], "text", table, config, broadcast_bytes)
    listed = sorted((r.id, r.line, r.keyword, r.content, r.matched_text) for r in got.collect())
    whole = ScanConfig(words, algorithm, max_insert)
    expected = sorted((i, *h) for i, t in enumerate(texts) for h in brute.hits(t, whole))
    assert len(expected) > 50 and listed == expected


@pytest.mark.parametrize("seed", range(3))
def test_anchors_of_noisy_keywords_lose_no_hit(spark, seed):
    """Long keywords with noise in them, so that only some of their pairs stand together."""
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(12)]
    texts = []
    for _ in range(300):
        noisy = list(pick.choice(words))
        for _ in range(pick.randint(0, 4)):
            noisy.insert(pick.randint(0, len(noisy)), pick.choice("xyz\t."))
        texts.append(f"{pick.choice('pq')}{''.join(noisy)}{pick.choice('rs')}\n")
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    for max_insert in (0, 1, 3):
        config = ScanConfig(words, "regex", max_insert)
        got = scan_keyword_table(docs, ["id"], "text", table, config)
        expected = sorted((i, *h) for i, t in enumerate(texts) for h in brute.hits(t, config))
        assert sorted(map(tuple, got.collect())) == expected and expected


@pytest.mark.parametrize("patterns, likely", [(0, 200), (2000, 1), (0, 0)])
def test_other_ways_to_list_anchors_find_the_same(spark, monkeypatch, patterns, likely):
    monkeypatch.setattr(keyword_table, "PATTERN_ANCHORS", patterns)
    monkeypatch.setattr(keyword_table, "LIKELY_KEYWORDS", likely)
    texts, words, docs, table = make(spark, 7, "abAB.]保密𝒳 ")
    for config in (ScanConfig(words, "ac"), ScanConfig(words, "regex", 2)):
        got = scan_keyword_table(docs, ["id"], "text", table, config)
        expected = sorted((i, *h) for i, t in enumerate(texts) for h in brute.hits(t, config))
        assert sorted(map(tuple, got.collect())) == expected and expected


def test_only_hits_are_shuffled(spark):
    _, _, docs, table = make(spark, 9, "abc1")
    plan = scan_keyword_table(docs, ["id"], "text", table, ScanConfig((), "regex", 1))
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange hashpartitioning" in line for line in lines) == 1
    assert any("BroadcastHashJoin" in line for line in lines)


def test_no_cross_join(spark):
    _, _, docs, table = make(spark, 1, "ab")
    for size in (1 << 20, 4000):
        for algorithm in ("ac", "regex"):
            plan = join_keywords(docs, ["id"], "text", table, ScanConfig((), algorithm, 1), size)
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_keyword_table(spark):
    _, _, docs, table = make(spark, 1, "ab")
    none = table.where(F.lit(False))
    for config in (ScanConfig((), "ac"), ScanConfig((), "regex", 1)):
        assert join_keywords(docs, ["id"], "text", none, config).count() == 0
        assert scan_keyword_table(docs, ["id"], "text", none, config).count() == 0
