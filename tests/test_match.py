import random

import brute
import pytest
from pyspark.sql import functions as F

from lineward.config import ScanConfig, parse_keywords
from lineward.functions.match import has_charset, hits, line_hit
from lineward.functions.text import excerpt, split_keywords, strip, table_content
from lineward.operators.scan import full_check, insert_sweep, scan_text


def found(spark, texts, config):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", hits(F.col("text"), config).alias("h")).orderBy("id").collect()
    return [[(h.line, h.keyword, h.content, h.matched_text) for h in r.h] for r in rows]


# line, keywords, algorithm, max_insert, expected keyword and matched text
GOLDEN = [
    ("保111密", "保密", "regex", 3, ("保密", "保111密")),
    ("保1111密", "保密", "regex", 3, None),
    ("保xxxxx保密", "保密", "regex", 3, None),
    ("不予1公2开", "不予公开", "regex", 2, ("不予公开", "不予1公2开")),
    ("不予1公23开", "不予公开", "regex", 2, None),
    ("SECRET x", "secret", "regex", 0, ("secret", "secret")),
    ("secret", "Secret", "regex", 0, None),
    ("SECRET", "secret", "ac", 3, None),
    ("xcab", "ab,cab", "ac", 3, ("cab", "cab")),
    ("b..ab", "ab,b", "ac", 3, ("b", "b")),
    ("b..ab", "ab,b", "regex", 0, ("ab", "ab")),
    ("", "a", "regex", 0, None),
    ("", "a", "ac", 0, None),
    ("a.b*c", ".b*", "regex", 0, (".b*", ".b*")),
    ("x]^-\\y", "]^-\\", "regex", 0, ("]^-\\", "]^-\\")),
    ("aab", "aa", "regex", 0, ("aa", "aa")),
    ("𝒳a𝒴", "𝒳𝒴", "regex", 1, ("𝒳𝒴", "𝒳a𝒴")),
]


@pytest.mark.parametrize("line, keywords, algorithm, max_insert, expected", GOLDEN)
def test_golden_lines(spark, line, keywords, algorithm, max_insert, expected):
    config = ScanConfig(keywords, algorithm, max_insert)
    got = found(spark, [line], config)[0]
    assert got == ([(1, expected[0], line.strip(), expected[1])] if expected else [])


def test_noise_ladder(spark):
    text = "\n".join(["保密"] + ["保" + "1" * n + "密" for n in range(1, 8)])
    got = found(spark, [text], ScanConfig("保密", "regex", 3))[0]
    assert [h[0] for h in got] == [1, 2, 3, 4]


def test_lines_are_numbered_past_empty_ones_and_keep_carriage_returns(spark):
    got = found(spark, ["\n\n  保密\r\n", "保密"], ScanConfig("保密", "regex", 0))
    assert got == [[(3, "保密", "保密", "保密")], [(1, "保密", "保密", "保密")]]


def test_without_keywords_or_text_nothing_hits(spark):
    assert found(spark, ["abc", ""], ScanConfig("", "regex")) == [[], []]
    assert found(spark, ["abc", ""], ScanConfig([], "ac")) == [[], []]
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert df.select(F.size(hits(F.col("text"), ScanConfig("a"))).alias("n")).first().n == 0


@pytest.mark.parametrize(
    "config",
    [
        ScanConfig("ab,ca,保密,A", "regex", 3),
        ScanConfig("abc,a]b,x^-", "regex", 1),
        ScanConfig("aa,b\\.,bab", "regex", 0),
        ScanConfig(["abc", "cab"], "regex", 10),
        ScanConfig("ab,cab,A,B],保密", "ac"),
        ScanConfig(["a ", "bb", "b"], "ac"),
        ScanConfig(["a", "b1", "cA", *[f"zz{i}" for i in range(20)]], "ac"),
    ],
    ids=str,
)
def test_matchers_equal_the_plain_restatement(spark, config):
    pick = random.Random(7)
    alphabet = "abcABx]^-\\.保密1 \t"
    texts = [
        "\n".join(
            "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 25)))
            for _ in range(pick.randint(1, 4))
        )
        for _ in range(800)
    ]
    assert found(spark, texts, config) == [brute.hits(t, config) for t in texts]


def test_long_lines_stay_linear(spark):
    """Stretches span two repetitions each, so an odd number of them swallows the word behind."""
    config = ScanConfig("license,token", "regex", 3)
    assert [bool(brute.hits("l i c e n s " * n + "license", config)) for n in (4, 5)] == [True, False]
    texts = ["l i c e n s " * n + "license" for n in (50000, 50001)] + ["tok " * 100000]
    got = found(spark, texts, config)
    assert [[(h[0], h[1], h[3]) for h in t] for t in got] == [[(1, "license", "license")], [], []]


def test_line_hit_and_letter_test(spark):
    df = spark.createDataFrame([("X保1密Y",), ("密",)], "t string")
    row = df.select(
        line_hit(F.col("t"), ScanConfig("保密", "regex", 1))["matched_text"].alias("m"),
        has_charset(F.lower("t"), "保密").alias("c"),
    ).collect()
    assert [(r.m, r.c) for r in row] == [("保1密", True), (None, False)]


def test_keyword_lists():
    assert parse_keywords(" a, b ,,c ") == ("a", "b", "c")
    assert parse_keywords([" a", "b"]) == (" a", "b")
    assert parse_keywords(None) == ()


def test_keyword_lists_as_data(spark):
    df = spark.createDataFrame([(" a, b ,,c ",)], "k string")
    assert df.select(split_keywords(F.col("k")).alias("k")).first().k == ["a", "b", "c"]


def test_trimming(spark):
    df = spark.createDataFrame([("　 " + "x" * 300 + "\xa0\r",), ("y",)], "t string")
    clean = strip(F.col("t"))
    rows = df.select(
        F.length(clean).alias("n"), F.length(table_content(clean)).alias("c"), excerpt(clean).alias("e")
    ).collect()
    assert [(r.n, r.c) for r in rows] == [(300, 200), (1, 1)]
    assert rows[0].e == "x" * 80 + "..." and rows[1].e == "y"


def test_full_check_counts_lines(spark):
    df = spark.createDataFrame([(1, "ab\nx\nab ab"), (2, "x")], "id int, text string")
    rows = full_check(df, ["id"], "text", ScanConfig("ab", "ac")).orderBy("id").collect()
    assert [(len(r.hits), r.total_danger_lines) for r in rows] == [(2, 2), (0, 0)]


def test_sweep_equals_one_scan_per_budget(spark):
    pick = random.Random(3)
    texts = ["\n".join("".join(pick.choice("ab1") for _ in range(14)) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    config = ScanConfig("abba,bbbb", "regex", 3)
    swept = {r.max_insert: r.lines for r in insert_sweep(df, "text", config).collect()}
    for budget in range(0, 11):
        single = scan_text(df, ["id"], "text", ScanConfig("abba,bbbb", "regex", budget)).count()
        assert swept.get(budget, 0) == single


def test_the_scan_runs_once_per_row(spark):
    """The optimizer must not repeat the matcher in a filter it infers."""
    df = spark.createDataFrame([(1, "ab")], "id int, text string")
    plan = scan_text(df, ["id"], "text", ScanConfig("ab,cd", "regex"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 2
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
