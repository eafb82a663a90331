import random
from datetime import date

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in rows]


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, words date,"
    " component_id string, id string, gone_id string, repeated_id int, host string, cell string"
)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    rng = random.Random(5)
    prose = " ".join(rng.choice("the of and thing inter ering nation hatten over under".split()) for _ in range(400))
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, "!!! ### |||"), (7, prose),
        (7, prose), (8, prose), (9, prose + " more"), (10, "x" * 50_000), (11, (prose + "\n") * 60),
        (12, "\x00 null byte"), (13, "日本語 テキスト"), (None, prose + " without id"), (None, None),
        (14, "Ünïcödé wörds, with accents. " * 30), (15, "😀 emoji 😀"), (16, " a b c"),
    ]
    more = ("x", 1, date(2024, 1, 1), "y", "z", "g", 3, "h", "c")
    return [(i, t, "en" if i and i % 3 else None, None if i and i % 4 == 0 else "s", 7, *more) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
