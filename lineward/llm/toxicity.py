"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on fragments of toxic documents that ordinary
documents hardly have, one on windows of ordinary documents. A window of a text (its words one by one) is
compressed with both. What the toxic dictionary saves, relative to the most it can save on that window, is
the window's distance between the two. A logistic curve over the largest distances of a text and its
number of windows beyond the threshold is calibrated on labelled documents kept from the dictionaries.

Learning takes a sample of the labelled rows, about TOXIC_ROWS and ORDINARY_ROWS by the hash of their ids,
and at most FRAGMENTS fragments and ORDINARY_WINDOWS windows. Copies and near copies count once when
fragments are chosen (by the smallest hash of their word runs). Fragments count by documents.

Null and empty texts have no window and get the score of a text without any. Without labelled rows of
both kinds every text scores 0. Labels of one id that differ count as toxic if any does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, held_out, written
from lineward.llm.words import Hasher, blocks, same_text, sequence_hashes

FOLDS = 5
HELD_OUT = 0
TOXIC_ROWS = 4_000
ORDINARY_ROWS = 12_000
# Every so many-th document of the sample calibrates, the others train the dictionaries.
CALIBRATION_PART = 5
FRAGMENTS = 2_000
ORDINARY_WINDOWS = 4_000
ORDINARY_WINDOW_WORDS = 8
ORDINARY_BYTES = 4096
# A fragment is this many times as frequent in toxic documents, with a log-likelihood ratio of at least that.
MIN_RATIO = 8.0
MIN_EVIDENCE = 15.0
NEAR = 0.8
EDGES = b".,;:!?\"'()[]"
# Known to both dictionaries and put before each window, so that short windows are compressed at all.
FILLER = bytes(range(128, 192))
# Words whose distance a task remembers.
REMEMBERED = 200_000


class Dictionaries(NamedTuple):
    toxic: bytes
    ordinary: bytes
    best: int  # bytes that a window takes which the toxic dictionary has whole


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        compression_level=5,
        min_match=4,
        strategy=zstandard.STRATEGY_LAZY2,
        window_log=17,
        hash_log=15,
        chain_log=15,
        search_log=4,
        target_length=16,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    content.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


def ordinary_content(windows: list[bytes]) -> bytes:
    """The content that zstandard's training picks from the windows; all of them if they are too few."""
    try:
        return zstandard.train_dictionary(2 * ORDINARY_BYTES, windows).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:
        return b" ".join(windows)[-ORDINARY_BYTES:]


def dictionaries(fragments: list[bytes], windows: list[bytes]) -> Dictionaries:
    """Dictionaries of toxic fragments, the weightiest last and so nearest, and of ordinary windows."""
    toxic = b"".join(b" " + f for f in fragments) + b" " + FILLER
    press = compressor(toxic)
    best = min((len(press.compress(FILLER + b" " + f + b" ")) for f in fragments), default=0)
    return Dictionaries(toxic, ordinary_content(windows) + FILLER, best)


class Distances:
    """The distances of windows, each computed once while it is remembered."""

    def __init__(self, trained: Dictionaries):
        self.trained = trained
        self.toxic, self.ordinary = compressor(trained.toxic), compressor(trained.ordinary)
        self.known: dict[bytes, float] = {}

    def of(self, window: bytes) -> float:
        framed = FILLER + b" " + window.strip(EDGES) + b" "
        ordinary = len(self.ordinary.compress(framed))
        saved = ordinary - len(self.toxic.compress(framed))
        return saved / max(ordinary - self.trained.best, 3)

    def summary(self, text: bytes) -> tuple[float, ...]:
        """The two largest distances, the windows beyond the threshold, and whether one and two are."""
        words = text.split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        times: dict[bytes, int] = {}
        for word in words:
            times[word] = times.get(word, 0) + 1
        first = second = 0.0
        beyond = 0
        for word, n in times.items():
            distance = known.get(word)
            if distance is None:
                distance = known[word] = self.of(word)
            if distance > second:
                for _ in range(min(n, 2)):
                    if distance > first:
                        first, second = distance, first
                    elif distance > second:
                        second = distance
            if distance >= NEAR:
                beyond += n
        return first, second, min(beyond, 8) / 8, float(first >= NEAR), float(second >= NEAR)


def calibrated(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the summaries, the last one its bias."""
    rows = np.column_stack([rows, np.ones(len(rows))])
    weights = np.zeros(rows.shape[1])
    for _ in range(4000):
        error = 1 / (1 + np.exp(-rows @ weights)) - target
        weights -= rows.T @ error / len(target) + 1e-4 * weights
    return weights


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, kind and part (0 calibrates) of a bounded sample of the labelled rows that may be learned from."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out(FOLDS, HELD_OUT))
    )
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_ROWS / max(counts.get(1, 0), 1))).otherwise(
        min(1.0, ORDINARY_ROWS / max(counts.get(0, 0), 1))
    )
    # About TOXIC_ROWS + ORDINARY_ROWS ids by the shares above, whatever the number of labels.
    picked = F.broadcast(known.where(place < share * (1 << 30)).withColumnRenamed("doc_id", "id"))
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("id"))
    part = F.pmod(F.xxhash64(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(CALIBRATION_PART))
    return written(rows.select("text", "toxic", part.alias("part")), "labelled")


def fragments(rows: DataFrame) -> list[bytes]:
    """Words that toxic documents have far more often than ordinary ones, the strongest last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(0)):
                least = np.zeros(block.rows, np.uint64)
                for size in (1, 5):  # texts of fewer than five words go by their smallest word
                    runs = sequence_hashes(hasher.words(block), size)
                    inside = same_text(block.doc, size)
                    found = np.full(block.rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
                    np.minimum.at(found, block.doc[: len(runs)][inside], runs[inside])
                    least = np.where(block.words >= size, found, least)
                for i in range(block.rows):
                    text = block.data[block.bounds[i] : block.bounds[i + 1]].tobytes().lower()
                    words = {w.strip(EDGES) for w in text.split()} - {b""}
                    words = [w for w in words if len(w) <= 64]
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(words, pa.binary()),
                            pa.array(np.full(n, toxic[block.first + i], np.int32)),
                            pa.array(np.full(n, least[i], np.uint64).view(np.int64)),
                        ],
                        ["word", "toxic", "least"],
                    )

    found = rows.where("part <> 0").select("text", "toxic")
    each = written(found.mapInArrow(run, "word binary, toxic int, least long"), "fragments", TEXT_ROWS)
    totals = each.groupBy("toxic").agg(F.countDistinct("least").alias("n")).collect()
    total = {row["toxic"]: row["n"] for row in totals}
    a_all, b_all = total.get(1, 0), total.get(0, 0)
    if not a_all or not b_all:
        return []
    a, b = F.col("a"), F.col("b")
    share = a_all / (a_all + b_all)

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    counted = (
        each.distinct()
        .groupBy("word")
        .agg(F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .withColumn("ratio", ((a + 0.5) / (a_all + 1)) / ((b + 0.5) / (b_all + 1)))
        .withColumn("evidence", 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share))))
        .where((F.col("ratio") >= MIN_RATIO) & (F.col("evidence") >= MIN_EVIDENCE))
        .orderBy(F.desc("evidence"), "word")
        .limit(FRAGMENTS)
    )
    return [bytes(row["word"]) for row in counted.select("word").collect()][::-1]


def ordinary_windows(rows: DataFrame) -> list[bytes]:
    """Windows of ordinary documents, chosen by their hash."""
    ordinary = rows.where("part <> 0 and toxic = 0")
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    steps = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(ORDINARY_WINDOW_WORDS))
    window = F.transform(steps, lambda i: F.array_join(F.slice("words", i, ORDINARY_WINDOW_WORDS), " "))
    windows = (
        ordinary.withColumn("words", words)
        .select(F.explode(window).alias("window"))
        .orderBy(F.xxhash64("window"), "window")
        .limit(ORDINARY_WINDOWS)
    )
    return [row["window"].encode()[:512] for row in windows.collect()]


def _summaries(texts: pa.Array, distances: Distances) -> np.ndarray:
    rows = [distances.summary((text or "").encode().lower()) for text in texts.to_pylist()]
    return np.array(rows, float).reshape(len(rows), 5)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5)."""
    rows = sampled(docs, labels)
    trained = dictionaries(fragments(rows), ordinary_windows(rows))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(trained)
        for batch in batches:
            found = _summaries(batch.column(0), distances)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(found[:, i]) for i in range(5))], ["toxic", *"abcde"]
            )

    schema = "toxic int, a double, b double, c double, d double, e double"
    known = rows.where("part = 0").select("text", "toxic").mapInArrow(summarise, schema).toArrow()
    target = known.column(0).to_numpy()
    weights = None
    if 0 < target.sum() < len(target):
        weights = calibrated(np.column_stack([known.column(i).to_numpy() for i in range(1, 6)]), target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(trained)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if weights is not None:
                score = 1 / (1 + np.exp(-(_summaries(batch.column(2), distances) @ weights[:-1] + weights[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {doc_id}, held_out boolean, score double, predicted int")
