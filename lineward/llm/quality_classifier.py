"""A quality classifier learned without labels.

Heuristic labellers look at the words of a document and vote low, high or not at all. How often which
votes come together is counted over all documents; expectation-maximisation on those counts estimates the
accuracy of each labeller, separately on good and poor documents, and the share of good documents. The posterior of a document's votes is its weak
label. A linear scorer over hashed word shapes is trained on the weak labels of a bounded sample and then
judges every document, so documents on which few labellers vote are judged by their likeness to others.

The table of votes has at most 3^10 rows. The sample is about SAMPLE_ROWS documents by the hash of their
id. Null texts and texts without words score 0 and are rejected. No documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, pieces, written
from lineward.llm.words import HASHED_BYTES, SPACES, Block, Hasher, blocks, mixed, repeated, same_text, sequence_hashes

# Documents whose features and weak labels train the scorer.
SAMPLE_ROWS = 20_000
FEATURES = 1 << 12
EM_ROUNDS = 100
START_GOOD = 0.9
TRAIN_ROUNDS = 300
STEP = 0.3
PENALTY = 1e-4

LABELLERS = (
    "symbols",
    "capitals",
    "exclamations",
    "stutter",
    "repeated_windows",
    "separators",
    "plain_words",
    "sentence_ends",
    "variety",
    "lower_case",
)
LOW, NONE, HIGH = 0, 1, 2

# Kinds of byte, as bits of a word's shape.
LOWER, UPPER, DIGIT, WIDE, STOP, MARK, SYMBOL, OTHER = (1 << i for i in range(8))


def kinds() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = LOWER, UPPER, DIGIT, WIDE
    table[list(b".,;:")] = STOP
    table[list(b"!?")] = MARK
    table[list(b"#*$%&|<>")] = SYMBOL
    table[list(SPACES)] = 0
    return table


def shares(block: Block, hasher: Hasher) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The shape of every word, and for each text the shares that the labellers look at."""
    kind = kinds()[block.data]
    n = np.maximum(block.words, 1)
    starts = block.start
    # A run from one start to the next holds a word and the white space behind it, which has no kind.
    shape = np.bitwise_or.reduceat(kind, starts) if len(starts) else np.zeros(0, np.uint8)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(block.doc, flags, block.rows) / n

    def bytes_per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[block.bounds[1:]] - sums[block.bounds[:-1]]) / n

    words = hasher.words(block)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])
    windows = sequence_hashes(words, 8)
    inside = np.flatnonzero(same_text(block.doc, 8))
    twice, _ = repeated(block.doc[inside], windows[inside])
    again = np.zeros(len(words), bool)
    again[inside[twice]] = True
    _, earlier = repeated(block.doc, words)
    last = kind[block.end - 1] if len(starts) else np.zeros(0, np.uint8)
    first = kind[starts] if len(starts) else np.zeros(0, np.uint8)
    upper = bytes_per_word(kind == UPPER)
    plain = (shape & (SYMBOL | MARK | OTHER | DIGIT)) == 0
    found = {
        "symbols": bytes_per_word(kind == SYMBOL),
        "capitals": upper / np.maximum(upper + bytes_per_word(kind == LOWER), 1e-9),
        "exclamations": bytes_per_word(block.data == ord("!")),
        "stutter": share(same),
        "repeated_windows": share(again),
        "separators": share((shape & (LOWER | UPPER | DIGIT | WIDE)) == 0),
        "plain_words": share(plain & ((shape & (LOWER | UPPER | WIDE)) > 0)),
        "sentence_ends": share(last == STOP),
        "variety": 1 - share(earlier),
        "lower_case": share((first == LOWER) | (first == WIDE)),
    }
    return shape.astype(np.uint64) * np.uint64(1 << 16) + first * np.uint64(256) + last, found


def votes(found: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """The vote of each labeller on each text."""
    out = np.full((len(LABELLERS), len(words)), NONE, np.int64)
    long = words >= 20

    def vote(name: str, value: int, where: np.ndarray) -> None:
        out[LABELLERS.index(name)][where] = value

    vote("symbols", LOW, found["symbols"] > 0.4)
    vote("capitals", LOW, (found["capitals"] > 0.5) & (words >= 5))
    vote("exclamations", LOW, found["exclamations"] > 0.3)
    vote("stutter", LOW, found["stutter"] > 0.2)
    vote("repeated_windows", LOW, long & (found["repeated_windows"] > 0.3))
    vote("separators", LOW, found["separators"] > 0.2)
    vote("plain_words", HIGH, found["plain_words"] > 0.85)
    vote("sentence_ends", HIGH, (found["sentence_ends"] > 0.02) & ((found["sentence_ends"] < 0.5) | (words < 8)))
    vote("variety", HIGH, found["variety"] > 0.25)
    vote("variety", LOW, long & (found["variety"] < 0.1))
    vote("lower_case", HIGH, found["lower_case"] > 0.5)
    out[:, words == 0] = LOW
    return out


def features(
    block: Block, shape: np.ndarray, found: dict[str, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashed feature and value: shares of word shapes and of pairs of them, and binned shares."""
    n = np.maximum(block.words, 1)
    doc = [block.doc]
    key = [mixed(shape)]
    value = [1 / n[block.doc]]
    follows = same_text(block.doc, 2)
    doc.append(block.doc[: len(follows)][follows])
    key.append(mixed(mixed(shape[:-1][follows]) + shape[1:][follows]) if len(shape) else key[0])
    value.append(1 / n[doc[1]])
    every = np.arange(block.rows)
    for i, share in enumerate(found.values()):
        binned = np.floor(np.clip(share, 0, 2) * 10).astype(np.uint64)
        doc.append(every)
        key.append(mixed(binned + np.uint64(1000 * (i + 1))))
        value.append(np.full(block.rows, 0.5))
    doc, key, value = np.concatenate(doc), np.concatenate(key) % np.uint64(FEATURES), np.concatenate(value)
    at = doc * FEATURES + key.astype(np.int64)
    at, back = np.unique(at, return_inverse=True)
    return at // FEATURES, at % FEATURES, np.bincount(back, value)


def described(docs: DataFrame) -> DataFrame:
    """Per row its id, words, votes as one number to the base 3, and hashed features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        powers = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for block in blocks(batch.column(1), HASHED_BYTES):
                shape, found = shares(block, hasher)
                doc, key, value = features(block, shape, found)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array(block.words.astype(np.int64)),
                        pa.array(powers @ votes(found, block.words)),
                        pa.ListArray.from_arrays(bounds, pa.array(key.astype(np.int16))),
                        pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32))),
                    ],
                    ["doc_id", "n_words", "votes", "keys", "shares"],
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_id}, n_words long, votes long, keys array<short>, shares array<float>"
    )
    return written(found, "described", TEXT_ROWS)


class VoteModel(NamedTuple):
    """How often each labeller votes low, not, or high on poor (0) and good (1) documents, and the share of
    good ones. ``rates`` has the axes class, labeller, vote."""

    rates: np.ndarray
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is good."""
        each = np.log(self.rates[:, np.arange(len(LABELLERS)), patterns]).sum(axis=2)
        odds = each[1] - each[0] + np.log(self.good / (1 - self.good))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller's votes the share that is right."""
        poor, good = (1 - self.good) * self.rates[0], self.good * self.rates[1]
        return (poor[:, LOW] + good[:, HIGH]) / (poor + good)[:, [LOW, HIGH]].sum(axis=1)


def fitted(patterns: np.ndarray, counts: np.ndarray) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts. It begins with documents that any
    labeller finds poor as probably poor, and all others as probably good."""
    after = np.where((patterns == LOW).any(axis=1), 1 - START_GOOD, START_GOOD)
    model = VoteModel(np.full((2, len(LABELLERS), 3), 1 / 3), 0.5)
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - after), counts * after])
        each = np.stack([weight @ (patterns == v) for v in (LOW, NONE, HIGH)], axis=2) + 1.0
        total = np.maximum(counts.sum(), 1)
        model = VoteModel(each / each.sum(axis=2, keepdims=True), float(np.clip(weight[1].sum() / total, 0.01, 0.99)))
        after = model.posterior(patterns)
    return model


def unpacked(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def trained(rows: np.ndarray, keys: np.ndarray, values: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, both classes counting the same, by adaptive steps."""
    weights, bias = np.zeros(FEATURES), 0.0
    seen, seen_bias = np.full(FEATURES, 1e-8), 1e-8
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-6), 0.5 / max((target <= 0.5).mean(), 1e-6))
    for _ in range(TRAIN_ROUNDS):
        score = np.bincount(rows, weights[keys] * values, len(target)) + bias
        error = balance * (1 / (1 + np.exp(-score)) - target) / len(target)
        slope = np.bincount(keys, error[rows] * values, FEATURES) + PENALTY * weights / len(target)
        seen += slope**2
        seen_bias += error.sum() ** 2
        weights -= STEP * slope / np.sqrt(seen)
        bias -= STEP * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def classify_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, weak_label (posterior), score and kept (score at least 0.5)."""
    rows = described(docs)
    patterns = rows.where("n_words > 0").groupBy("votes").count().toArrow()  # 3^10 rows at most
    model = fitted(unpacked(patterns.column(0).to_numpy()), patterns.column(1).to_numpy().astype(float))
    total = max(int(np.sum(patterns.column(1).to_numpy())), 1)
    share = F.lit(min(1.0, sample_rows / total))
    in_sample = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    sample = rows.where("n_words > 0").where(in_sample).select("votes", "keys", "shares").toArrow()
    bounds = sample.column(1).combine_chunks()
    lengths = np.diff(bounds.offsets.to_numpy()) if len(bounds) else np.zeros(0, int)
    weights, bias = np.zeros(FEATURES), 0.0
    if sample.num_rows:
        weights, bias = trained(
            np.repeat(np.arange(sample.num_rows), lengths),
            bounds.flatten().to_numpy().astype(int),
            sample.column(2).combine_chunks().flatten().to_numpy().astype(float),
            model.posterior(unpacked(sample.column(0).to_numpy())),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, TEXT_ROWS):
            n = batch.num_rows
            lists = batch.column(3)
            at = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            keys = lists.flatten().to_numpy().astype(int)
            score = np.bincount(at, weights[keys] * batch.column(4).flatten().to_numpy(), n) + bias
            words = batch.column(1).to_numpy()
            score = np.where(words > 0, 1 / (1 + np.exp(-score)), 0.0)
            label = np.where(words > 0, model.posterior(unpacked(batch.column(2).to_numpy())), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(label), pa.array(score), pa.array(score >= 0.5)],
                ["doc_id", "n_words", "weak_label", "score", "kept"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc_id}, n_words long, weak_label double, score double, kept boolean")
