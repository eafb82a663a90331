"""Fingerprints by locally consistent parsing, and how alike a text, its edited form and its successor are.

A text is cut into phrases where its own symbols say so: each symbol is compared with its left neighbour,
and the place and value of the lowest bit in which they differ become its new label (a deterministic coin).
Four such rounds leave six labels; a phrase begins at each local maximum. Before that, runs of one symbol are
cut into threes, each taken as one symbol. The hash of a phrase is its name, and the names are parsed again, level by level. Where a
phrase begins depends on the few symbols around it alone, so equal substrings get the same inner phrases
on every level, whatever stands before them and at whatever offset.

The fingerprint of a text holds the smallest hashes of its phrases on two levels: the highest one that has
FEW phrases or more, and the one below. The n-th occurrence of a phrase counts as a phrase of its own, so
repeated passages have their weight. Likeness is the share of phrases two texts have in common (2J / (1 + J)
of the estimated Jaccard index J), as the mean over the levels that both fingerprints hold; texts
whose fingerprints hold no level in common differ in length many times over and have likeness 0.

Null texts count as empty; empty texts have the same fingerprint, and nothing in common with others. The
next document is the one with the next id; null ids come first, and rows of the same id follow each other by a
hash of their text. Each repeated row is a document of its own. An empty table gives an empty result. A text
is parsed whole; a task needs some 100 bytes for each byte of its longest text. Bytes that are not UTF-8
are read as U+FFFD. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, written
from lineward.llm.words import BLOCK_BYTES, Hasher, codes_of, mixed

# The higher level of a fingerprint has this many phrases at least, unless the text is too short.
FEW = 48
# Smallest hashes kept on each level.
KEPT = 32
# Symbols of a run that become one.
RUN = 3
_ROUNDS = 4
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary,"
    " near_edited double, near_next double"
)


def labels(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels below six that depend on a name and the four before it; neighbours differ as the names do.

    ``begins`` are the places where texts begin: nothing stands to the left of these.
    """
    for _ in range(_ROUNDS):
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[begins] = ~names[begins]
        differs = names ^ left
        lowest = differs & (~differs + differs.dtype.type(1))
        bit = np.bitwise_count(lowest - lowest.dtype.type(1))
        names = bit * np.uint8(2) + ((names & lowest) != 0)
    return names


def phrase_starts(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where phrases begin: at every local maximum of the labels, where a text begins, and at every name
    that equals a neighbour, which is a phrase by itself."""
    same = np.zeros(len(names) + 1, bool)
    same[1:-1] = names[1:] == names[:-1]
    same[begins] = False
    alone = same[:-1] | same[1:]
    if alone.any():
        cut = alone.copy()
        cut[1:] |= alone[:-1]
        cut[begins] = True
        begins = np.flatnonzero(cut)
    label = labels(names, begins).astype(np.int8)
    starts = np.zeros(len(names), bool)
    starts[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    starts[begins[begins > 0] - 1] = False  # nothing follows the last symbol of a stretch
    starts[begins] = True
    return np.flatnonzero(starts)


def next_level(names: np.ndarray, begins: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of ``names``, and where the texts begin among these."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    fresh[begins] = True
    place = np.arange(len(names))
    in_run = place - np.maximum.accumulate(np.where(fresh, place, 0))
    pieces = np.flatnonzero(in_run % RUN == 0)
    lengths = np.diff(pieces, append=len(names)).astype(np.uint64)
    pieces_begin = np.searchsorted(pieces, begins)
    symbols = mixed(names[pieces] + lengths * _NEXT)
    starts = phrase_starts(symbols, pieces_begin)
    ends = np.append(starts[1:], len(symbols))
    return hasher.runs(symbols, starts, ends), np.searchsorted(starts, pieces_begin)


def smallest(names: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Of each text the smallest hashes of its phrases, occurrences counted apart."""
    text = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(names)))
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    place = np.arange(len(names))
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    occurrence = place - np.maximum.accumulate(np.where(fresh, place, 0))
    hashes = mixed(names + occurrence.astype(np.uint64) * _FIRST) >> np.uint64(32)
    keys = np.sort((text.astype(np.uint64) << np.uint64(32)) | hashes).astype(np.uint32)
    bounds = np.append(begins, len(names))
    return [keys[a : min(a + KEPT, b)] for a, b in zip(bounds[:-1], bounds[1:])]


class Parser:
    """Fingerprints of many texts at once; tables are kept between batches."""

    def __init__(self):
        self.codes = codes_of(np.arange(256, dtype=np.uint8))
        self.hasher = Hasher()

    def fingerprints(self, texts: list[bytes]) -> list[bytes]:
        """A byte for the higher level, then for it and the level below a byte for how many hashes
        follow, and these in ascending order, four bytes each."""
        out = [bytes(2)] * len(texts)
        some: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                some.append(i)
                size += len(text)
            if some and (size >= BLOCK_BYTES or i + 1 == len(texts)):
                for j, found in zip(some, self._block([texts[j] for j in some])):
                    out[j] = found
                some, size = [], 0
        if some:
            for j, found in zip(some, self._block([texts[j] for j in some])):
                out[j] = found
        return out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        names = self.codes[np.frombuffer(b"".join(texts), np.uint8)]
        levels = []
        while True:
            levels.append((names, begins))
            counts = np.diff(begins, append=len(names))
            if (counts < FEW).all():
                break
            names, begins = next_level(names, begins, self.hasher)
        highest = np.zeros(len(texts), np.int64)
        for level, (names, begins) in enumerate(levels):
            highest[np.diff(begins, append=len(names)) >= FEW] = level
        parts: list[list[bytes]] = [[] for _ in texts]
        for level in range(len(levels) - 1, -1, -1):
            wanted = np.flatnonzero((highest == level) | (highest == level + 1))
            if not len(wanted):
                continue
            names, begins = levels[level]
            if level == 0:  # pairs of neighbouring bytes
                left = np.empty_like(names)
                left[1:] = names[:-1]
                left[begins] = _FIRST
                names = mixed(names + left * _NEXT)
            ends = np.append(begins[1:], len(names))
            lengths = (ends - begins)[wanted]
            first = np.cumsum(lengths) - lengths
            take = np.arange(lengths.sum()) + np.repeat(begins[wanted] - first, lengths)
            for text, found in zip(wanted, smallest(names[take], first)):
                parts[text].append(bytes([len(found)]) + found.astype(">u4").tobytes())
        return [bytes([h]) + b"".join(p) for h, p in zip(highest, parts)]


def hashes_of(fingerprint: bytes) -> dict[int, set[bytes]]:
    """The hashes of each level."""
    level, at, out = fingerprint[0], 1, {}
    while at < len(fingerprint):
        end = at + 1 + 4 * fingerprint[at]
        out[level] = {fingerprint[i : i + 4] for i in range(at + 1, end, 4)}
        level, at = level - 1, end
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The share of phrases that two fingerprints tell to be in both texts."""
    if a == b:
        return 1.0
    ours, theirs = hashes_of(a), hashes_of(b)
    shares = []
    for level in ours.keys() & theirs.keys():
        both, either = ours[level] & theirs[level], ours[level] | theirs[level]
        least = sorted(either)[:KEPT]
        common = sum(h in both for h in least) / len(least) if least else 0.0
        shares.append(2 * common / (1 + common))
    return sum(shares) / len(shares) if shares else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``."""
    count = len(text) // 4
    return text[: len(text) - count] + following[:count]


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _results(parser: Parser, ids: list, texts: list[str], prints: list[bytes], next_texts: list[str], next_prints: list[bytes]) -> dict:
    changed = [edited(t, n).encode() for t, n in zip(texts, next_texts)]
    changed_prints = parser.fingerprints(changed)
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([sha256(c).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array(prints, pa.binary()),
        "edited_fingerprint": pa.array(changed_prints, pa.binary()),
        "near_edited": pa.array([likeness(p, c) for p, c in zip(prints, changed_prints)], pa.float64()),
        "near_next": pa.array([likeness(p, n) for p, n in zip(prints, next_prints)], pa.float64()),
    }
    return columns


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of a sorted partition: results of all but the last one, and the texts of
    the first and the last, which meet their neighbours of other partitions later."""
    parser, part = Parser(), TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    prints: list[bytes] = []

    def end(role: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        nothing = _results(parser, [], [], [], [], [])
        columns = {k: pa.nulls(1, v.type) for k, v in nothing.items()} | {"doc_id": pa.array([doc_id], pa.int64())}
        more = {"role": [role], "text": [text], "part": pa.array([part], pa.int32())}
        return pa.record_batch(columns | more)

    for batch in batches:
        if not batch.num_rows:
            continue
        more = _texts(batch.column(1))
        if not ids:
            yield end("first", None, more[0])
        ids += batch.column(0).to_pylist()
        texts += more
        prints += parser.fingerprints([t.encode() for t in more])
        done = len(ids) - 1
        found = _results(parser, ids[:done], texts[:done], prints[:done], texts[1:], prints[1:])
        rows = {"role": pa.array(["row"] * done, pa.string()), "text": pa.nulls(done, pa.string())}
        yield pa.record_batch(found | rows | {"part": pa.array([part] * done, pa.int32())})
        ids, texts, prints = ids[done:], texts[done:], prints[done:]
    if ids:
        yield end("last", ids[0], texts[0])


def _at_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (doc_id, text, next_text)."""
    parser = Parser()
    for batch in batches:
        texts, following = _texts(batch.column(1)), _texts(batch.column(2))
        prints = parser.fingerprints([t.encode() for t in texts])
        next_prints = parser.fingerprints([t.encode() for t in following])
        ids = batch.column(0).to_pylist()
        yield pa.record_batch(_results(parser, ids, texts, prints, following, next_prints))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The texts go through one shuffle, into ranges of ids. A sorted range gives every row but its last the text that
    follows; the last row of a range meets the first of the next one in a join with a row for each
    range. Only the numbers of the ranges come to the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id"), F.col("tie"), F.col("row_no")]
    tied = read.withColumns({"tie": F.xxhash64("text"), "row_no": F.monotonically_increasing_id()})
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = ordered.mapInArrow(_in_order, f"{RESULT}, role string, text string, part int")
    found = written(found, "phrases", TEXT_ROWS)
    ends = found.where("role <> 'row'")
    parts = sorted(r["part"] for r in ends.where("role = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = ends.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = ends.where("role = 'last'").select("doc_id", "text", "part")
    bounds = last.join(follows, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    rows = found.where("role = 'row'").drop("role", "text", "part")
    every = rows.unionByName(bounds.mapInArrow(_at_bounds, RESULT))
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return every.withColumns(hexed)
