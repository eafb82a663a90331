"""Scores of a bigram language model held in a log-frequency Bloom filter.

The filter holds counts of words and word pairs in quantised form: a count of level q is entered as the
items (n-gram, 1) to (n-gram, q), and read back by probing levels until one is missing. The probability of
a word mixes its share among what followed the word before it with its share of all words; the weights of
the mixture depend on the level of the word before and are fitted on training text with each pair's own
occurrence taken out. A text begins with an end token and closes with one.

Beside it stands an exact smoothed word model: the counts of all training words. Words that make up at
least one 2^20th of the training text, of which there can be no more than 2^20, are broadcast; all others
meet their counts by a join, so no word's rows meet in one task.

The filter takes at least 8 bits for each item, however many there are. Its segments are made where the n-grams
meet and written; runs of segments of at most PART_BITS are broadcast as parts. Tasks that meet more than HELD_PARTS
parts load them one after another for many tokens at once, and never hold the whole filter.

Null and empty texts are one end token. An empty training set gives every token the floor probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, held_out, written
from lineward.llm.words import Hasher, blocks, mixed

FOLDS = 10
HELD_OUT = 0
FLOOR = 0.1
# Quantised counts: level q stands for counts from QUANT^(q-1) up.
QUANT = 1.5
LEVELS = 64
PROBES = 4
BITS_PER_ITEM = 8
SEGMENTS = 1024
# Bits of one part of the filter; parts a task keeps loaded; bytes of rows it probes at once when there are more.
PART_BITS = 1 << 29
HELD_PARTS = 2
PROBED_BYTES = 16 << 20
# Pairs of so many segments are counted first, to see how many items the filter has to take.
SAMPLED_SEGMENTS = 16
# Pairs that meet in one task at most, about: a segment is dealt to as many tasks as that needs.
PAIRS_TOGETHER = 4_000_000
COMMON_SHARE = 1 << 20
RATIO_BINS = 64
# Pairs a task gathers before it sends them on; bounds its memory only.
GATHERED = 2_000_000

BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
END = np.uint64(0x1F83D9ABFB41BD6B)
PAIR = np.uint64(0x9E3779B97F4A7C15)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for none."""
    counts = np.maximum(counts, 0).astype(float)
    with np.errstate(divide="ignore"):
        level = 1 + np.floor(np.log(counts) / np.log(QUANT) + 1e-9)
    return np.clip(np.where(counts < 1, 0, level), 0, LEVELS - 1).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers of that level."""
    out = np.zeros(LEVELS)
    for q in range(1, LEVELS):
        low, high = np.ceil(QUANT ** (q - 1) - 1e-6), np.ceil(QUANT**q - 1e-6) - 1
        out[q] = (low + max(high, low)) / 2
    return out


class CountFilter:
    """Levels of n-grams by repeated membership probes. The parts are broadcasts of equal runs of segments."""

    def __init__(self, parts: list, segment_bits: int):
        self.parts, self.segment_bits = parts, segment_bits

    @property
    def split(self) -> bool:
        return len(self.parts) > HELD_PARTS

    @staticmethod
    def segment(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(54)).astype(np.int64)

    @staticmethod
    def items(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of the items (key, level) begin, and by how much they go on."""
        item = mixed(keys + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
        return item, mixed(item) | np.uint64(1)

    @staticmethod
    def place(item: np.ndarray, segment_bits: int) -> np.ndarray:
        place = item >> np.uint64(20)
        if segment_bits & (segment_bits - 1):
            return (place % np.uint64(segment_bits)).view(np.int64)
        return (place & np.uint64(segment_bits - 1)).view(np.int64)  # the same, without a division

    @classmethod
    def made(cls, keys: np.ndarray, levels: np.ndarray, segment_bits: int) -> np.ndarray:
        """The bits of one segment that hold its keys at their levels."""
        bits = np.zeros(segment_bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            item, step = cls.items(keys[levels >= level], level)
            for _ in range(PROBES):
                bits[cls.place(item, segment_bits)] = True
                item = item + step
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key such that all levels up to it are present.

        Each distinct key is looked up once, in the order of the segments, so that lookups stay close together.
        """
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        segment = self.segment(keys)
        size = SEGMENTS // len(self.parts)
        for i, part in enumerate(self.parts):
            at = np.flatnonzero(segment // size == i)
            if len(at):
                out[at] = self.probed(part.value, keys[at], (segment[at] - i * size) * self.segment_bits)
                if self.split and part.__dict__.get("_path") is not None:
                    part.__dict__.pop("_value", None)  # read again from its file when it is next asked for
        return out[back]

    def probed(self, bits: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The levels of keys whose segments begin at the bits ``base`` of a part."""
        out = np.zeros(len(keys), np.int64)
        held = np.arange(len(keys))
        for level in range(1, LEVELS):
            item, step = self.items(keys, level)
            for _ in range(PROBES):
                at = base + self.place(item, self.segment_bits)
                hit = np.flatnonzero(bits[at >> 3] & BIT[at & 7])
                item = item + step
                if len(hit) < len(held):
                    held, keys, base, item, step = (x[hit] for x in (held, keys, base, item, step))
            if not len(held):
                break
            out[held] = level
        return out


def probed_blocks(batches: Iterator[pa.RecordBatch], text: int, held: CountFilter) -> Iterator[tuple]:
    """Batches and the blocks of their texts; many rows in one when the filter's parts take turns."""

    def together() -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= PROBED_BYTES:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    for batch in together() if held.split else batches:
        found = blocks(batch.column(text), PROBED_BYTES) if held.split else blocks(batch.column(text))
        for block in found:
            yield batch, block


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * PAIR + word)


def token_stream(block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, token and preceding token of every token of a block; each text ends with an end token."""
    sizes = block.words + 1
    ends = np.cumsum(sizes)
    tokens = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends - 1] = False
    tokens[is_word] = words
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    before[ends[:-1]] = END
    return np.repeat(np.arange(block.rows), sizes), tokens, before


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    if counts is None:
        return keys[first], np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _training(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(~held_out(FOLDS, HELD_OUT))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def gram_counts(docs: DataFrame) -> DataFrame:
    """kind 0: hash and exact count of every training token; kind 1: the same of the pairs of the sampled
    segments. A task adds up its own counts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in enumerate(held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                    ["kind", "gram", "n"],
                )

        for batch in batches:
            for block in blocks(batch.column(1)):
                _, tokens, before = token_stream(block, hasher.words(block))
                pairs = pair_keys(before, tokens)
                sampled = pairs[CountFilter.segment(pairs) < SAMPLED_SEGMENTS]
                for kind, keys in enumerate((tokens, sampled)):
                    new, n = _counted(keys)
                    old, m = held[kind]
                    held[kind] = _counted(np.concatenate([old, new]), np.concatenate([m, n]))
                if len(held[0][0]) > GATHERED:
                    yield from sent()
                    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        yield from sent()

    gathered = _training(docs).mapInArrow(run, "kind int, gram long, n long")
    return written(gathered.groupBy("kind", "gram").agg(F.sum("n").alias("c")), "grams", TEXT_ROWS)


def _packed(keys: np.ndarray, counts: np.ndarray, slices: int) -> pa.RecordBatch:
    """Ascending keys and their counts, one row for each slice of each segment. A count over 16 bits takes
    several entries of its key, which are added up where they meet."""
    entries = np.maximum(-(-counts // 0xFFFF), 1)
    last = np.cumsum(entries) - 1
    short = np.full(int(entries.sum()), 0xFFFF, np.uint16)
    short[last] = counts - 0xFFFF * (entries - 1)
    keys = np.repeat(keys, entries)
    groups = SEGMENTS * slices
    of_key = ((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    bounds = np.searchsorted(of_key, np.arange(groups + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(bounds))
    at = np.concatenate([bounds[some], bounds[-1:]])
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int64)), _binary(keys, at), _binary(short, at)], ["part", "keys", "counts"]
    )


def count_filter(docs: DataFrame, grams: DataFrame, tokens: int, bits: int) -> CountFilter:
    """The filter of all words and pairs, in ``bits`` bits."""
    segment_bits = bits // SEGMENTS
    slices = max(1, -(-tokens // (SEGMENTS * PAIRS_TOGETHER)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        waiting, size = [], 0
        for batch in batches:
            for block in blocks(batch.column(1)):
                _, tokens, before = token_stream(block, hasher.words(block))
                waiting.append(pair_keys(before, tokens))
                size += len(tokens)
                if size > GATHERED:
                    yield _packed(*_counted(np.concatenate(waiting)), slices)
                    waiting, size = [], 0
        if waiting:
            yield _packed(*_counted(np.concatenate(waiting)), slices)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield _packed(*_counted(keys, batch.column(1).to_numpy()), slices)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        for part, held in groupby(rows, itemgetter(0)):
            keys, counts = zip(*((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint16)) for _, k, c in held))
            keys, counts = _counted(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
            made = CountFilter.made(keys, level_of(counts), segment_bits)
            yield pa.RecordBatch.from_pydict({"segment": [part // slices], "bits": [made.tobytes()]})

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        made = np.zeros(segment_bits // 8, np.uint8)
        for bits in rows.column("bits").to_pylist():
            made |= np.frombuffer(bits, np.uint8)
        return pa.table({"segment": [key[0].as_py()], "bits": [made.tobytes()]})

    packed = "part long, keys binary, counts binary"
    rows = _training(docs).mapInArrow(pairs, packed)
    rows = rows.union(grams.where("kind = 0").select("gram", "c").mapInArrow(words, packed))
    segments = (
        rows.repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(filled, "segment long, bits binary")
        .groupBy("segment")
        .applyInArrow(merged, "segment long, bits binary")
    )
    segments = written(segments, "segments")
    n_parts = min(max(1, bits // PART_BITS), SEGMENTS)
    size = SEGMENTS // n_parts
    parts = []
    for i in range(n_parts):
        part = np.zeros((size, segment_bits // 8), np.uint8)
        of_part = segments.where((F.col("segment") >= i * size) & (F.col("segment") < (i + 1) * size))
        for row in of_part.toLocalIterator():  # a few segments at a time
            part[row["segment"] - i * size] = np.frombuffer(row["bits"], np.uint8)
        parts.append(docs.sparkSession.sparkContext.broadcast(part.ravel()))
    return CountFilter(parts, segment_bits)


def filter_bits(grams: DataFrame) -> int:
    """The bits of a filter that takes every word and pair."""
    level = F.least(
        F.lit(LEVELS - 1), 1 + F.floor(F.log(F.col("c").cast("double")) / float(np.log(QUANT)) + 1e-9)
    )
    rows = grams.select("kind", level.alias("level")).groupBy("kind", "level").count().collect()
    items = 0
    for row in rows:  # two kinds of at most LEVELS levels
        items += row["count"] * row["level"] * (SEGMENTS // SAMPLED_SEGMENTS if row["kind"] else 1)
    return 1 << max(20, int(np.ceil(np.log2(max(items, 1) * BITS_PER_ITEM))))


class Model:
    """What a task needs to score tokens: common words, totals, weights of the mixture."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, kinds: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.scale = tokens, tokens + FLOOR * (kinds + 1)
        self.weights = np.zeros(LEVELS)
        self.of_level = level_counts()

    def common(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is a common word, and its exact count."""
        if not len(self.words):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        found = self.words[at] == tokens
        return found, np.where(found, self.counts[at], 0)

    def shares(
        self, held: CountFilter, tokens: np.ndarray, before: np.ndarray, left_out: int = 0
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Level of the token before; the token's share after that one, and its share of all words; whether
        it is a common word, and its exact count."""
        keys, back = np.unique(tokens, return_inverse=True)
        found, exact = self.common(keys)
        levels = np.zeros(len(keys), np.int64)
        rare = keys[~found]
        probed = held.levels(np.concatenate([rare, pair_keys(before, tokens)]))
        levels[~found] = probed[: len(rare)]
        counts = np.where(found, exact, self.of_level[levels])
        levels = np.where(found, level_of(exact), levels)
        of_before = np.concatenate([back[:1], back[:-1]])
        other = np.flatnonzero(keys[of_before] != before)  # before the first token of a text: the end token
        of_before[other] = np.minimum(np.searchsorted(keys, before[other]), len(keys) - 1)
        known = keys[of_before] == before
        count_before = np.where(known, counts[of_before], 0)
        level_before = np.where(known, levels[of_before], 0)
        pair = self.of_level[probed[len(rare) :]]
        after = np.maximum(pair - left_out, 0) / np.maximum(count_before - left_out, 1)
        after = np.where(count_before > left_out, np.minimum(after, 1), 0)
        overall = (np.maximum(counts[back] - left_out, 0) + FLOOR) / max(self.scale - left_out, FLOOR)
        return level_before, after, overall, found[back], exact[back]


def _fitted(docs: DataFrame, model, held: CountFilter) -> np.ndarray:
    """The weight of the share after the word before, for each of its levels: by expectation
    maximisation over counts of ratios between the two shares, each token's own occurrence left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros((LEVELS, RATIO_BINS), np.int64)
        for _, block in probed_blocks(batches, 1, held):
            _, tokens, before = token_stream(block, hasher.words(block))
            level, after, overall, _, _ = model.value.shares(held, tokens, before, 1)
            ratio = np.clip(np.log2(np.maximum(after / overall, 2.0**-10)) + 10, 0, RATIO_BINS / 2 - 1) * 2
            cell = level * RATIO_BINS + np.where(after > 0, 1 + ratio, 0).astype(int)
            counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
        level, ratio = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"level": level, "ratio": ratio, "n": counts[level, ratio]})

    each = _training(docs).mapInArrow(run, "level long, ratio long, n long")
    found = each.groupBy("level", "ratio").agg(F.sum("n").alias("n"))
    counts = np.zeros((LEVELS, RATIO_BINS))
    for row in found.collect():  # LEVELS * RATIO_BINS rows at most
        counts[row["level"], row["ratio"]] = row["n"]
    ratios = np.concatenate([[0], 2.0 ** ((np.arange(1, RATIO_BINS) - 0.5) / 2 - 10)])
    weights = np.full(LEVELS, 0.3)
    for _ in range(50):
        pair = weights[:, None] * ratios
        share = pair / (pair + 1 - weights[:, None])
        total = counts.sum(axis=1)
        weights = np.where(total > 0, (counts * share).sum(axis=1) / np.maximum(total, 1), 0)
        weights = np.clip(weights, 0, 0.999)
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    grams = gram_counts(docs)
    words = grams.where("kind = 0")
    totals = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count("*").alias("kinds"),
    ).first()
    tokens, kinds = totals["tokens"], totals["kinds"]
    is_common = F.col("c") * F.lit(COMMON_SHARE) >= F.lit(tokens)
    common = words.where(is_common).select("gram", "c").toArrow()  # COMMON_SHARE rows at most
    held = count_filter(docs, grams, tokens, filter_bits(grams))
    model = Model(
        common.column(0).to_numpy().view(np.uint64),
        common.column(1).to_numpy(),
        tokens,
        kinds,
    )
    unfitted = spark.sparkContext.broadcast(model)
    model.weights = _fitted(docs, unfitted, held)
    shared, weights = unfitted, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(), shared.value
        for batch, block in probed_blocks(batches, 2, held):
            doc, tokens, before = token_stream(block, hasher.words(block))
            n = block.rows
            level, after, overall, found, exact = model.shares(held, tokens, before)
            mix = weights[level] * after + (1 - weights[level]) * overall
            base = np.log10((exact[found] + FLOOR) / model.scale)
            order = np.lexsort((tokens[~found], doc[~found]))
            rare, of = tokens[~found][order], doc[~found][order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate([first, [len(rare)]])).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=n))])
            rows = pa.StructArray.from_arrays(
                [pa.array(rare[first].view(np.int64)), pa.array(times)], ["word", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, n),
                    batch.column(1).slice(block.first, n),
                    pa.array((block.words + 1).astype(np.int64)),
                    pa.array(np.bincount(doc[found], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(doc[found], base, n)),
                    pa.array(np.bincount(doc, np.log10(mix), n)),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), rows),
                ],
                ["doc_id", "held_out", "n_tokens", "n_common", "base_common", "score", "rare"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "text").mapInArrow(
        run,
        f"doc_id {doc_id}, held_out boolean, n_tokens long, n_common long, base_common double, score double,"
        " rare array<struct<word: long, times: long>>",
    )
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored", TEXT_ROWS)
    rare = scored.select("row", F.explode("rare").alias("at")).select("row", "at.*")
    count = F.coalesce(F.col("c"), F.lit(0))
    summed = (
        rare.join(words.where(~is_common).select("gram", "c"), F.col("word") == F.col("gram"), "left")
        .groupBy(F.col("row").alias("r_row"))
        .agg(
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("n_rare"),
            F.sum(F.col("times") * F.log10((count + F.lit(FLOOR)) / F.lit(float(model.scale)))).alias("base_rare"),
        )
    )
    return scored.join(summed, F.col("row") == F.col("r_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        "score",
    )
