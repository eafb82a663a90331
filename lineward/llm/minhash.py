"""Near-duplicate groups by HyperMinHash sketches.

The distinct word shingles of a document fall into buckets by their hash. A register keeps the smallest
second hash of its bucket in compressed form: its count of leading zeros and the mantissa bits after
them. An empty register borrows from a bucket that its number points at, so short documents have full
sketches too. Registers go into bands; documents with an equal band are candidates. The share of equal
registers, corrected for registers that agree by chance, estimates the Jaccard similarity and drops
candidates far below the threshold; the rest are verified on their full shingle sets.

Documents with equal sets are one class, represented by its smallest id, from the start. Within the
documents of an equal band only links to one hub are tested first (the member that shares most bands
with others), so a group of copies costs as many pairs as it has members. Bands whose members are then
still in several components are compared again in blocks of members, pair by pair, within tasks; only
pairs of different components whose estimate, now from a longer sketch, is near the threshold leave a
task.

At the threshold 0.8 a pair shares no band with a probability of 1.3e-7.

Null and empty texts have no shingles and no links; a text with fewer words than a shingle has one, its
whole sequence. Rows of one id are one document. Rows without id belong to the class of equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, small, written
from lineward.llm.components import components
from lineward.llm.words import HASHED_BYTES, Hasher, blocks, mixed, same_text, sequence_hashes

BANDS = 40
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
BORROWS = 30
# Estimates have a standard deviation of 0.028 at 0.8; candidates this far below cannot be links but
# with a probability below 1e-6.
MARGIN = 0.14
# Second sketches, of documents that are compared pair by pair: so many of the smallest shingle hashes in
# 32 bits. Up to that size they are the set itself; beyond, estimates deviate by 0.018 at 0.8.
SMALLEST = 512
SMALLEST_MARGIN = 0.09
ROUNDING = 0.005
# Members of one block when the members of a band are compared pair by pair.
BLOCK_ROWS = 256
BLOCKS_AT_ONCE = 16


def shingle_sets(block, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle of a block, by text and hash."""
    words = hasher.words(block)
    runs = sequence_hashes(words, size)
    inside = same_text(block.doc, size)
    doc, value = block.doc[: len(runs)][inside], runs[inside]
    few = np.flatnonzero((block.words > 0) & (block.words < size))
    if len(few):
        first = np.searchsorted(block.doc, few)
        short = np.array(
            [sequence_hashes(words[i : i + n], int(n))[0] for i, n in zip(first, block.words[few])], np.uint64
        )
        doc, value = np.concatenate([doc, few]), np.concatenate([value, short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def compressed(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 64-bit hashes, in 16 bits that keep their order."""
    fraction, exponent = np.frexp(hashes.astype(np.float64))
    octave = np.clip(exponent - 1, 0, 63).astype(np.uint16)
    steps = 1 << MANTISSA_BITS
    mantissa = np.clip((fraction * 2 - 1) * steps, 0, steps - 1).astype(np.uint16)
    return (octave << np.uint16(MANTISSA_BITS)) | mantissa


def sketches(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Registers of each of ``rows`` texts; those of texts without shingles mean nothing."""
    bucket = ((value >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(rows * REGISTERS, empty, np.uint64)
    np.minimum.at(least, doc * REGISTERS + bucket.astype(np.int64), mixed(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    least = least.reshape(rows, REGISTERS)
    filled = least != empty
    some = filled.any(axis=1)
    at_row, at = np.nonzero(~filled & some[:, None])
    out = least.copy()
    for turn in range(BORROWS):
        if not len(at):
            break
        source = (mixed(at.astype(np.uint64) + np.uint64((turn + 1) * 1000)) % np.uint64(REGISTERS)).astype(int)
        found = filled[at_row, source]
        out[at_row[found], at[found]] = least[at_row[found], source[found]]
        at_row, at = at_row[~found], at[~found]
    if len(at):  # from the next filled bucket to the right, around the end
        place = np.where(np.tile(filled, 2), np.arange(2 * REGISTERS), 2 * REGISTERS)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1] % REGISTERS
        out[at_row, at] = least[at_row, following[at_row, at]]
    return compressed(out.ravel()).reshape(rows, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash of each band's number and registers."""
    bands = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return keys.view(np.int64)


def chance(sizes: np.ndarray) -> np.ndarray:
    """The probability that registers of unrelated sets of about these sizes agree."""
    grid = 2.0 ** np.arange(0, 33)
    edges = np.concatenate(
        [[0.0], (2.0 ** np.arange(-63, 0)[:, None] * (1 + np.arange(64) / 64)).ravel(), [1.0]]
    )
    in_register = np.maximum(grid / REGISTERS, 1.0)
    survive = (1 - edges)[None, :] ** in_register[:, None]
    cells = survive[:, :-1] - survive[:, 1:]
    agree = (cells**2).sum(axis=1) * 64 / (1 << MANTISSA_BITS)
    return np.interp(np.log2(np.maximum(sizes, 1)), np.arange(33), agree)


def estimated(equal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what agrees by chance."""
    by_chance = chance(sizes)
    return (equal - by_chance) / (1 - by_chance)


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, registers, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for block in blocks(batch.column(1), HASHED_BYTES):
                doc, value = shingle_sets(block, hasher, size)
                n = np.bincount(doc, minlength=block.rows)
                ends = np.cumsum(n)
                sums, other = (np.zeros(len(value) + 1, np.uint64) for _ in range(2))
                np.cumsum(mixed(value), out=sums[1:])
                np.cumsum(mixed(~value), out=other[1:])
                registers = sketches(doc, value, block.rows)
                keys = band_keys(registers)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array(n.astype(np.int64)),
                        pa.array((sums[ends] - sums[ends - n]).view(np.int64)),
                        pa.array((other[ends] - other[ends - n]).view(np.int64)),
                        _fixed_width(registers),
                        pa.ListArray.from_arrays(
                            np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32),
                            keys[~none].ravel(),
                        ),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"],
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {doc_id}, n_shingles long, set_a long, set_b long, registers binary, bands array<long>",
    )


def smallest_hashes(doc: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounds and the values of each text's smallest shingle hashes, ascending."""
    short = (mixed(value ^ np.uint64(0x5A5A5A5A5A5A5A5A)) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((short, doc))
    doc, short = doc[order], short[order]
    n = np.bincount(doc, minlength=rows)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    short = short[place < SMALLEST]
    return np.concatenate([[0], np.cumsum(np.minimum(n, SMALLEST))]), short


def shared_share(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity from the smallest hashes of two sets; exact for sets no larger than that."""
    merged = np.sort(np.concatenate([x, y]))
    twice = merged[1:] == merged[:-1]
    union = len(merged) - int(twice.sum())
    if max(len(x), len(y)) < SMALLEST or union <= SMALLEST:
        return int(twice.sum()) / max(union, 1)
    last = np.unique(merged)[SMALLEST - 1]
    return int((twice & (merged[1:] <= last)).sum()) / SMALLEST


def _fixed_width(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows, wide = len(values), values.shape[1] * values.itemsize
    bounds = np.arange(0, (rows + 1) * wide, wide, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Id and text of the documents in ``ids`` (one column ``node``)."""
    ids = small(written(ids, "picked"))
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("node"), "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The sorted shingle sets of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for block in blocks(batch.column(1), HASHED_BYTES):
                doc, value = shingle_sets(block, hasher, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.ListArray.from_arrays(ends.astype(np.int32), value.view(np.int64)),
                    ],
                    ["node", "shingles"],
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    sets = _picked(docs, ids).mapInArrow(run, f"node {doc_id}, shingles array<long>")
    return written(sets.dropDuplicates(["node"]), "sets", TEXT_ROWS)


def _smallest(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The second sketches of the documents in ``ids``, not written: they are joined where they meet their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for block in blocks(batch.column(1), HASHED_BYTES):
                bounds, short = smallest_hashes(*shingle_sets(block, hasher, size), block.rows)
                sketch = pa.Array.from_buffers(
                    pa.binary(),
                    block.rows,
                    [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(short.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), sketch], ["node", "smallest"]
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    found = _picked(docs, ids).mapInArrow(run, f"node {doc_id}, smallest binary")
    return found.dropDuplicates(["node"])


def _plausible(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""

    def side(name: str) -> DataFrame:
        return sketched.select(
            F.col("doc_id").alias(f"{name}_id"),
            F.col("n_shingles").alias(f"{name}_n"),
            F.col("registers").alias(f"{name}_r"),
        )

    joined = (
        pairs.join(side("x"), F.col("a") == F.col("x_id"))
        .join(side("y"), F.col("b") == F.col("y_id"))
        .where(F.least("x_n", "y_n") >= least * F.greatest("x_n", "y_n"))
        .select("a", "b", "x_n", "y_n", "x_r", "y_r")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for i in (4, 5)
            )
            sizes = np.sqrt(batch.column(2).to_numpy().astype(float) * batch.column(3).to_numpy())
            keep = estimated((x == y).mean(axis=1), sizes) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, batch_rows: int = TEXT_ROWS):
    """The pairs whose full sets reach the threshold."""
    pairs = written(pairs, "pairs", batch_rows)
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, ids, size)
    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("xn", "xs"), ("yn", "ys")))
    both = F.size(F.array_intersect("xs", "ys"))
    return (
        pairs.join(x, F.col("a") == F.col("xn"))
        .join(y, F.col("b") == F.col("yn"))
        .withColumn("both", both)
        .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("xs") + F.size("ys") - F.col("both")))
        .select("a", "b")
    )


def _mixed_pairs(
    members: DataFrame, sketched: DataFrame, docs: DataFrame, size: int, percent: int
) -> DataFrame:
    """Plausible pairs of different components within the bands of ``members`` (key, doc, component).

    The members of a band are dealt to blocks, and each two blocks of a band meet in one row. A pair is
    reported in its first common band only.
    """
    kind = members.schema["doc"].dataType.simpleString()
    least = percent / 100 - MARGIN
    spread = members.groupBy("key").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).alias("n_blocks"),
        (F.min("component") != F.max("component")).alias("is_mixed"),
    )
    spread = written(spread.where("is_mixed").drop("is_mixed").withColumnRenamed("key", "s_key"), "spread")
    dealt = written(
        members.join(spread, F.col("key") == F.col("s_key")).withColumn(
            "block", F.pmod(F.xxhash64("doc"), F.col("n_blocks"))
        ),
        "dealt",
    )
    smallest = _smallest(docs, dealt.select(F.col("doc").alias("node")).distinct(), size)
    both = sketched.select("doc_id", "n_shingles", "registers").join(smallest, F.col("doc_id") == F.col("node"))
    lists = (
        written(both, "both", TEXT_ROWS)
        .join(small(dealt), F.col("doc") == F.col("doc_id"))
        .groupBy("key", "block", "n_blocks")
        .agg(F.collect_list(F.struct("doc", "component", "n_shingles", "registers", "smallest")).alias("rows"))
    )
    lists = written(lists, "blocks")
    # A band of one block meets itself where it is; its rows need no second shuffle, nor a copy of them.
    single = lists.where("n_blocks = 1").select(F.lit(True).alias("same"), "key", "rows", F.lit(None).alias("o_rows"))
    several = lists.where("n_blocks > 1")
    other = several.select(
        F.col("key").alias("o_key"), F.col("block").alias("o_block"), F.col("rows").alias("o_rows")
    )
    met = several.join(other, (F.col("key") == F.col("o_key")) & (F.col("block") <= F.col("o_block"))).select(
        (F.col("block") == F.col("o_block")).alias("same"), "key", "rows", "o_rows"
    )
    met = single.withColumn("o_rows", F.col("o_rows").cast(met.schema["o_rows"].dataType)).union(met)

    def side(column: pa.Array, i: int):
        rows = column[i].values
        registers = np.frombuffer(b"".join(rows.field("registers").to_pylist()), np.uint16)
        smallest = [np.frombuffer(x, np.uint32) for x in rows.field("smallest").to_pylist()]
        return (
            rows.field("doc").to_numpy(zero_copy_only=False),
            rows.field("component").to_numpy(zero_copy_only=False),
            rows.field("n_shingles").to_numpy(zero_copy_only=False).astype(float),
            registers.reshape(-1, REGISTERS),
            smallest,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for row in range(batch.num_rows):
                same, key = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                doc_x, part_x, n_x, reg_x, low_x = side(batch.column(2), row)
                doc_y, part_y, n_y, reg_y, low_y = side(batch.column(2 if same else 3), row)
                at_x, at_y = np.nonzero(part_x[:, None] != part_y[None, :])
                if same:
                    at_x, at_y = at_x[at_x < at_y], at_y[at_x < at_y]
                for first in range(0, len(at_x), 4096):
                    ix, iy = at_x[first : first + 4096], at_y[first : first + 4096]
                    near = np.minimum(n_x[ix], n_y[iy]) >= least * np.maximum(n_x[ix], n_y[iy])
                    ix, iy = ix[near], iy[near]
                    equal = reg_x[ix] == reg_y[iy]
                    good = estimated(equal.mean(axis=1), np.sqrt(n_x[ix] * n_y[iy])) >= least
                    ix, iy, equal = ix[good], iy[good], equal[good]
                    common = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                    here = band_keys(reg_x[ix])[np.arange(len(ix)), common] == key
                    for at in np.flatnonzero(here):
                        i, j = ix[at], iy[at]
                        whole = max(n_x[i], n_y[j]) < SMALLEST
                        short_by = ROUNDING if whole else SMALLEST_MARGIN
                        here[at] = shared_share(low_x[i], low_y[j]) >= percent / 100 - short_by
                    found_a.append(np.minimum(doc_x[ix], doc_y[iy])[here])
                    found_b.append(np.maximum(doc_x[ix], doc_y[iy])[here])
            if found_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"]
                )

    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``size``-word
    shingles. A component has the smallest id in it, and that document is kept.
    """
    least = percent / 100 - MARGIN
    sketched = written(sketch_documents(docs, size), "sketches", TEXT_ROWS)
    classes = written(
        sketched.where("n_shingles > 0")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"))
        .select(F.col("set_a").alias("c_a"), F.col("set_b").alias("c_b"), F.col("n_shingles").alias("c_n"), "rep"),
        "classes",
    )
    reps = sketched.select("doc_id", "bands").join(
        small(classes.select("rep")), F.col("doc_id") == F.col("rep"), "left_semi"
    )
    bands = written(reps, "reps").select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key"))
    shared = written(bands.groupBy("key").count().where("count > 1").withColumnRenamed("key", "k"), "shared")
    members = written(bands.join(small(shared), F.col("key") == F.col("k")).select("doc", "key", "count"), "members")
    # Most documents share no band; the registers of the others are all that is compared from here on.
    sharing = written(members.select(F.col("doc").alias("m")).distinct(), "sharing")
    compared = written(
        sketched.select("doc_id", "n_shingles", "registers").join(
            small(sharing), F.col("doc_id") == F.col("m"), "left_semi"
        ),
        "compared",
    )
    popular = members.groupBy("doc").agg(F.sum("count").alias("shares"))
    ranked = members.join(popular.withColumnRenamed("doc", "p"), F.col("doc") == F.col("p"))
    hubs = ranked.groupBy("key").agg(F.max_by("doc", F.struct("shares", -F.col("doc"))).alias("hub"))
    hubs = written(hubs.withColumnRenamed("key", "k"), "hubs")
    stars = (
        members.join(hubs, F.col("key") == F.col("k"))
        .where("doc <> hub")
        .select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
        .distinct()
    )
    links = written(_verified(_plausible(stars, compared, least), docs, size, percent), "links")
    found = written(components(links), "found")
    placed = members.join(found, F.col("doc") == F.col("node"), "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component")
    )
    pairs = _mixed_pairs(written(placed, "placed"), compared, docs, size, percent)
    rest = written(_verified(pairs, docs, size, percent, BLOCKS_AT_ONCE), "rest")
    found = components(links.union(rest))
    named = written(
        classes.join(found, F.col("rep") == F.col("node"), "left").select(
            "c_a", "c_b", "c_n", F.coalesce("component", "rep").alias("component_id")
        ),
        "named",
    )
    whole = sketched.join(
        named,
        (F.col("set_a") == F.col("c_a")) & (F.col("set_b") == F.col("c_b")) & (F.col("n_shingles") == F.col("c_n")),
        "left",
    )
    component = F.coalesce("component_id", "doc_id")
    return whole.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
