"""Quality rules: counts within a document, and lines that recur across the documents of a host.

Lines are compared by a hash of their words, A to Z in lower case and digits as 0. For each host and line
the distinct documents are counted. Copies and near copies of a document are no evidence of boilerplate and
count as one. Whether documents are near copies is decided by what they do not share: lines in more distinct
whole contents than the limit are candidates, and a document is known by its other lines, but for variants
of candidates. Where that leaves fewer than MIN_OWN_WORDS words, it is known by all of its lines. Documents
whose lines so taken are near duplicates, by a sketch of their smallest shingle hashes, are one. Candidates in more documents than the limit are removed;
a document that loses more than a share of its words with them is depleted and rejected.

Null and empty texts have no words and fail by their length. Documents without host share one host.
Rows are judged one by one, repeated ones too. A very long text is taken alone, in arrays of some 60 bytes for each
of its bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, scratch, small, written
from lineward.llm.minhash import near_duplicates
from lineward.llm.words import HASHED_BYTES, Block, Hasher, blocks, lower_table, repeated, same_text, sequence_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Nearness is judged by the shingles within lines, hashed to 32 bits.
SHINGLE = 3
# A line with this share of its shingles in candidate lines of its host is a variant of them.
VARIANT_PERCENT = 20
MIN_OWN_WORDS = 5
# Documents are near copies when their sets of shingles agree in this share.
NEAR_PERCENT = 60
# Smallest shingle hashes that a document is known by.
KNOWN_BY = 256
# Documents that a task remembers, to take repeated rows once.
SEEN_ROWS = 200_000
# A line that stands in more distinct documents of a host than this is boilerplate.
MAX_DOCUMENTS = 20
# A document that keeps less than this share of its words is depleted.
MIN_KEPT_PERCENT = 20


def line_table() -> np.ndarray:
    table = lower_table()
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


def line_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of every line of a block."""
    feeds = np.flatnonzero(block.data == 10)
    at = np.searchsorted(block.bounds, feeds, "right") - 1
    texts = np.arange(block.rows)
    doc = np.sort(np.concatenate([at, texts]))
    by_start = np.lexsort((np.concatenate([feeds + 1, block.bounds[:-1]]), np.concatenate([at, texts])))
    by_end = np.lexsort((np.concatenate([feeds, block.bounds[1:]]), np.concatenate([at, texts])))
    start = np.concatenate([feeds + 1, block.bounds[:-1]])[by_start]
    end = np.concatenate([feeds, block.bounds[1:]])[by_end]
    return doc, start, end


def counts(block: Block, exact: Hasher) -> dict[str, np.ndarray]:
    """The counts within each text."""
    rows = block.rows

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[block.bounds[1:]] - sums[block.bounds[:-1]]

    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    is_char = np.ones(256, bool)
    is_char[[9, 10, 11, 12, 13, 32, *range(128, 192)]] = False
    doc, start, end = line_bounds(block)
    with_word = np.searchsorted(block.start, end) > np.searchsorted(block.start, start)
    doc, start, end = doc[with_word], start[with_word], end[with_word]
    _, earlier = repeated(doc, exact.ranges(block.data, start, end))
    windows = sequence_hashes(exact.words(block), WINDOW)
    inside = np.flatnonzero(same_text(block.doc, WINDOW))
    twice, _ = repeated(block.doc[inside], windows[inside])
    steps = np.zeros(len(block.doc) + 1, np.int64)
    np.add.at(steps, inside[twice], 1)
    np.add.at(steps, inside[twice] + WINDOW, -1)
    covered = np.cumsum(steps)[:-1] > 0
    return {
        "n_words": block.words,
        "word_chars": per_text(is_char[block.data]),
        "n_symbols": per_text(is_symbol[block.data]),
        "n_dup_lines": np.bincount(doc[earlier], minlength=rows),
        "n_repeat_words": np.bincount(block.doc[covered], minlength=rows),
    }


def lines(block: Block, folded: Hasher) -> tuple[np.ndarray, ...]:
    """Text, hash, first word and word behind the last one of every line with a word."""
    words = folded.words(block)
    doc, start, end = line_bounds(block)
    first, last = np.searchsorted(block.start, start), np.searchsorted(block.start, end)
    some = last > first
    doc, first, last = doc[some], first[some], last[some]
    return doc, folded.runs(words, first, last), first, last


def line_shingles(words: np.ndarray, first: np.ndarray, last: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """The bounds and the distinct values of each line's shingles, and how often the line has each.

    A line shorter than a shingle has its own hash.
    """
    line = np.repeat(np.arange(len(first)), last - first)  # every word stands in one line
    runs = sequence_hashes(words, SHINGLE)
    inside = same_text(line, SHINGLE)
    few = np.flatnonzero(last - first < SHINGLE)
    of = np.concatenate([line[: len(runs)][inside], few]).astype(np.uint64)
    value = np.concatenate([runs[inside], hasher.runs(words, first[few], last[few])])
    placed, times = np.unique((of << np.uint64(32)) | (value >> np.uint64(32)), return_counts=True)
    bounds = np.searchsorted(placed >> np.uint64(32), np.arange(len(first) + 1, dtype=np.uint64))
    return bounds, placed.astype(np.uint32), times.astype(np.int32)


def contents(block: Block, words: np.ndarray, hasher: Hasher) -> np.ndarray:
    """The hash of all words of each text."""
    ends = np.cumsum(block.words)
    return hasher.runs(words, ends - block.words, ends)


def _hosted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")


def measured(docs: DataFrame) -> DataFrame:
    """Per row its number, id, host, counts, content hash, and its lines with the number of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, folded, plain = Hasher(np.arange(256, dtype=np.uint8)), Hasher(line_table()), Hasher()
        for batch in batches:
            for block in blocks(batch.column(2), HASHED_BYTES):
                found = counts(block, exact)
                doc, value, first, last = lines(block, folded)
                content = contents(block, plain.words(block), plain)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.rows))])
                pairs = pa.StructArray.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array((last - first).astype(np.int64))], ["line", "words"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        batch.column(1).slice(block.first, block.rows),
                        *(pa.array(v.astype(np.int64)) for v in found.values()),
                        pa.array(content.view(np.int64)),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pairs),
                    ],
                    ["doc_id", "host", *found, "content", "lines"],
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"doc_id {doc_id}, host string, {', '.join(n + ' long' for n in names)}, content long"
    found = _hosted(docs).mapInArrow(run, f"{schema}, lines array<struct<line: long, words: long>>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "measured", TEXT_ROWS)


def shingled(docs: DataFrame) -> DataFrame:
    """Per document (repeated rows of a task once) its id, host, content hash, and its lines with their words
    and distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, plain = Hasher(line_table()), Hasher()
        seen: set[tuple] = set()
        for batch in batches:
            for block in blocks(batch.column(2), HASHED_BYTES):
                doc, value, first, last = lines(block, folded)
                words = plain.words(block)
                near_bounds, near, times = line_shingles(words, first, last, plain)
                near_bounds = near_bounds.astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.rows))])
                ids = batch.column(0).slice(block.first, block.rows)
                hosts = batch.column(1).slice(block.first, block.rows)
                content = contents(block, words, plain).view(np.int64)
                rows = []
                for i, row in enumerate(zip(ids.to_pylist(), hosts.to_pylist(), content.tolist())):
                    if row not in seen:
                        rows.append(i)
                        seen.add(row)
                if len(seen) > SEEN_ROWS:
                    seen.clear()
                found = pa.RecordBatch.from_arrays(
                    [
                        ids,
                        hosts,
                        pa.array(content),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array((last - first).astype(np.int32))),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(value.view(np.int64))),
                        *(
                            pa.ListArray.from_arrays(
                                bounds.astype(np.int32), pa.ListArray.from_arrays(near_bounds, of_each)
                            )
                            for of_each in (near.view(np.int32), times)
                        ),
                    ],
                    ["doc_id", "host", "content", "words", "line", "near", "times"],
                )
                yield found.take(pa.array(rows, pa.int64()))

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return _hosted(docs).mapInArrow(
        run,
        f"doc_id {doc_id}, host string, content long, words array<int>, line array<long>, near array<array<int>>,"
        " times array<array<int>>",
    )


def _above(spread: DataFrame, identity: str, max_documents: int, name: str) -> DataFrame:
    """Host and hash of the lines that ``spread`` has with more than ``max_documents`` identities."""
    frequent = spread.select("host", "line", identity).distinct().groupBy("host", "line").count()
    frequent = frequent.where(F.col("count") > max_documents)
    named = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "count")
    return written(named, name)


def _often(occurring: DataFrame, max_documents: int) -> DataFrame:
    """The rows of ``occurring`` with lines that occur more often than ``max_documents`` on their host.

    Most lines occur once. They are counted by a hash of 40 bits, in rows as short as can be; lines that share
    one go on together, so none that recurs is lost.
    """
    tag = F.shiftrightunsigned(F.xxhash64("host", "line"), 24)
    recurring = occurring.groupBy(tag.alias("tag")).count().where(F.col("count") > max_documents).select("tag")
    return occurring.join(small(written(recurring, "recurring")), tag == F.col("tag"), "left_semi")


def known_by(docs: DataFrame, holding: DataFrame, candidates: DataFrame) -> DataFrame:
    """Row and sketch (as a text of hashes) of the lines that each document of ``holding`` is known by.

    The shingles stay where they are written; what is shuffled has a row for each line at most. A value that a
    line repeats is looked up once and counted as often as it stands there.
    """
    is_candidate = (F.col("host") == F.col("f_host")) & (F.col("line") == F.col("f_line"))
    same = (
        (F.col("host") == F.col("h_host"))
        & (F.col("content") == F.col("h_content"))
        & F.col("doc_id").eqNullSafe(F.col("h_id"))
    )
    read = shingled(docs).join(small(holding), same).select("row", "host", "words", "line", "near", "times")
    read = written(read, "held-lines", TEXT_ROWS, compression="zstd")

    def each(*columns: str) -> DataFrame:
        at = F.posexplode(F.arrays_zip("line", *columns)).alias("place", "at")
        placed = read.select("row", "host", at).select("row", "host", "place", "at.*")
        return placed.join(small(candidates), is_candidate, "left").withColumn(
            "is_candidate", F.col("f_line").isNotNull()
        )

    near = each("words", "near", "times")
    common = near.where("is_candidate").select(F.col("host").alias("c_host"), F.explode("near").alias("c_value"))
    common = written(common.distinct(), "common-values")
    is_common = (F.col("host") == F.col("c_host")) & (F.col("value") == F.col("c_value"))
    n_values = F.greatest(F.col("words") - F.lit(SHINGLE - 1), F.lit(1))
    variants = (
        near.where("not is_candidate")
        .select("row", "host", "place", n_values.alias("values"), F.explode(F.arrays_zip("near", "times")).alias("at"))
        .select("row", "host", "place", "values", F.col("at.near").alias("value"), "at.times")
        .join(small(common), is_common)  # lines that share nothing are no variants
        .groupBy(F.col("row").alias("v_row"), F.col("place").alias("v_place"), "values")
        .agg((F.lit(100) * F.sum("times") >= F.lit(VARIANT_PERCENT) * F.col("values")).alias("is_variant"))
        .where("is_variant")
    )
    variants = written(variants.drop("values"), "variants")
    is_own = ~F.col("is_candidate") & F.col("is_variant").isNull()
    own = (
        each("words")
        .join(small(variants), (F.col("row") == F.col("v_row")) & (F.col("place") == F.col("v_place")), "left")
        .groupBy(F.col("row").alias("o_row"))
        .agg(
            F.sum(F.when(is_own, F.col("words")).otherwise(0)).alias("own_words"),
            F.collect_list(F.when(is_own, F.col("place"))).alias("places"),
        )
    )
    own = written(own, "own-lines")
    kept = F.transform("places", lambda p: F.get("near", p))
    values = F.flatten(F.when(F.col("own_words") >= MIN_OWN_WORDS, kept).otherwise(F.col("near")))
    least = F.slice(F.array_sort(F.array_distinct(values)), F.lit(1), F.lit(KNOWN_BY))
    words = F.array_join(F.transform(least, lambda v: F.hex(v.cast("long") + F.lit(1 << 31))), " ")
    return read.join(small(own), F.col("row") == F.col("o_row")).select(F.col("row").alias("doc_id"), words.alias("text"))


def identities(docs: DataFrame, held: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each host and content of ``held`` (n_row, doc_id, host, content, line: the candidates in it) the
    number its near copies are known by.

    One document stands for all of the same host and content; its text is read again for the shingles.
    """
    each = held.groupBy(F.col("host").alias("h_host"), F.col("content").alias("h_content"))
    holding = written(each.agg(F.min("doc_id").alias("h_id"), F.min("n_row").alias("row")), "holding")
    with scratch(docs.sparkSession):
        known = written(known_by(docs, holding, candidates), "known-by", kept=True, compression="zstd")
    found = near_duplicates(known, 1, NEAR_PERCENT)
    named = holding.join(found, F.col("row") == F.col("doc_id")).select(
        F.col("h_host").alias("i_host"), F.col("h_content").alias("i_content"), F.col("component_id").alias("identity")
    )
    return written(named.distinct(), "identities", kept=True)


def frequent_lines(docs: DataFrame, rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Host and hash of the lines in more distinct documents of a host than ``max_documents``."""
    line = F.explode("lines.line").alias("line")
    occurring = rows.select(F.col("row").alias("n_row"), "doc_id", "host", "content", line)
    candidates = _above(_often(occurring, max_documents), "content", max_documents, "candidates")
    if candidates.isEmpty():
        return candidates
    is_candidate = (F.col("host") == F.col("f_host")) & (F.col("line") == F.col("f_line"))
    held = occurring.join(candidates, is_candidate, "left_semi")
    with scratch(docs.sparkSession):
        known = identities(docs, held, candidates)
    is_known = (F.col("host") == F.col("i_host")) & (F.col("content") == F.col("i_content"))
    lines_of_known = held.select("host", "content", "line").distinct().join(known, is_known)
    return _above(lines_of_known, "identity", max_documents, "frequent")


def quality_rules(
    docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_kept_percent: int = MIN_KEPT_PERCENT
) -> DataFrame:
    """Per row of ``docs``: its counts, base_failed, removed_words, depleted and kept."""
    rows = measured(docs)
    occurring = rows.select("row", "host", F.explode("lines").alias("at")).select("row", "host", "at.*")
    removed = (
        occurring.join(
            frequent_lines(docs, rows, max_documents),
            (F.col("host") == F.col("f_host")) & (F.col("line") == F.col("f_line")),
        )
        .groupBy(F.col("row").alias("r_row"))
        .agg(F.sum("words").alias("removed_words"))
    )
    judged = rows.drop("lines", "content", "host").join(removed, F.col("row") == F.col("r_row"), "left")
    removed_words = F.coalesce("removed_words", F.lit(0).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )
    depleted = F.lit(100) * (F.col("n_words") - removed_words) < F.lit(min_kept_percent) * F.col("n_words")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        removed_words.alias("removed_words"),
        depleted.alias("depleted"),
        (~base_failed & ~depleted).alias("kept"),
    )
