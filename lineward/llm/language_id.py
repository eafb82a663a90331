"""Language of texts, and the spans of mixed texts.

For each learned language the trigrams of bytes within lower-case words are counted, hashed to buckets. A word's score for a language is the sum of its trigrams' log
probabilities. The scripts of a word's letters leave only languages that were learned with that script.
Viterbi's algorithm then labels the words of a text, where a change of language costs a penalty; runs of
equal labels are the spans. The text's language is the one with the most letters in its spans, and the
score is their share of all letters.

Counts are taken from all learnable documents: a table of languages times BUCKETS numbers. Words without a
letter take the language around them. Null texts and texts without a letter are `und` with score 0; so is
everything when nothing was learned. Ties go to the language that is first by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import TEXT_ROWS, held_out, written
from lineward.llm.words import Block, blocks, lower_table, mixed

FOLDS = 4
HELD_OUT = 2
BUCKETS = 1 << 15
FLOOR = 0.5
# Cost of a change of language, in natural log units.
SWITCH = 8.0
# A script counts as one of a language if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
# Text labelled together: more means fewer steps over the words of the longest.
VITERBI_BYTES = 2 << 20

# First and last code point of the scripts that are told apart; fixed values of the character standard.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
SCRIPTS = [*SCRIPT_RANGES, "other"]


def letters_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point up to 0xFFFF whether it is a letter, and its script."""
    is_letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])
    script = np.full(0x10000, len(SCRIPTS) - 1, np.uint8)
    for i, name in enumerate(SCRIPT_RANGES):
        for first, last in SCRIPT_RANGES[name]:
            script[first : last + 1] = i
    return is_letter, script


class Reader:
    """Trigram buckets and scripts of the words of a block."""

    def __init__(self):
        self.lower = lower_table().astype(np.uint64)
        self.is_letter, self.script = letters_table()

    def trigrams(self, block: Block) -> np.ndarray:
        """The bucket of the trigram that ends at each byte of a word; before its first byte are spaces."""
        data = self.lower[block.data]
        one = np.concatenate([[32], data[:-1]]).astype(np.uint64)
        two = np.concatenate([[32, 32], data[:-2]])[: len(data)].astype(np.uint64)
        one[block.start] = 32
        two[block.start] = 32
        second = block.start + 1
        two[second[second < len(two)]] = 32
        return (mixed((two * np.uint64(256) + one) * np.uint64(256) + data) % np.uint64(BUCKETS)).astype(np.int64)

    def letters(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each word and each script: an array of words times scripts; and of each word."""
        data = block.data.astype(np.int64)
        ahead = np.concatenate([data, [0, 0, 0]])
        code = np.full(len(data), -1, np.int64)
        one, two, three = data < 0x80, (data >= 0xC0) & (data < 0xE0), (data >= 0xE0) & (data < 0xF0)
        code[one] = data[one]
        at = np.flatnonzero(two)
        code[at] = (data[at] & 0x1F) << 6 | ahead[at + 1] & 0x3F
        at = np.flatnonzero(three)
        code[at] = (data[at] & 0x0F) << 12 | (ahead[at + 1] & 0x3F) << 6 | ahead[at + 2] & 0x3F
        at = np.flatnonzero(data >= 0xF0)
        wide = (data[at] & 0x07) << 18 | (ahead[at + 1] & 0x3F) << 12 | (ahead[at + 2] & 0x3F) << 6 | ahead[at + 3] & 0x3F
        letter = np.zeros(len(data), bool)
        known = code >= 0
        letter[known] = self.is_letter[code[known]]
        if len(at):
            letter[at] = [unicodedata.category(chr(min(c, 0x10FFFF)))[0] == "L" for c in wide]
        places = np.flatnonzero(letter)
        word = np.searchsorted(block.start, places, "right") - 1
        script = np.where(code[places] >= 0, self.script[np.maximum(code[places], 0)], len(SCRIPTS) - 1)
        n = len(block.start)
        table = np.bincount(word * len(SCRIPTS) + script, minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        return table, table.sum(axis=1)


class LanguageModel:
    """Log probabilities of trigrams and the scripts of each language."""

    def __init__(self, languages: list[str], trigrams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = trigrams.sum(axis=1, keepdims=True)
        self.logs = np.log((trigrams + FLOOR) / (total + FLOOR * BUCKETS)).astype(np.float32).T.copy()
        self.scripts = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def word_scores(self, reader: Reader, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word for each language, and the letters of each word."""
        trigrams = reader.trigrams(block)
        table, letters = reader.letters(block)
        out = np.zeros((len(block.start), len(self.languages)))
        for i in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.logs[:, i][trigrams], dtype=np.float64)])
            out[:, i] = sums[block.end] - sums[block.start]
        main = table.argmax(axis=1)
        candidate = self.scripts[:, main].T
        candidate[~candidate.any(axis=1)] = True
        out = np.where(candidate, out, out.min(axis=1, keepdims=True, initial=0) - 4 * SWITCH)
        out[letters == 0] = 0
        return out - out.max(axis=1, keepdims=True, initial=-np.inf), letters


def viterbi(scores: np.ndarray, doc: np.ndarray, rows: int, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word. All texts of a block go forward together, the longest first; texts
    that have ended leave at the end of the row."""
    words, n = scores.shape
    sizes = np.bincount(doc, minlength=rows)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    longest = int(sizes[0]) if rows else 0
    alive = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # texts of more than t words
    stay, source = np.zeros((words, n), bool), np.zeros(words, np.int64)
    label = np.zeros(words, np.int64)
    best = scores[first[: alive[0]]] if longest else scores[:0]
    last = np.zeros(rows, np.int64)
    for t in range(1, longest + 1):
        k = alive[t]
        last[k : len(best)] = best[k:].argmax(axis=1)
        best = best[:k]
        at = first[:k] + t
        top = best.argmax(axis=1)
        changed = (best[np.arange(k), top] - penalty)[:, None]
        keeps = best >= changed
        stay[at], source[at] = keeps, top
        best = np.where(keeps, best, changed) + scores[at]
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        now = label[at] = last[:k]
        if t:
            last[:k] = np.where(stay[at, now], now, source[at])
    return label


def spans(block: Block, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, label, first and last byte (exclusive, within the text) of each run of equal labels."""
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (block.doc[1:] != block.doc[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(label)]])[: len(begin)] - 1
    doc = block.doc[begin]
    return doc, label[begin], block.start[begin] - block.bounds[doc], block.end[end] - block.bounds[doc]


def learned(docs: DataFrame) -> LanguageModel | None:
    """Trigram and script counts of the documents that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                trigrams = reader.trigrams(block)
                table, _ = reader.letters(block)
                own = languages[block.first : block.first + block.rows]
                names = sorted(set(own))
                of_row = np.array([names.index(x) for x in own])
                steps = np.zeros(len(block.data) + 1, np.int64)
                np.add.at(steps, block.start, 1)
                np.subtract.at(steps, block.end, 1)
                inside = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                of_byte = of_row[np.searchsorted(block.bounds, inside, "right") - 1]
                found = np.bincount(of_byte * BUCKETS + trigrams[inside], minlength=len(names) * BUCKETS)
                for i, name in enumerate(names):
                    held = counts.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    held[:BUCKETS] += found[i * BUCKETS : (i + 1) * BUCKETS]
                    held[BUCKETS:] += table[of_row[block.doc] == i].sum(axis=0)
        for name, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "at", "n"]
            )

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(FOLDS, HELD_OUT))
    counted = rows.select("text", "lang").mapInArrow(run, "lang string, at long, n long")
    found = written(counted.groupBy("lang", "at").agg(F.sum("n").alias("n")), "trigrams", TEXT_ROWS)
    # At most BUCKETS and a few numbers for each language.
    found = found.toArrow()
    languages = sorted(set(found.column(0).to_pylist()))
    if not languages:
        return None
    table = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    place = {name: i for i, name in enumerate(languages)}
    at_language = np.array([place[x] for x in found.column(0).to_pylist()])
    table[at_language, found.column(1).to_numpy()] = found.column(2).to_numpy()
    return LanguageModel(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def identify_languages(docs: DataFrame, keep_spans: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, n_spans.

    With ``keep_spans`` also the spans: language, first and last byte in the UTF-8 text.
    """
    model = learned(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(), shared.value
        for batch in batches:
            for block in blocks(batch.column(2), VITERBI_BYTES):
                n = block.rows
                named, score = np.full(n, "und", object), np.zeros(n)
                doc = label = start = end = np.zeros(0, np.int64)
                if model is not None and len(block.start):
                    names = np.array(model.languages, object)
                    scores, letters = model.word_scores(reader, block)
                    labels = viterbi(scores, block.doc, n)
                    size = len(names)
                    by_label = np.bincount(block.doc * size + labels, letters, n * size).reshape(n, size)
                    total = by_label.sum(axis=1)
                    named = np.where(total > 0, names[by_label.argmax(axis=1)], "und")
                    score = np.where(total > 0, by_label.max(axis=1) / np.maximum(total, 1), 0.0)
                    doc, label, start, end = spans(block, labels)
                runs = np.bincount(doc, minlength=n)
                columns = [
                    batch.column(0).slice(block.first, n),
                    batch.column(1).slice(block.first, n),
                    pa.array(named.tolist(), pa.string()),
                    pa.array(score),
                    pa.array(runs.astype(np.int64)),
                ]
                if keep_spans:
                    languages = [model.languages[i] for i in label] if model else []
                    rows = pa.StructArray.from_arrays(
                        [pa.array(languages, pa.string()), pa.array(start), pa.array(end)], ["lang", "first", "last"]
                    )
                    bounds = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(bounds, rows))
                names = ["doc_id", "held_out", "lang_pred", "score", "n_spans", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, held_out boolean, lang_pred string, score double, n_spans long"
    if keep_spans:
        schema += ", spans array<struct<lang: string, first: long, last: long>>"
    rows = docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, schema)
