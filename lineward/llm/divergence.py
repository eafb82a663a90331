"""How the word use of each source differs from the other sources of its language, and by which terms.

Every task folds the documents it reads into stripes, one hash entry for each term of a language with the
number of documents it is in and its count at each source. A task that holds SPILL_BYTES writes its
stripes out and begins anew. Stripes of a term are merged by a shuffle on (language, term) and kept if the
term is in enough documents. The kept stripes of a block of terms then give their share of every
divergence, all in whole numbers: terms of a block are summed in the task, so no row is made for a pair of
sources and a term.

Null texts, languages and sources count as empty strings, which are values like others. A document without
terms, or a language without kept terms, still gives its groups and pairs (value 0). Repeated rows, also of
the same id, are documents of their own. Equal values are ranked by the term's or source's UTF-8 bytes. An
empty table gives an empty result. A long text is read a piece at a time; a task holds the distinct terms
of one document, and one row of numbers for the sources of one language. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineward.llm.common import written

# Bytes that a task's stripes take before they are written out, by a rough measure of Python objects.
SPILL_BYTES = 96 << 20
STRIPE_BYTES, ENTRY_BYTES = 400, 120
# Stripes in one Arrow batch, bytes of a text that are split at once, terms in a block.
BATCH_STRIPES = 5_000
PIECE_BYTES = 1 << 20
BLOCK_TERMS = 1024
# Counts that a block turns into numbers at once (terms x sources).
DENSE_CELLS = 1 << 21

STRIPES = "lang binary, term binary, docs long, sources array<binary>, counts array<long>"
PARTIAL = "lang string, source string, part string, item string, value long"


def _separators() -> bytes:
    """A to Z in lower case; every other ASCII character but letters becomes a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for i in range(26):
        table[65 + i] = table[97 + i] = 97 + i
    return bytes(table)


def terms_of(text: bytes) -> Counter:
    """How often each term is in a text."""
    found: Counter = Counter()
    table, at = _separators(), 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(table)
        cut = piece.rfind(b" ") + 1
        while not cut and end < len(text):  # within a very long term
            more = text[end : end + PIECE_BYTES].translate(table)
            end += PIECE_BYTES
            cut = len(piece) + more.rfind(b" ") + 1 if b" " in more else 0
            piece += more
        cut = cut if end < len(text) else len(piece)
        found.update(piece[:cut].split())
        at += cut
    return found


def _spilled(stripes: dict[bytes, dict[bytes | None, list]]) -> Iterator[pa.RecordBatch]:
    for lang, by_term in stripes.items():
        terms = list(by_term)
        for at in range(0, len(terms), BATCH_STRIPES):
            some = terms[at : at + BATCH_STRIPES]
            held = [by_term[t] for t in some]
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * len(some), pa.binary()),
                    "term": pa.array(some, pa.binary()),
                    "docs": pa.array([h[0] for h in held], pa.int64()),
                    "sources": pa.array([list(h[1]) for h in held], pa.list_(pa.binary())),
                    "counts": pa.array([list(h[1].values()) for h in held], pa.list_(pa.int64())),
                }
            )


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of whole documents (lang, source, text); the stripe of the null term names the sources."""
    stripes: dict[bytes, dict[bytes | None, list]] = {}
    held = 0
    for batch in batches:
        columns = [batch.column(i).cast(pa.binary()) for i in range(3)]
        for lang, source, text in zip(*columns):
            lang, source = lang.as_py(), source.as_py()
            of_lang = stripes.setdefault(lang, {})
            of_lang.setdefault(None, [0, {}])[1][source] = 0
            for term, count in terms_of(text.as_py()).items():
                stripe = of_lang.get(term)
                if stripe is None:
                    of_lang[term] = [1, {source: count}]
                    held += STRIPE_BYTES + ENTRY_BYTES + len(term)
                    continue
                stripe[0] += 1
                counts = stripe[1]
                if source in counts:
                    counts[source] += count
                else:
                    counts[source] = count
                    held += ENTRY_BYTES
            if held > SPILL_BYTES:
                yield from _spilled(stripes)
                stripes, held = {}, 0
    yield from _spilled(stripes)


def merged_stripes(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, sources, counts)``: a stripe for each kept term, and one for the null term."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folded = read.mapInArrow(fold, STRIPES).repartition("lang", "term")
    entry = F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "entry")
    by_source = (
        folded.select("lang", "term", "docs", entry)
        .groupBy("lang", "term", F.col("entry.sources").alias("source"))
        .agg(
            F.sum("entry.counts").alias("count"),
            F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs"),
        )
    )
    stripe = F.collect_list(F.struct("source", "count")).alias("stripe")
    merged = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), stripe)
    kept = merged.where(F.col("term").isNull() | (F.col("docs") >= min_docs))
    return written(
        kept.select(
            F.col("lang").cast("string").alias("lang"),
            F.col("term").cast("string").alias("term"),
            F.col("stripe.source").cast("array<string>").alias("sources"),
            F.col("stripe.count").alias("counts"),
        ),
        "stripes",
    )


def language_totals(stripes: DataFrame) -> DataFrame:
    """``(lang, kept_terms, sources, counts)``: all sources of a language and the kept terms they hold."""
    kept = stripes.where("term is not null")
    groups = stripes.where("term is null").select("lang", F.explode("sources").alias("source"))
    entries = kept.select("lang", F.inline(F.arrays_zip("sources", "counts")))
    sums = entries.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("count"))
    each = groups.join(sums, ["lang", "source"], "left").fillna(0, ["count"])
    totals = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "count"))).alias("all"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept_terms"))
    return totals.join(vocabulary, "lang", "left").select(
        "lang",
        F.coalesce("kept_terms", F.lit(0)).cast("long").alias("kept_terms"),
        F.col("all.source").alias("sources"),
        F.col("all.count").alias("counts"),
    )


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total), exactly; counts are at most total, and total below 9 * 10^15."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Language:
    """The sources of a language, and what a block of its terms adds to their divergences."""

    def __init__(self, lang: str, kept_terms: int, sources: list[str], counts: list[int], top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.place = {s: i for i, s in enumerate(sources)}
        smooth = 2 * kept_terms
        self.totals = np.array(counts, np.int64) + smooth
        self.total = np.array([sum(counts) + smooth], np.int64)
        self.most_terms = max(1, DENSE_CELLS // len(sources))
        self.rows: list[tuple[str, list[str], list[int]]] = []

    def batch(self, part: str, source: list[str], item: list[str], value: np.ndarray) -> pa.RecordBatch:
        columns = {"lang": [self.lang] * len(source), "source": source, "part": [part] * len(source), "item": item}
        arrays = {k: pa.array(v, pa.string()) for k, v in columns.items()}
        return pa.record_batch(arrays | {"value": pa.array(value, pa.int64())})

    def pairs(self, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The summed divergence of every two sources, the smaller name first."""
        for i in range(len(self.sources) - 1):
            others = self.sources[i + 1 :]
            value = apart(p[:, i + 1 :], p[:, i : i + 1]).sum(axis=0)
            yield self.batch("pair", [self.sources[i]] * len(others), others, value)

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = sorted(self.rows)
        counts = np.zeros((len(rows), len(self.sources)), np.int64)
        for i, (_, sources, found) in enumerate(rows):
            counts[i, [self.place[s] for s in sources]] = found
        self.rows = []
        if not rows:
            return
        p = shares(counts + 2, self.totals)
        yield from self.pairs(p)
        q = shares(counts.sum(axis=1, keepdims=True) + 2, self.total)
        more = np.where((counts > 0) & (p > q), apart(p, q), -1)
        for i, source in enumerate(self.sources):
            best = np.argsort(-more[:, i], kind="stable")[: self.top]  # rows are in the order of terms
            best = best[more[best, i] >= 0]
            yield self.batch("term", [source] * len(best), [rows[b][0] for b in best], more[best, i])


def diverge(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of blocks, each a row of totals and then its stripes: partial sums of pairs, leading terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Language | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kept_terms"] is not None:
                    if now:
                        yield from now.flush()
                    now = Language(row["lang"], row["kept_terms"], row["sources"], row["counts"], top)
                    # Also without terms, every two sources get a value.
                    yield from now.pairs(np.zeros((0, len(now.sources)), np.int64))
                    continue
                now.rows.append((row["term"], row["sources"], row["counts"]))
                if len(now.rows) >= now.most_terms:
                    yield from now.flush()
        if now:
            yield from now.flush()

    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language (part
    pair), and the ``top`` terms it uses more than its language does (part term)."""
    stripes = merged_stripes(docs, min_docs)
    totals = language_totals(stripes)
    kept = stripes.where("term is not null")
    blocks = kept.count() // BLOCK_TERMS + 1
    bucket = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None).cast("long").alias("kept_terms")
    placed = kept.select("lang", bucket, none, "term", "sources", "counts")
    first = totals.select("lang", F.lit(0).alias("block"))
    used = placed.select("lang", "block").union(first).distinct()
    heads = used.join(totals, "lang").select(
        "lang", "block", "kept_terms", F.lit(None).cast("string").alias("term"), "sources", "counts"
    )
    ordered = placed.union(heads).repartition("lang", "block")
    ordered = ordered.sortWithinPartitions("lang", "block", F.col("kept_terms").desc_nulls_last())
    summed = (
        ordered.mapInArrow(diverge(top), PARTIAL)
        .groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
    )
    one = F.struct("source", "item")
    other = F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    sides = F.when(F.col("part") == "pair", F.array(one, other)).otherwise(F.array(one))
    each = summed.select("lang", "part", "value", F.inline(sides))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = each.withColumn("rank", F.row_number().over(by))
    ranked = ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


ORACLE = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{80}-\\x{10FFFF}]+') AS terms
  FROM documents),
w AS (SELECT lang, source, row_no, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
p AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS p
  FROM dense JOIN gn USING (lang, source) JOIN v USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM lt GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS q
  FROM lt JOIN ln USING (lang) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q)
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
