"""The result store: hits of earlier scans, keyed by what was scanned and how.

A store is a table ``(kind, fp, scanned_at, hits, note, file_type)``. A fingerprint covers content and
configuration, so a changed keyword list finds nothing, and a copy under another name finds the
original's hits. On disk it has a folder for each kind, bucketed by fingerprint: looking fingerprints up
shuffles what is looked up, never the store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.config import RESULT_TTL_SECONDS, ScanConfig
from lineward.functions.fingerprint import fingerprint
from lineward.functions.match import HITS_TYPE, hits
from lineward.session import stored

STORE_SCHEMA = T.StructType(
    [
        T.StructField("fp", T.StringType()),
        T.StructField("scanned_at", T.TimestampType()),
        T.StructField("hits", HITS_TYPE),
        T.StructField("note", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
_RESULT = ("hits", "note", "file_type")
_KNOWN = ("known_hits", "known_note", "known_type")
# Buckets of a store on disk. Every session that opens a store has to name the same number.
STORE_BUCKETS = 16
# Stored results up to this size, as measured, are sent to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
# Beyond that a filter over the fingerprints is, up to so many of them (some 6 bytes each).
FILTER_ENTRIES = 8_000_000
# Tags in one block of the filter.
BLOCK_TAGS = 64


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE_SCHEMA)


def _moment(at: datetime) -> Column:
    """A time without zone is meant in the time zone of the session, as in SQL."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def with_fingerprint(
    df: DataFrame, content: str, config: ScanConfig, extractor: str = ""
) -> DataFrame:
    return df.withColumn("fp", fingerprint(F.col(content), config, extractor))


def store_entries(results: DataFrame, kind: str, scanned_at: datetime) -> DataFrame:
    """Store rows for scanned targets that carry ``fp`` and ``hits``; one row per fingerprint."""
    have = set(results.columns)
    entries = results.select(
        "fp",
        _moment(scanned_at).alias("scanned_at"),
        "hits",
        (F.col("note") if "note" in have else F.lit("")).alias("note"),
        (F.col("file_type") if "file_type" in have else F.lit("")).alias("file_type"),
        F.lit(kind).alias("kind"),
    )
    return entries.dropDuplicates(["fp"])


def _opened(spark: SparkSession, path: str, buckets: int) -> str:
    """The name under which this session knows the store at ``path``."""
    name = f"result_store_{md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (kind) "
        f"CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{path}' "
        "OPTIONS (partitionOverwriteMode 'dynamic')"
    )
    return name


def _current(spark: SparkSession, path: str, buckets: int) -> str:
    """The same, with the kinds and files that other sessions have added."""
    name = _opened(spark, path, buckets)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        spark.catalog.refreshTable(name)
    return name


def write_store(entries: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> None:
    """Append entries. A task writes one bucket, so each append adds a file per bucket and kind."""
    name = _opened(entries.sparkSession, path, buckets)
    placed = entries.select(*STORE_SCHEMA.names).repartition(buckets, "fp")
    placed.write.insertInto(name)


def read_store(spark: SparkSession, path: str, buckets: int = STORE_BUCKETS) -> DataFrame:
    return spark.table(_current(spark, path, buckets))


def ttl_seconds(kind: Column) -> Column:
    """Lifetime of a result by kind of source; null for an unknown kind."""
    return F.coalesce(
        *[
            F.when(kind == k, F.lit(seconds).cast("bigint"))
            for k, seconds in RESULT_TTL_SECONDS.items()
        ]
    )


def live_entries(store: DataFrame, as_of: datetime) -> DataFrame:
    """Entries still valid at ``as_of``; an entry lapses at the very end of its lifetime."""
    moment = _moment(as_of)
    expires = F.unix_micros("scanned_at") + ttl_seconds(F.col("kind")) * F.lit(1_000_000)
    return store.where(expires > F.unix_micros(moment))


def latest_entries(store: DataFrame) -> DataFrame:
    """One entry per kind and fingerprint: the one scanned last."""
    rest = [c for c in store.columns if c not in ("kind", "fp")]
    newest = F.max_by(F.struct(*rest), "scanned_at").alias("entry")
    return store.groupBy("kind", "fp").agg(newest).select("kind", "fp", "entry.*")


def known_results(store: DataFrame, kind: str, as_of: datetime | None = None) -> DataFrame:
    """What the store knows about one kind: ``(fp, known_hits, known_note, known_type)``, each
    fingerprint once.

    The filter on ``kind`` selects one partition folder of the store, and its buckets are kept: no step
    from here to a join by ``fp`` shuffles the store.
    """
    entries = store.where(F.col("kind") == kind)
    if as_of is not None:
        entries = live_entries(entries, as_of)
    return latest_entries(entries).select(
        "fp",
        *(F.col(r).alias(k) for r, k in zip(_RESULT, _KNOWN)),
    )


def measured(table: DataFrame) -> tuple[int, int]:
    """Rows of a table, and their bytes as JSON."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)
    found = table.agg(F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return found["rows"], found["bytes"]


def flagged(
    rows: DataFrame, known: DataFrame, by: Sequence[str], name: str, entries: int
) -> DataFrame:
    """Add ``name``: false where the columns ``by`` of a row are certainly not those of a row of ``known``.

    The filter holds a 32-bit tag for every row of ``known``, in blocks that a hash selects. ``entries``, the
    number of these rows, bounds its size; beyond FILTER_ENTRIES there is none, and every row with a value is
    flagged. About one row in 2^32 / BLOCK_TAGS that isn't in ``known`` is flagged by chance.
    """
    if entries > FILTER_ENTRIES:
        return rows.withColumn(name, F.col(by[-1]).isNotNull())
    block = F.pmod(F.xxhash64(*by), F.lit(entries // BLOCK_TAGS + 1))
    tags = F.collect_set(F.hash(*by)).alias("_tags")
    blocks = known.select(*by).groupBy(block.alias("_block")).agg(tags)
    joined = rows.withColumn("_block", block).join(F.broadcast(blocks), "_block", "left")
    found = F.coalesce(F.array_contains("_tags", F.hash(*by)), F.lit(False))
    return joined.withColumn(name, found).drop("_block", "_tags")


def looked_up(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``(fp, known_hits, known_note, known_type, is_known)`` for the distinct ``fp`` of candidates, written.

    Only distinct fingerprints meet the store, so a content with very many copies is one row there.
    Being written, the result joins back by plain shuffles, which adaptive execution can split.
    """
    there = known.withColumn("is_known", F.lit(True))
    found = candidates.select("fp").distinct().join(there, "fp", "left")
    return stored(found.withColumn("is_known", F.coalesce("is_known", F.lit(False))), "looked-up")


def reuse_results(rows: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """Stored hits under the current names: ``(keys..., fp, hits)`` of the rows already known."""
    entries, size = measured(known)
    if size <= BROADCAST_BYTES:
        found = rows.select(*keys, "fp").join(F.broadcast(known), "fp")
    else:
        candidates = flagged(rows.select(*keys, "fp"), known, ["fp"], "_maybe", entries).where("_maybe")
        candidates = stored(candidates.drop("_maybe"), "candidates")
        found = candidates.join(looked_up(candidates, known).where("is_known"), "fp")
    return found.select(*keys, "fp", F.col("known_hits").alias("hits"))


def pending(rows: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """``(keys..., fp)`` of the rows that the store knows nothing about."""
    fps = known.select("fp")
    entries, size = measured(fps)
    if size <= BROADCAST_BYTES:
        return rows.select(*keys, "fp").join(F.broadcast(fps), "fp", "left_anti").select(*keys, "fp")
    marked = stored(flagged(rows.select(*keys, "fp"), known, ["fp"], "_maybe", entries), "marked")
    candidates = marked.where("_maybe").drop("_maybe")
    missed = looked_up(candidates, known).where("not is_known").select("fp")
    new = marked.where("not _maybe").drop("_maybe")
    return new.unionByName(candidates.join(missed, "fp", "left_semi"))


# A scan turns rows with their content into ``(kept columns..., hits, note, file_type)``, row by row.
Scan = Callable[[DataFrame, Sequence[str]], DataFrame]


def _scan_unless(
    rows: DataFrame, content: str, skip: Column, scan: Scan, keep: Sequence[str]
) -> DataFrame:
    """``(keep..., _skip, hits, note, file_type)``: rows are scanned where they are read, unless skipped."""
    emptied = rows.withColumn("_skip", skip)
    emptied = emptied.withColumn(content, F.when(~F.col("_skip"), F.col(content)))
    return scan(emptied, [*keep, "_skip"]).select(*keep, "_skip", *_RESULT)


def _completed(
    rows: DataFrame, keys: Sequence[str], marked: DataFrame, known: DataFrame, scan: Scan
) -> DataFrame:
    """Skipped rows take the result ``known`` has for their fingerprint; those it hasn't are read again."""
    columns = [*keys, "fp", *_RESULT]
    skipped = marked.where("_skip").select(*keys, "fp")
    found = looked_up(skipped, known)
    old = skipped.join(found.where("is_known"), "fp").select(
        *keys,
        "fp",
        *(F.col(k).alias(r) for r, k in zip(_RESULT, _KNOWN)),
        F.lit(True).alias("reused"),
    )
    missed = found.where("not is_known").select("fp")
    again = scan(rows.join(missed, "fp", "left_semi"), [*keys, "fp"]).select(*columns)
    new = marked.where("not _skip").select(*columns).unionByName(again)
    return new.withColumn("reused", F.lit(False)).unionByName(old)


def scan_with_store(
    rows: DataFrame, keys: Sequence[str], content: str, known: DataFrame, scan: Scan
) -> DataFrame:
    """``(keys..., fp, hits, note, file_type, reused)``: known contents take their stored results, the rest
    is scanned.

    ``rows`` have an ``fp``. They are read once. Where all stored results, by their measured size, can be sent to every
    task, that is all. Otherwise contents that a filter rules out are scanned where they are
    read, and of the others only keys and fingerprints go on, to the store. The few contents that pass
    the filter by chance (all new ones, where the store is too large for a filter) are read again.
    """
    entries, size = measured(known)
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known), "fp", "left")
        keep = [*keys, "fp", *_KNOWN]
        scanned = _scan_unless(joined, content, F.col("known_hits").isNotNull(), scan, keep)
        merged = [
            F.when(F.col("_skip"), F.col(k)).otherwise(F.col(r)).alias(r) for r, k in zip(_RESULT, _KNOWN)
        ]
        return scanned.select(*keys, "fp", *merged, F.col("_skip").alias("reused"))
    maybe = flagged(rows, known, ["fp"], "_maybe", entries)
    marked = stored(_scan_unless(maybe, content, F.col("_maybe"), scan, [*keys, "fp"]), "marked")
    return _completed(rows, keys, marked, known, scan)


def text_scan(text: str, config: ScanConfig) -> Scan:
    """The scan of a text column."""
    none = F.lit("")
    return lambda df, keep: df.select(
        *keep, hits(F.col(text), config).alias("hits"), none.alias("note"), none.alias("file_type")
    )


def scan_incremental(
    rows: DataFrame, keys: Sequence[str], text: str, known: DataFrame, config: ScanConfig
) -> DataFrame:
    """``(keys..., fp, hits, reused)`` of texts, see ``scan_with_store``."""
    columns = rows.select(*keys, "fp", text)
    found = scan_with_store(columns, keys, text, known, text_scan(text, config))
    return found.drop("note", "file_type")


def scan_unique(df: DataFrame, keys: Sequence[str], text: str, config: ScanConfig) -> DataFrame:
    """``(keys..., fp, hits)`` where each distinct content is scanned once, at its first row by ``keys``.

    Fingerprints are counted first. Then rows that are neither unique nor the first of their
    content are passed over, which filters tell in place, and take the hits of the first one. Texts are read twice
    and never shuffled.
    """
    rows = with_fingerprint(df, text, config).select(*keys, "fp", text)
    first = F.min(F.struct(*keys)).alias("first")
    counted = rows.groupBy("fp").agg(F.count("*").alias("n"), first).where("n > 1 and fp is not null")
    copied = stored(counted.select("fp", "first.*"), "copied")
    entries = copied.count()
    told = flagged(rows, copied, ["fp"], "_copied", entries)
    told = flagged(told, copied, [*keys, "fp"], "_first", entries)
    scan = text_scan(text, config)
    skip = F.col("_copied") & ~F.col("_first")
    marked = stored(_scan_unless(told, text, skip, scan, [*keys, "fp"]), "marked")
    of_first = marked.where("not _skip").join(copied.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    known = of_first.select("fp", *(F.col(r).alias(k) for r, k in zip(_RESULT, _KNOWN)))
    return _completed(rows, keys, marked, known, scan).select(*keys, "fp", "hits")


def store_stats(store: DataFrame) -> DataFrame:
    """Number of entries and their volume in megabytes."""
    volume = F.sum(F.octet_length(F.to_json(F.struct("hits", "note", "file_type"))))
    return store.agg(
        F.count("*").alias("total_entries"),
        F.round(F.coalesce(volume, F.lit(0)) / (1024 * 1024), 2).alias("size_mb"),
    )


def without_kind(store: DataFrame, kind: str | None = None) -> DataFrame:
    """What is left after clearing one kind, or everything."""
    return store.where(F.lit(False) if kind is None else F.col("kind") != kind)


def clear_store(spark: SparkSession, path: str, kind: str | None = None, buckets: int = STORE_BUCKETS) -> None:
    """Empty a written store, or the folder of one kind, in place."""
    name = _current(spark, path, buckets)
    kinds = [kind] if kind else [r["kind"] for r in spark.table(name).select("kind").distinct().collect()]
    columns = ", ".join(f for f in STORE_SCHEMA.names if f != "kind")
    empty_store(spark).createOrReplaceTempView("no_results")
    for one in kinds:  # a static partition is replaced even by nothing
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (kind = '{one}') SELECT {columns} FROM no_results")


def prune_store(spark: SparkSession, path: str, as_of: datetime, buckets: int = STORE_BUCKETS) -> None:
    """Leave the latest live entry of each fingerprint.

    The new folders are written beside the old ones, which stay readable until all are complete, and take their
    places at the end. Kinds without a live entry are emptied after that.
    """
    name = _current(spark, path, buckets)
    store = spark.table(name)
    left = latest_entries(live_entries(store, as_of)).select(*STORE_SCHEMA.names)
    kinds = {r["kind"] for r in store.select("kind").distinct().collect()}
    live = {r["kind"] for r in left.select("kind").distinct().collect()}
    left.repartition(buckets, "fp").write.insertInto(name, overwrite=True)
    for kind in kinds - live:
        clear_store(spark, path, kind, buckets)
