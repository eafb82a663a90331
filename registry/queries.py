"""``queries()``: one callable ``(spark, folder) -> DataFrame`` per operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.config import ScanConfig
from lineward.functions.fingerprint import fingerprint, store_key
from lineward.functions.html import page_note, with_html_text
from lineward.functions.match import HITS_TYPE, has_charset, line_hit
from lineward.functions.sniff import (
    audio_type,
    base_name,
    extension,
    extension_mismatch,
    file_type,
    image_type,
    is_audio,
    is_hidden,
    is_image,
    is_text,
)
from lineward.functions.text import excerpt, split_keywords, strip, table_content
from lineward.functions.urls import canonical_url, is_skipped, netloc, same_site
from lineward.operators import database, links, summary
from lineward.operators.keyword_table import join_keywords, scan_keyword_table
from lineward.operators.media import audio_results, image_results, scan_new_media
from lineward.operators.report import combined_report, target_report
from lineward.operators.scan import (
    flat_hits,
    full_check,
    insert_sweep,
    numbered_lines,
    scan_all,
    scan_targets,
    scan_text,
)
from lineward.operators.store import (
    clear_store,
    empty_store,
    known_results,
    latest_entries,
    live_entries,
    pending,
    prune_store,
    read_store,
    reuse_results,
    scan_incremental,
    scan_unique,
    store_entries,
    store_stats,
    with_fingerprint,
    write_store,
)
from lineward.plans.database import database_report, scan_database
from lineward.plans.files import classify_files, scan_files, scan_new_files, scan_text_files
from lineward.plans.media import audio_report
from lineward.plans.web import page_report, scan_new_pages, scan_pages
from lineward.session import checkpoint_dir, stored
from lineward.sources.files import decode_text, list_files, read_files, with_file_text
from lineward.sources.office import zip_encryption
from lineward.sources.pages import distinct_pages
from lineward.sources.sinks import write_report
from lineward.sources.tables import Table, read_folder_tables, text_columns
from lineward.streaming.incremental import scan_arrivals
from registry import derived
from registry.derived import read
from registry.settings import (
    CHECKED_AT,
    EVENT_KINDS,
    KEYWORD_EXACT,
    KEYWORD_FUZZY,
    PAGE_EXACT,
    PAGE_FUZZY,
    STORE_AS_OF,
    STORE_SCANNED_AT,
    SWEEP_FUZZY,
    TABLE_EXACT,
    TABLE_FUZZY,
    TABLE_KEYS,
    TEXT_EXACT,
    TEXT_FUZZY,
)


_MADE: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, name: str, make):
    """What ``make`` returns, once in a session for each data folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _tables(spark: SparkSession, folder: str) -> list[Table]:
    return read_folder_tables(spark, folder, TABLE_KEYS, spread=["documents", "pages", "lineitem"])


def _big(df: DataFrame) -> DataFrame:
    """Line numbers as BIGINT, the type of the SQL side."""
    return df.withColumn("line", F.col("line").cast("bigint")) if "line" in df.columns else df


def _document_results(spark, folder, config=TEXT_FUZZY):
    return scan_targets(_documents(spark, folder), ["doc_id"], "text", config)


def _summed(results: DataFrame, *keys: str) -> DataFrame:
    """Hit arrays as one comparable value per target."""
    return results.select(
        *keys,
        F.size("hits").cast("bigint").alias("n_hits"),
        F.array_join(
            F.transform("hits", lambda h: F.concat_ws(":", h["line"].cast("string"), h["keyword"])),
            ",",
        ).alias("hit_list"),
    )


# --- sources and sinks ---------------------------------------------------------------------------


def src_text_table(spark, folder):
    items = read(spark, folder, "benchmark")
    return _summed(scan_targets(items, ["item_id"], "text", PAGE_EXACT), "item_id")


def src_files(spark, folder):
    """The table files themselves, as files: listed, opened and typed."""
    results = scan_files(read_files(spark, f"file://{folder}"), TEXT_EXACT)
    return results.select(base_name(F.col("path")).alias("name"), "file_type", "is_hidden", "note")


def src_text_splits(spark, folder):
    """The documents of each source as one text file, scanned in pieces of 64 KB."""

    def make():
        path = f"{checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
        docs = _documents(spark, folder).repartition("source").sortWithinPartitions("source", "doc_id")
        docs.select("source", "text").write.partitionBy("source").text(path)
        return path

    path = _once(spark, folder, "text-files", make)
    location = path if "://" in path else f"file://{path}"
    files = list_files(spark, location).where(F.col("path").endswith(".txt"))
    found = scan_text_files(spark, location, TEXT_EXACT, files, split_bytes=64 * 1024)
    source = F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")
    return found.select(source, F.col("line").cast("bigint"), "keyword", "content")


def stream_scan(spark, folder):
    """Documents that arrive on a stream, the labelled ones first; copies take the hits of the first batch."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = _documents(spark, folder).select("doc_id", "text", F.lit(STORE_AS_OF).alias("at"))
    labels = read(spark, folder, "labels")
    for how in ("left_semi", "left_anti"):
        docs.join(labels, "doc_id", how).write.mode("append").parquet(f"{base}/in")
        arrivals = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
        names = (f"{base}/{n}" for n in ("store", "out", "marks"))
        scan_arrivals(arrivals, ["doc_id"], "text", "at", TEXT_FUZZY, *names).awaitTermination()
    return _summed(spark.read.parquet(f"{base}/out"), "doc_id", "reused")


def src_pages(spark, folder):
    pages = distinct_pages(read(spark, folder, "pages"))
    return pages.select("url", F.length("html").cast("bigint").alias("n_chars"))


def src_tables(spark, folder):
    """Tables with their row counts."""
    return database.table_rows(_tables(spark, folder))


def sink_report(spark, folder):
    """A page report written as sorted text parts and read back."""
    report = page_report(scan_pages(read(spark, folder, "pages"), PAGE_FUZZY), CHECKED_AT, "txt")
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(report, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- text extraction -----------------------------------------------------------------------------


def split_lines(spark, folder):
    return _big(numbered_lines(_documents(spark, folder), ["doc_id"], "text"))


def _page_texts(spark, folder):
    pages = read(spark, folder, "pages")
    return with_html_text(pages, "html", "text")


def html_text(spark, folder):
    return _page_texts(spark, folder).select("page_id", "text")


def page_note_query(spark, folder):
    return _page_texts(spark, folder).select("page_id", page_note(F.col("text")).alias("note"))


def decode_text_query(spark, folder):
    """Texts in UTF-8, GBK and with a broken byte."""
    files = derived.encoded_files(_documents(spark, folder))
    return files.select("doc_id", decode_text(F.col("content")).alias("text"))


def ooxml_text(spark, folder):
    files = derived.office_files(_documents(spark, folder))
    texts = with_file_text(files, "content", "text")
    return texts.select("doc_id", "path", "text")


def _office_files(spark, folder):
    """The archives as a table: made once for all queries of a session, as files that are there would be."""
    return _once(
        spark,
        folder,
        "office-files",
        lambda: stored(derived.office_files(_documents(spark, folder)), "office-files"),
    )


def ooxml_scan(spark, folder):
    results = scan_files(_office_files(spark, folder).select("path", "content"), TEXT_FUZZY)
    return _summed(results, "path", "file_type", "note")


def content_trim(spark, folder):
    return _documents(spark, folder).select(
        "doc_id",
        strip(F.col("text")).alias("content"),
        table_content(strip(F.col("text"))).alias("table_content"),
        excerpt(strip(F.col("text"))).alias("excerpt"),
    )


# --- matching ------------------------------------------------------------------------------------


def fuzzy_scan(spark, folder):
    return _big(scan_text(_documents(spark, folder), ["doc_id"], "text", TEXT_FUZZY))


def exact_scan(spark, folder):
    return _big(scan_text(_documents(spark, folder), ["doc_id"], "text", TEXT_EXACT))


def page_scan(spark, folder):
    results = scan_pages(read(spark, folder, "pages"), PAGE_FUZZY)
    return _big(flat_hits(results, ["url"]))


def page_scan_exact(spark, folder):
    results = scan_pages(read(spark, folder, "pages"), PAGE_EXACT)
    return _big(flat_hits(results, ["url"]))


def charset_prefilter(spark, folder):
    lines = numbered_lines(_documents(spark, folder), ["doc_id"], "text")
    low = lines.withColumn("low", F.lower("content"))
    flags = [
        F.count_if(has_charset(F.col("low"), k)).alias(f"lines_{k}")
        for k in TEXT_FUZZY.keyword_list
    ]
    return low.agg(*flags)


def scan(spark, folder):
    """The algorithm switch, one line at a time: both matchers on the conversation turns."""
    turns = read(spark, folder, "conversations")
    lines = numbered_lines(turns, ["conv_id", "turn"], "text")
    fuzzy, exact = ScanConfig(PAGE_EXACT.keywords, "regex", 2), PAGE_EXACT
    return _big(
        lines.select(
            "conv_id",
            "turn",
            "line",
            line_hit(F.col("content"), fuzzy)["keyword"].alias("fuzzy_keyword"),
            line_hit(F.col("content"), exact)["keyword"].alias("exact_keyword"),
        )
    )


def parse_keywords(spark, folder):
    """Keyword lists held in a table column."""
    parts = read(spark, folder, "part")
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" ,, ")), F.lit(" , "), F.col("p_brand"))
    return parts.select(
        "p_partkey", F.posexplode(split_keywords(raw)).alias("pos", "keyword")
    ).select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("ord"), "keyword")


def full_check_query(spark, folder):
    checked = full_check(_documents(spark, folder), ["doc_id"], "text", TEXT_EXACT)
    lines = F.col("total_danger_lines").cast("bigint").alias("total_danger_lines")
    return _summed(checked.select("doc_id", "hits", lines), "doc_id", "total_danger_lines")


def scan_all_fuzzy(spark, folder):
    found = scan_all(_documents(spark, folder), ["doc_id"], "text", TEXT_FUZZY)
    return _big(flat_hits(found, ["doc_id"]))


def scan_all_exact(spark, folder):
    found = scan_all(_documents(spark, folder), ["doc_id"], "text", TEXT_EXACT)
    return _big(flat_hits(found, ["doc_id"]))


def max_insert_sweep(spark, folder):
    swept = insert_sweep(_documents(spark, folder), "text", SWEEP_FUZZY)
    return swept.select(F.col("max_insert").cast("bigint"), "lines")


def _benchmark_words(spark, folder):
    """A long keyword table: the words of the benchmark texts, in alphabetical order of number."""
    words = read(spark, folder, "benchmark").select(
        F.explode(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " ")).alias("keyword")
    )
    kept = words.where(F.col("keyword") != "").distinct()
    return kept.select(F.xxhash64("keyword").alias("ord"), "keyword")


def keyword_table_scan(spark, folder):
    found = scan_keyword_table(
        _documents(spark, folder), ["doc_id"], "text", _benchmark_words(spark, folder), KEYWORD_EXACT
    )
    return _big(found.select("doc_id", "line", "keyword", "content"))


def _part_words(spark, folder):
    """Keywords numbered by the first part that has them in its name."""
    parts = read(spark, folder, "part")
    words = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("keyword"))
    return words.groupBy("keyword").agg(F.min("p_partkey").alias("ord"))


def _part_keywords(spark, folder):
    words = _part_words(spark, folder)
    # Two words may come from the same part: the longer name part decides.
    return words.select((F.col("ord") * 100 + F.length("keyword")).alias("ord"), "keyword")


def keyword_table_short(spark, folder):
    found = scan_keyword_table(
        _documents(spark, folder), ["doc_id"], "text", _part_keywords(spark, folder), KEYWORD_EXACT
    )
    return _big(found.select("doc_id", "line", "keyword", "content"))


def keyword_table_fuzzy(spark, folder):
    found = scan_keyword_table(
        _documents(spark, folder), ["doc_id"], "text", _part_keywords(spark, folder), KEYWORD_FUZZY
    )
    return _big(found)


def keyword_table_join(spark, folder):
    """The same by the join that long tables take."""
    found = join_keywords(
        _documents(spark, folder), ["doc_id"], "text", _part_keywords(spark, folder), KEYWORD_FUZZY
    )
    return _big(found)


# --- file classification -------------------------------------------------------------------------


def file_type_query(spark, folder):
    files = derived.signed_files(_documents(spark, folder))
    return files.select("doc_id", file_type(F.col("content")).alias("file_type"))


def is_text_query(spark, folder):
    content = F.encode("text", "UTF-8")
    return _documents(spark, folder).select("doc_id", is_text(content).alias("is_text"))


def ext_mismatch(spark, folder):
    files = derived.signed_files(_documents(spark, folder))
    typed = files.select("doc_id", "path", file_type(F.col("content")).alias("file_type"))
    return typed.select(
        "doc_id", extension_mismatch(F.col("file_type"), F.col("path")).alias("ext_mismatch")
    )


def image_type_query(spark, folder):
    body = F.col("content")
    return derived.image_files(_documents(spark, folder)).select(
        "doc_id", image_type(body).alias("image_type"), is_image(body).alias("is_image")
    )


def audio_type_query(spark, folder):
    body = F.col("content")
    return derived.audio_files(_documents(spark, folder)).select(
        "doc_id", audio_type(body).alias("audio_type"), is_audio(body).alias("is_audio")
    )


def is_hidden_query(spark, folder):
    files = derived.signed_files(_documents(spark, folder))
    return files.select("doc_id", is_hidden(F.col("path")).alias("is_hidden"))


def zip_encryption_query(spark, folder):
    files = derived.zip_files(_documents(spark, folder))
    flags = zip_encryption(extension(F.col("path")), F.col("content"))
    return files.select("doc_id", flags.alias("f")).select(
        "doc_id", "f.is_encrypted", "f.is_pseudo"
    )


def upload_note(spark, folder):
    """Notes of files as uploads, where names hide nothing."""
    files = derived.zip_files(_documents(spark, folder)).select("path", "content")
    return scan_files(files, TEXT_FUZZY, uploaded=True).select("path", "note")


def file_note(spark, folder):
    files = derived.zip_files(_documents(spark, folder))
    results = scan_files(files.select("path", "content"), TEXT_EXACT)
    return results.select("path", "note")


def file_scan(spark, folder):
    """The file scan over bytes with signatures, names and types."""
    files = derived.signed_files(_documents(spark, folder), derived.READABLE_SIGNATURES)
    results = scan_files(files.select("path", "content"), TEXT_EXACT)
    return _summed(results, "path", "file_type", "is_hidden", "ext_mismatch")


# --- tables --------------------------------------------------------------------------------------


def table_scan(spark, folder):
    return database.table_scan(_tables(spark, folder), TABLE_FUZZY)


def table_scan_exact(spark, folder):
    return database.table_scan(_tables(spark, folder), TABLE_EXACT)


def text_columns_query(spark, folder):
    """Text columns of every table with the number of cells that are scanned."""
    out = None
    for table in _tables(spark, folder):
        cells = database.table_cells(table)
        if cells is not None:
            out = cells if out is None else out.unionByName(cells)
    return out.groupBy("table", "column").agg(F.count("*").alias("cells"))


def row_key(spark, folder):
    """Keys of the parts, and of the line items as if they had no key."""
    parts = Table("part", read(spark, folder, "part"), "p_partkey")
    keyless = Table(
        "nation", read(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"), None
    )
    frames = [
        t.data.select(F.lit(t.name).alias("table"), database.row_key(t).alias("row_pk"))
        for t in (parts, keyless)
    ]
    return frames[0].unionByName(frames[1])


def table_stats(spark, folder):
    tables = _tables(spark, folder)
    return database.table_stats(database.table_scan(tables, TABLE_FUZZY), tables)


def scan_totals(spark, folder):
    tables = _tables(spark, folder)
    stats = database.table_stats(database.table_scan(tables, TABLE_FUZZY), tables)
    return database.scan_totals(stats)


def field_stats(spark, folder):
    found = scan_database(_tables(spark, folder), TABLE_FUZZY)
    return found.fields.withColumn("samples", F.array_join("samples", "；"))


# --- links ---------------------------------------------------------------------------------------


def extract_links(spark, folder):
    pages = read(spark, folder, "pages")
    return links.extract_links(pages)


def canonical_url_query(spark, folder):
    pages = read(spark, folder, "pages")
    return pages.select("url", canonical_url(F.col("url")).alias("canonical"))


def same_site_query(spark, folder):
    """Links against the site of the page, and of the page before it by number."""
    found = links.extract_links(read(spark, folder, "pages"))
    return found.select(
        "url",
        "link",
        netloc(F.col("url")).alias("site"),
        same_site(F.col("link"), netloc(F.col("url"))).alias("internal"),
        same_site(F.col("link"), F.regexp_replace(netloc(F.col("url")), r"^(m|blog)\.", "")).alias(
            "main_site"
        ),
    )


def skip_ext(spark, folder):
    """The skip list on page addresses, as they are and with a file name behind them."""
    pages = read(spark, folder, "pages")
    named = F.concat(canonical_url(F.col("url")), F.lit("/plan.PDF?v=1"))
    return pages.select(
        "url", is_skipped(F.col("url")).alias("skipped"), is_skipped(named).alias("named_skipped")
    )


def frontier(spark, folder):
    pages = read(spark, folder, "pages")
    visited = pages.select(canonical_url(F.col("url")).alias("url"))
    return links.frontier(links.site_links(pages), visited)


def reachable(spark, folder):
    pages = read(spark, folder, "pages")
    found = links.reachable(pages, links.site_seeds(pages))
    return found.select("url", F.col("depth").cast("bigint"))


def reachable_sizes(spark, folder):
    """How many addresses each site has at each depth, from all stored pages."""
    pages = read(spark, folder, "pages")
    seeds = pages.select(canonical_url(F.col("url")).alias("url"))
    found = links.site_sizes(links.reachable(pages, seeds))
    return found.select("site", F.col("depth").cast("bigint"), "addresses")


# --- result store --------------------------------------------------------------------------------


def fingerprint_query(spark, folder):
    docs = _documents(spark, folder)
    return docs.select(
        "doc_id",
        fingerprint(F.col("text"), TEXT_FUZZY).alias("fp"),
        store_key("file", F.encode("text", "UTF-8"), TEXT_EXACT).alias("file_key"),
        fingerprint(F.col("text"), TEXT_FUZZY, "eng").alias("ocr_fp"),
    )


def _written_store(spark, folder, name, entries):
    """A store on disk, written by a first run and read by the queries that follow."""

    def make():
        path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
        write_store(entries(), path)
        return path

    return read_store(spark, _once(spark, folder, name, make))


def _labelled(spark, folder):
    return _documents(spark, folder).join(read(spark, folder, "labels"), "doc_id", "left_semi")


def _first_texts(docs):
    rows = with_fingerprint(docs, "text", TEXT_FUZZY)
    results = scan_targets(rows, ["doc_id"], "text", TEXT_FUZZY, keep=["fp"])
    return store_entries(results, "file", STORE_SCANNED_AT)


def _store(spark, folder):
    """A store holding the results of the labelled documents."""
    return _written_store(spark, folder, "texts", lambda: _first_texts(_labelled(spark, folder)))


def _full_store(spark, folder):
    """A store holding the results of all documents."""
    return _written_store(spark, folder, "all-texts", lambda: _first_texts(_documents(spark, folder)))


def _rows(spark, folder):
    return with_fingerprint(_documents(spark, folder), "text", TEXT_FUZZY)


def reuse_results_query(spark, folder):
    known = known_results(_store(spark, folder), "file", STORE_AS_OF)
    return _summed(reuse_results(_rows(spark, folder), ["doc_id"], known), "doc_id", "fp")


def pending_query(spark, folder):
    known = known_results(_store(spark, folder), "file", STORE_AS_OF)
    return pending(_rows(spark, folder), ["doc_id"], known).select("doc_id", "fp")


def scan_incremental_query(spark, folder):
    known = known_results(_store(spark, folder), "file", STORE_AS_OF)
    found = scan_incremental(_rows(spark, folder), ["doc_id"], "text", known, TEXT_FUZZY)
    return _summed(found, "doc_id", "reused")


def text_rescan(spark, folder):
    """A second run over all documents: nothing is scanned again."""
    known = known_results(_full_store(spark, folder), "file", STORE_AS_OF)
    found = scan_incremental(_rows(spark, folder), ["doc_id"], "text", known, TEXT_FUZZY)
    return _summed(found, "doc_id", "reused")


def _media_files(spark, folder, files):
    """Files with the text that was recognised in them."""
    docs = _documents(spark, folder)
    made = files(docs).join(docs.select("doc_id", "text"), "doc_id")
    return made.select("doc_id", F.format_string("%d.bin", "doc_id").alias("path"), "content", "text")


def _media_run(spark, folder, kind, files, extractor):
    found = _once(spark, folder, f"{kind}-files", lambda: stored(_media_files(spark, folder, files), kind))

    def scan(some, store):
        return scan_new_media(some, "text", store, kind, TEXT_FUZZY, STORE_AS_OF, extractor)

    def first():
        some = found.join(read(spark, folder, "labels"), "doc_id", "left_semi")
        return store_entries(scan(some, empty_store(spark)), kind, STORE_SCANNED_AT)

    again = scan(found, _written_store(spark, folder, kind, first))
    return _summed(again, "path", "file_type", "note", "reused")


def reuse_images(spark, folder):
    return _media_run(spark, folder, "image", derived.image_files, "chi_sim+eng")


def reuse_audio(spark, folder):
    return _media_run(spark, folder, "audio", derived.audio_files, "")


def _file_run(spark, folder, name, files, known, config):
    """A run over files where a first one has seen ``known``."""

    def first():
        moved = known.select(F.concat(F.lit("old/."), "path").alias("path"), "content")
        return store_entries(
            scan_new_files(moved, empty_store(spark), config, STORE_AS_OF), "file", STORE_SCANNED_AT
        )

    store = _written_store(spark, folder, name, first)
    again = scan_new_files(files, store, config, STORE_AS_OF)
    return _summed(again, "path", "file_type", "is_hidden", "ext_mismatch", "note", "reused")


def reuse_files(spark, folder):
    """Files of many types, those of labelled documents known under other, hidden names."""
    files = derived.signed_files(_documents(spark, folder), derived.READABLE_SIGNATURES)
    known = files.join(read(spark, folder, "labels"), "doc_id", "left_semi")
    return _file_run(spark, folder, "files", files, known, TEXT_EXACT)


def office_rescan(spark, folder):
    """A second run over all office files under new names: no archive is opened again."""
    files = _office_files(spark, folder)
    return _file_run(spark, folder, "office", files, files, TEXT_FUZZY)


def scan_unique_query(spark, folder):
    found = scan_unique(_documents(spark, folder), ["doc_id"], "text", TEXT_FUZZY)
    return _summed(found, "doc_id")


def _event_store(spark, folder):
    """Events as store entries: the type stands for the kind, its properties for the content."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return read(spark, folder, "events").select(
        kinds[F.col("event_type")].alias("kind"),
        F.md5("props").alias("fp"),
        F.col("ts").cast("timestamp").alias("scanned_at"),
        F.col("event_id"),
    )


def ttl_filter(spark, folder):
    live = live_entries(_event_store(spark, folder), STORE_AS_OF)
    return live.select("event_id", "kind")


def latest_entries_query(spark, folder):
    newest = latest_entries(_event_store(spark, folder))
    return newest.select("kind", "fp", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("scanned_at"))


def store_stats_query(spark, folder):
    return store_stats(_store(spark, folder))


def _event_entries(spark, folder):
    """Events as whole entries without hits."""
    return _event_store(spark, folder).select(
        "kind",
        "fp",
        "scanned_at",
        F.array().cast(HITS_TYPE).alias("hits"),
        F.lit("").alias("note"),
        F.lit("").alias("file_type"),
    )


def store_clear(spark, folder):
    """A store of all events on disk, the web folder emptied, read back."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(_event_entries(spark, folder), path)
    clear_store(spark, path, "web")
    return read_store(spark, path).groupBy("kind").agg(F.count("*").alias("entries"))


def store_prune(spark, folder):
    """The same store with only the latest live entry of each content left."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(_event_entries(spark, folder), path)
    prune_store(spark, path, STORE_AS_OF)
    left = read_store(spark, path)
    return left.select("kind", "fp", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("scanned_at"))


def _page_run(spark, folder, name, known):
    pages = read(spark, folder, "pages")

    def first():
        found = scan_new_pages(known(pages), empty_store(spark), PAGE_FUZZY, STORE_AS_OF)
        return store_entries(found, "web", STORE_SCANNED_AT)

    store = _written_store(spark, folder, name, first)
    return _summed(scan_new_pages(pages, store, PAGE_FUZZY, STORE_AS_OF), "url", "note", "reused")


def page_store(spark, folder):
    """A second run over the stored pages of encrypted sites: everything else is scanned anew."""
    return _page_run(spark, folder, "secure-pages", lambda p: p.where(F.col("url").startswith("https:")))


def page_rescan(spark, folder):
    """A second run over all pages."""
    return _page_run(spark, folder, "pages", lambda p: p)


# --- roll-ups ------------------------------------------------------------------------------------


def source_summary(spark, folder):
    return summary.source_summary(_document_results(spark, folder))


def type_distribution(spark, folder):
    files = classify_files(derived.signed_files(_documents(spark, folder)).select("path", "content"))
    return summary.type_distribution(files)


def _turn_results(spark, folder):
    turns = read(spark, folder, "conversations")
    path = F.format_string("%d/%d.wav", "conv_id", "turn")
    return audio_results(turns.select(path.alias("path"), "text"), "text", PAGE_FUZZY)


def _picture_results(spark, folder):
    items = read(spark, folder, "benchmark").select(
        F.format_string("%d.png", "item_id").alias("path"),
        F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), F.encode("text", "UTF-8")).alias("content"),
        "text",
    )
    return image_results(items, "text", PAGE_FUZZY)


def overview(spark, folder):
    found = scan_database(_tables(spark, folder), TABLE_FUZZY)
    return summary.overview(
        summary.per_source(scan_pages(read(spark, folder, "pages"), PAGE_FUZZY), "web", "url"),
        summary.per_source(_document_results(spark, folder), "file", "doc_id"),
        summary.per_source(_picture_results(spark, folder), "image", "path"),
        summary.per_source(_turn_results(spark, folder), "audio", "path"),
        summary.database_source(found.fields, "tables"),
    ).select(F.coalesce("kind", F.lit("total")).alias("kind"), "sources", "hits")


def hits_by_target(spark, folder):
    return _summed(_document_results(spark, folder), "doc_id")


def line_list(spark, folder):
    return _document_results(spark, folder).select(
        "doc_id", summary.line_list(F.col("hits")).alias("lines")
    )


def sorted_targets(spark, folder):
    results = scan_pages(read(spark, folder, "pages"), PAGE_FUZZY)
    return _summed(summary.sorted_targets(results, "url"), "url")


def sample_topk(spark, folder):
    samples = database.field_samples(database.table_scan(_tables(spark, folder), TABLE_FUZZY))
    return samples.withColumn("place", F.col("place").cast("bigint"))


def keyword_frequency(spark, folder):
    found = scan_text(_documents(spark, folder), ["doc_id"], "text", TEXT_FUZZY)
    return summary.keyword_frequency(found, "doc_id")


def verdict(spark, folder):
    """Verdicts on the documents of each source."""
    results = scan_targets(
        _documents(spark, folder), ["source"], "text", TEXT_FUZZY
    )
    total = results.groupBy("source").agg(F.sum(F.size("hits")).alias("hits"))
    return total.select("source", summary.verdict(F.col("hits")).alias("verdict"))


def image_scan(spark, folder):
    return _summed(_picture_results(spark, folder), "path", "file_type", "note")


def audio_scan(spark, folder):
    return _summed(_turn_results(spark, folder), "path", "file_type", "note")


# --- reports -------------------------------------------------------------------------------------


def report_txt(spark, folder):
    return page_report(scan_pages(read(spark, folder, "pages"), PAGE_FUZZY), CHECKED_AT, "txt")


def report_md(spark, folder):
    return page_report(scan_pages(read(spark, folder, "pages"), PAGE_FUZZY), CHECKED_AT, "md")


def report_file(spark, folder):
    results = _document_results(spark, folder).select(
        F.format_string("%09d.txt", "doc_id").alias("path"),
        "hits",
        F.lit("text").alias("file_type"),
        F.lit("").alias("note"),
    )
    return target_report(results, "file", "path", "文件路径检查", CHECKED_AT, "txt")


def report_file_md(spark, folder):
    results = _document_results(spark, folder).select(
        F.format_string("%09d.txt", "doc_id").alias("path"),
        "hits",
        F.lit("text").alias("file_type"),
        F.lit("").alias("note"),
    )
    return target_report(results, "file", "path", "文件路径检查", CHECKED_AT, "md")


def report_audio_md(spark, folder):
    return audio_report(_turn_results(spark, folder), CHECKED_AT, "md")


def report_image_txt(spark, folder):
    return target_report(
        _picture_results(spark, folder), "image", "path", "图片路径检查", CHECKED_AT, "txt"
    )


def report_audio(spark, folder):
    return audio_report(_turn_results(spark, folder), CHECKED_AT, "txt")


def report_image(spark, folder):
    return target_report(
        _picture_results(spark, folder), "image", "path", "图片路径检查", CHECKED_AT, "md"
    )


def report_db(spark, folder):
    found = scan_database(_tables(spark, folder), TABLE_FUZZY)
    return database_report(found, "tables", CHECKED_AT, "txt")


def report_db_md(spark, folder):
    found = scan_database(_tables(spark, folder), TABLE_FUZZY)
    return database_report(found, "tables", CHECKED_AT, "md")


def report_combined(spark, folder):
    tables = _tables(spark, folder)
    found = scan_database(tables, TABLE_FUZZY)
    return combined_report(
        {
            "web": (scan_pages(read(spark, folder, "pages"), PAGE_FUZZY), "url"),
            "audio": (_turn_results(spark, folder), "path"),
        },
        CHECKED_AT,
        ("tables", database.table_rows(tables), found.fields),
    )


QUERIES = {
    "src_text_table": src_text_table,
    "src_files": src_files,
    "src_text_splits": src_text_splits,
    "src_pages": src_pages,
    "src_tables": src_tables,
    "sink_report": sink_report,
    "split_lines": split_lines,
    "html_text": html_text,
    "page_note": page_note_query,
    "decode_text": decode_text_query,
    "ooxml_text": ooxml_text,
    "ooxml_scan": ooxml_scan,
    "content_trim": content_trim,
    "fuzzy_scan": fuzzy_scan,
    "exact_scan": exact_scan,
    "page_scan": page_scan,
    "page_scan_exact": page_scan_exact,
    "charset_prefilter": charset_prefilter,
    "scan": scan,
    "parse_keywords": parse_keywords,
    "full_check": full_check_query,
    "scan_all_fuzzy": scan_all_fuzzy,
    "scan_all_exact": scan_all_exact,
    "max_insert_sweep": max_insert_sweep,
    "keyword_table_scan": keyword_table_scan,
    "keyword_table_short": keyword_table_short,
    "keyword_table_fuzzy": keyword_table_fuzzy,
    "keyword_table_join": keyword_table_join,
    "file_type": file_type_query,
    "is_text": is_text_query,
    "ext_mismatch": ext_mismatch,
    "image_type": image_type_query,
    "audio_type": audio_type_query,
    "is_hidden": is_hidden_query,
    "zip_encryption": zip_encryption_query,
    "file_note": file_note,
    "upload_note": upload_note,
    "file_scan": file_scan,
    "table_scan": table_scan,
    "table_scan_exact": table_scan_exact,
    "text_columns": text_columns_query,
    "row_key": row_key,
    "table_stats": table_stats,
    "scan_totals": scan_totals,
    "field_stats": field_stats,
    "extract_links": extract_links,
    "canonical_url": canonical_url_query,
    "same_site": same_site_query,
    "skip_ext": skip_ext,
    "frontier": frontier,
    "reachable": reachable,
    "reachable_sizes": reachable_sizes,
    "fingerprint": fingerprint_query,
    "reuse_results": reuse_results_query,
    "pending": pending_query,
    "scan_incremental": scan_incremental_query,
    "text_rescan": text_rescan,
    "reuse_files": reuse_files,
    "reuse_images": reuse_images,
    "reuse_audio": reuse_audio,
    "office_rescan": office_rescan,
    "stream_scan": stream_scan,
    "scan_unique": scan_unique_query,
    "ttl_filter": ttl_filter,
    "latest_entries": latest_entries_query,
    "store_stats": store_stats_query,
    "store_clear": store_clear,
    "store_prune": store_prune,
    "page_store": page_store,
    "page_rescan": page_rescan,
    "source_summary": source_summary,
    "type_distribution": type_distribution,
    "overview": overview,
    "hits_by_target": hits_by_target,
    "line_list": line_list,
    "sorted_targets": sorted_targets,
    "sample_topk": sample_topk,
    "keyword_frequency": keyword_frequency,
    "verdict": verdict,
    "image_scan": image_scan,
    "audio_scan": audio_scan,
    "report_txt": report_txt,
    "report_md": report_md,
    "report_file": report_file,
    "report_audio": report_audio,
    "report_image": report_image,
    "report_file_md": report_file_md,
    "report_audio_md": report_audio_md,
    "report_image_txt": report_image_txt,
    "report_db": report_db,
    "report_db_md": report_db_md,
    "report_combined": report_combined,
}
