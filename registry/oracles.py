"""``oracle_sql()``: the same results in plain SQL over the same tables."""

from __future__ import annotations

from lineward.config import RESULT_TTL_SECONDS, ScanConfig
from lineward.functions.sniff import AUDIO_SIGNATURES, FILE_SIGNATURES, IMAGE_SIGNATURES
from lineward.functions.text import STRIP_CHARS
from registry.derived import READABLE_SIGNATURES
from registry.settings import (
    CHECKED_AT,
    EVENT_KINDS,
    PAGE_EXACT,
    PAGE_FUZZY,
    STORE_AS_OF,
    STORE_SCANNED_AT,
    SWEEP_FUZZY,
    TABLE_EXACT,
    TABLE_FUZZY,
    TABLE_KEYS,
    TEXT_COLUMNS,
    TEXT_EXACT,
    TEXT_FUZZY,
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(STRIP_CHARS)})"


def _re(keyword: str) -> str:
    return "(?s)" + ".*?".join(
        c if c.isalnum() or ord(c) > 127 else "\\" + c for c in keyword
    )


def lines(source: str, keys: str, text: str) -> str:
    split = f"string_split({text}, chr(10))"
    return (
        f"SELECT {keys}, unnest({split}) AS raw, generate_subscripts({split}, 1) AS line "
        f"FROM {source}"
    )


def line_keyword(expr: str, config: ScanConfig) -> tuple[str, str]:
    """Expressions for the keyword and the matched text of one line."""
    keywords = config.keyword_list
    if config.is_fuzzy:
        tries = [
            f"list_filter(regexp_extract_all(lower({expr}), {q(_re(k))}, 0), "
            f"lambda m: length(m) <= {len(k) + config.max_insert})[1]"
            for k in keywords
        ]
        named = " ".join(f"WHEN {t} IS NOT NULL THEN {q(k)}" for k, t in zip(keywords, tries))
        return f"CASE {named} END", f"coalesce({', '.join(tries)})"
    places = ", ".join(
        f"{{'e': instr({expr}, {q(k)}) + {len(k) - 1}, 'n': {-len(k)}, 'k': {q(k)}}}"
        for k in keywords
    )
    best = f"list_min(list_filter([{places}], lambda p: p.e > -p.n - 1)).k"
    return best, best


def hit_rows(source: str, keys: str, text: str, config: ScanConfig) -> str:
    """``keys, line, keyword, content, matched_text`` of every hit."""
    keyword, matched = line_keyword("raw", config)
    return (
        f"SELECT {keys}, line, keyword, content, matched_text FROM (SELECT {keys}, line, "
        f"{keyword} AS keyword, {strip('raw')} AS content, {matched} AS matched_text "
        f"FROM ({lines(source, keys, text)})) WHERE keyword IS NOT NULL"
    )


def summed(source: str, keys: str, text: str, config: ScanConfig, extra: str = "") -> str:
    """One row per target: the number of hits and the list of them."""
    names = keys.split(", ")
    on = " AND ".join(f"t.{k} = h.{k}" for k in names)
    group = ", ".join(f"t.{k}" for k in names)
    more = f", {extra}" if extra else ""
    return (
        f"WITH h AS ({hit_rows(source, keys, text, config)}), "
        f"a AS (SELECT {keys}, count(*) AS n, "
        f"string_agg(line || ':' || keyword, ',' ORDER BY line) AS l FROM h GROUP BY ALL) "
        f"SELECT {group}{more}, coalesce(h.n, 0) AS n_hits, coalesce(h.l, '') AS hit_list "
        f"FROM {source} t LEFT JOIN a h ON {on}"
    )


# --- page text -----------------------------------------------------------------------------------

_MARK = "﷐"


def _page_text(html: str) -> str:
    expr = (
        f"regexp_replace({html}, '(?is)<!--.*?-->|<script(?:[\\s/][^>]*)?>.*?</script\\s*>"
        f"|<style(?:[\\s/][^>]*)?>.*?</style\\s*>', chr(64976), 'g')"
    )
    for tag in ("nav", "footer", "header"):
        expr = f"regexp_replace({expr}, '(?is)<{tag}(?:[\\s/][^>]*)?>.*?</{tag}\\s*>', chr(64976), 'g')"
    expr = f"regexp_replace({expr}, '(?s)</?[a-zA-Z][^>]*>|<![^>]*>', chr(64976), 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expr = f"replace({expr}, '&{name};', {q(char)})"
    nodes = f"list_transform(string_split({expr}, chr(64976)), lambda n: {strip('n')})"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), chr(10))"


PAGE_TEXTS = f"(SELECT page_id, url, {_page_text('html')} AS text FROM pages)"

# --- file bytes ----------------------------------------------------------------------------------


def _readable(text: str) -> str:
    """Whether a text's bytes are readable: no zero byte, 70 % printable."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    good = (
        f"len(list_filter({pairs}, lambda b: (b >= '20' AND b <= '7E') OR b IN ('09', '0A', '0D')))"
    )
    zeros = f"len(list_filter({pairs}, lambda b: b = '00'))"
    return f"({text} <> '' AND {zeros} = 0 AND {good} * 10 >= len({pairs}) * 7)"


_TYPES = list(FILE_SIGNATURES)
FILE_TYPE = (
    f"CASE WHEN doc_id % {len(_TYPES) + 1} < {len(_TYPES)} "
    f"THEN ([{', '.join(map(q, _TYPES))}])[(doc_id % {len(_TYPES) + 1} + 1)::INT] "
    f"WHEN text = '' THEN 'empty' WHEN {_readable('text')} THEN 'text' ELSE 'binary' END"
)
_SUFFIX = "(['txt', 'pdf', 'png', 'zip', 'html'])[(n_chars % 5 + 1)::INT]"
_DOT = "CASE WHEN n_chars % 2 = 0 THEN '.' ELSE '' END"
FILE_PATH = f"source || '/' || {_DOT} || doc_id || '.' || {_SUFFIX}"
MISMATCH = f"(({FILE_TYPE}) NOT IN ('text', 'binary', 'empty') AND ({FILE_TYPE}) <> {_SUFFIX})"
# The same with the signatures that read as UTF-8.
_READABLE_TYPES = list(READABLE_SIGNATURES)
_READABLE_TYPE = (
    f"CASE WHEN doc_id % {len(_READABLE_TYPES) + 1} < {len(_READABLE_TYPES)} "
    f"THEN ([{', '.join(map(q, _READABLE_TYPES))}])[(doc_id % {len(_READABLE_TYPES) + 1} + 1)::INT] "
    f"WHEN text = '' THEN 'empty' WHEN {_readable('text')} THEN 'text' ELSE 'binary' END"
)
_HEADS = ", ".join(" || ".join(f"chr({b})" for b in h) for h in READABLE_SIGNATURES.values())
_READABLE_FILES = (
    f"(SELECT {FILE_PATH} AS path, {_READABLE_TYPE} AS file_type, n_chars % 2 = 0 AS is_hidden, "
    f"(({_READABLE_TYPE}) NOT IN ('text', 'binary', 'empty') AND ({_READABLE_TYPE}) <> {_SUFFIX}) AS ext_mismatch, "
    f"CASE WHEN n_chars % 2 = 0 THEN '隐藏文件' ELSE '' END AS note, doc_id % {len(_READABLE_TYPES) + 1} AS head, text AS body, "
    f"([{_HEADS}, ''])[(doc_id % {len(_READABLE_TYPES) + 1} + 1)::INT] || text AS text FROM documents)"
)
_ZIP_PATH = (
    f"source || '/' || {_DOT} || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.dat' ELSE '.zip' END"
)


def _cycle(names: list[str | None], alias: str) -> str:
    items = ", ".join("NULL" if n is None else q(n) for n in names)
    return f"([{items}])[(doc_id % {len(names)} + 1)::INT] AS {alias}"


_IMAGES = [*IMAGE_SIGNATURES.values(), None]
_AUDIO = [*AUDIO_SIGNATURES.values(), "m4a", None]

# --- tables --------------------------------------------------------------------------------------


def _cells() -> str:
    return " UNION ALL ".join(
        f"SELECT {q(t)} AS \"table\", CAST({TABLE_KEYS[t]} AS VARCHAR) AS row_pk, "
        f"{q(c)} AS \"column\", {c} AS value, row_no FROM "
        f"(SELECT *, row_number() OVER () AS row_no FROM {t}) WHERE {c} <> ''"
        for t, columns in TEXT_COLUMNS.items()
        for c in columns
    )


def _table_hits(config: ScanConfig, more: str = "") -> str:
    keys = '"table", row_pk, "column"' + more
    return f"SELECT {keys}, keyword, content FROM ({hit_rows(f'({_cells()})', keys, 'value', config)})"


TABLE_ROWS = " UNION ALL ".join(
    f"SELECT {q(t)} AS \"table\", count(*) AS total_rows FROM {t}" for t in TABLE_KEYS
)
_HITS = f"h AS ({_table_hits(TABLE_FUZZY, ', row_no')}), r AS ({TABLE_ROWS})"
_STATS = (
    'SELECT r."table", coalesce(n, 0) AS hits, coalesce(n, 0) > 0 AS affected FROM r LEFT JOIN '
    '(SELECT "table", count(*) AS n FROM h GROUP BY ALL) USING ("table")'
)
_SAMPLES = (
    'SELECT "table", "column", row_number() OVER (PARTITION BY "table", "column" '
    "ORDER BY row_pk, content, keyword) AS place, content FROM h QUALIFY place <= 3"
)
_FIELDS = (
    'SELECT "table", total_rows, sensitive_rows, "column", samples FROM '
    '(SELECT "table", "column", string_agg(content, \'；\' ORDER BY place) AS samples '
    f"FROM ({_SAMPLES}) GROUP BY ALL) JOIN "
    '(SELECT "table", count(DISTINCT row_no) AS sensitive_rows FROM h GROUP BY ALL) '
    'USING ("table") JOIN r USING ("table")'
)

# --- links ---------------------------------------------------------------------------------------


def _netloc(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def _canonical(url: str) -> str:
    return f"rtrim(regexp_replace(regexp_replace({url}, '(?s)#.*$', ''), '\\?$', ''), '/')"


def _skipped(url: str) -> str:
    return f"regexp_matches(lower({url}), '\\.(zip|rar|7z|exe|msi|pdf|docx)')"


LINKS = (
    "SELECT url, href, CASE WHEN starts_with(href, '/') THEN "
    "regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS link FROM "
    "(SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)"
)
SITE_LINKS = (
    f"SELECT DISTINCT url, {_canonical('link')} AS link, {_skipped(_canonical('link'))} AS skipped "
    f"FROM ({LINKS}) WHERE {_netloc('link')} = {_netloc('url')}"
)
EDGES = f"SELECT DISTINCT {_canonical('url')} AS url, link, skipped FROM ({SITE_LINKS})"
SEEDS = (
    f"SELECT min(u) AS url FROM (SELECT {_canonical('url')} AS u FROM pages) GROUP BY {_netloc('u')}"
)
ALL_SEEDS = f"SELECT DISTINCT {_canonical('url')} AS url FROM pages"


def _reachable(seeds: str) -> str:
    return (
        f"WITH RECURSIVE e AS ({EDGES}), s AS ({seeds}), walk(url, skipped, depth) AS ("
        "SELECT url, false, 0 FROM s UNION "
        "SELECT e.link, e.skipped, w.depth + 1 FROM walk w JOIN e ON e.url = w.url "
        "WHERE NOT w.skipped AND w.depth < (SELECT count(DISTINCT url) FROM e)) "
        "SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url"
    )


# --- result store --------------------------------------------------------------------------------


def _fp(config: ScanConfig, extractor: str = "") -> str:
    return f"md5(text || {q(config.fingerprint_key(extractor))})"


_KNOWN = (
    f"SELECT DISTINCT {_fp(TEXT_FUZZY)} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
)
_EVENT_KIND = "CASE event_type " + " ".join(
    f"WHEN {q(e)} THEN {q(k)}" for e, k in EVENT_KINDS.items()
) + " END"
_EVENT_TTL = "CASE event_type " + " ".join(
    f"WHEN {q(e)} THEN {RESULT_TTL_SECONDS[k]}" for e, k in EVENT_KINDS.items()
) + " END"

_LABELLED = "SELECT doc_id FROM labels"


def _media(kinds: list[str | None], named: str, other: str, empty: str, text: str) -> str:
    """Files with a signature of each kind in turn, with text and note; known by the same bytes."""
    head = f"doc_id % {len(kinds)}"
    return (
        f"(SELECT doc_id || '.bin' AS path, CASE WHEN kind IS NULL THEN 'unknown' ELSE {named} END AS file_type, "
        f"CASE WHEN kind IS NULL THEN {q(other)} WHEN shown = '' THEN {q(empty)} ELSE '' END AS note, "
        f"CASE WHEN kind IS NULL THEN '' ELSE shown END AS text, (head, raw) IN "
        f"(SELECT ({head}, text) FROM documents WHERE doc_id IN ({_LABELLED})) AS reused "
        f"FROM (SELECT doc_id, {head} AS head, text AS raw, {text} AS shown, {_cycle(kinds, 'kind')} FROM documents))"
    )


# --- reports -------------------------------------------------------------------------------------


def _report_rows(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _fixed(section: int, source: str, *exprs: str) -> str:
    listed = "[" + ", ".join(exprs) + "]"
    return (
        f"SELECT {section} AS section, CAST(0 AS BIGINT) AS target_no, "
        f"generate_subscripts({listed}, 1) - 1 AS seq, '' AS sort_key, unnest({listed}) AS line "
        f"FROM {source}"
    )


def _targets(source: str, exprs: str) -> str:
    return (
        "SELECT 1 AS section, CAST(target_no AS BIGINT) AS target_no, "
        f"generate_subscripts({exprs}, 1) - 1 AS seq, '' AS sort_key, unnest({exprs}) AS line "
        f"FROM {source}"
    )


def _target_hits(source: str, keys: str, text: str, config: ScanConfig, shown: str) -> str:
    """CTEs: hits ``h``, one row per target ``t`` with its number and rendered hits, counts ``c``."""
    key = keys
    return (
        f"h AS ({hit_rows(source, key, text, config)}), "
        f"g AS (SELECT {key}, count(*) AS n, list({shown} ORDER BY line) AS found FROM h GROUP BY ALL), "
        f"t AS (SELECT s.{key} AS target, s.note, coalesce(n, 0) AS n, coalesce(found, []) AS found, "
        f"row_number() OVER (ORDER BY s.{key}) AS target_no FROM {source} s LEFT JOIN g USING ({key})), "
        "c AS (SELECT count(*) AS targets, count_if(n > 0) AS hit_targets, "
        "CAST(sum(n) AS BIGINT) AS hits FROM t)"
    )


_RULE, _THIN, _WIDE = q("=" * 60), q("-" * 60), q("=" * 70)
_TXT_HIT = "'    第' || line || '行 | 关键词 [' || keyword || '] → ' || content"
_PAGES_NOTED = (
    "(SELECT url, text, CASE WHEN text = '' THEN '无法读取页面内容' ELSE '' END AS note "
    f"FROM {PAGE_TEXTS})"
)

REPORT_TXT = (
    f"WITH {_target_hits(_PAGES_NOTED, 'url', 'text', PAGE_FUZZY, _TXT_HIT)} "
    + _report_rows(
        [
            _fixed(
                0, "c", _RULE, q(" " * 10 + "网页涉密数据检查报告"), _RULE, q("检查模式: 网页爬取检查"),
                q(f"检查时间: {CHECKED_AT}"), "'共检查网页数: ' || targets",
                "'发现涉密网页数: ' || hit_targets", "'涉密数据总条数: ' || hits", _THIN,
            ),
            _targets(
                "t",
                "list_concat(['', '【网页 ' || target_no || '】' || target], "
                "CASE WHEN note <> '' THEN ['  备注: ' || note] ELSE [] END, "
                "CASE WHEN n > 0 THEN list_concat(['  涉密信息 (' || n || ' 处):'], found) "
                "ELSE ['  未发现涉密数据。'] END)",
            ),
            _fixed(2, "c", _RULE, q("报告结束")),
        ]
    )
)

_MD_HIT = "'- 第' || line || '行 | 关键词 `' || keyword || '` | ' || content"
REPORT_MD = (
    f"WITH {_target_hits(_PAGES_NOTED, 'url', 'text', PAGE_FUZZY, _MD_HIT)} "
    + _report_rows(
        [
            _fixed(
                0, "c", q("# 网页涉密数据检查报告"), "''", q("## 检查摘要"), "''", q("| 项目 | 内容 |"),
                q("| --- | --- |"), q("| 检查模式 | 网页爬取检查 |"), q(f"| 检查时间 | {CHECKED_AT} |"),
                "'| 共检查网页数 | ' || targets || ' |'", "'| 发现涉密网页数 | ' || hit_targets || ' |'",
                "'| 涉密数据总条数 | ' || hits || ' |'", "''", q("## 详细结果"), "''",
            ),
            _targets(
                "t",
                "list_concat(CASE WHEN target_no > 1 THEN [''] ELSE [] END, "
                "['### 网页 ' || target_no, '**目标：** ' || target], "
                "CASE WHEN note <> '' THEN ['- **备注：** ' || note] ELSE [] END, "
                "CASE WHEN n > 0 THEN list_concat(['- **涉密信息：** ' || n || ' 处'], found) "
                "ELSE ['未发现涉密数据。'] END)",
            ),
        ]
    )
)

_DOC_FILES = "(SELECT printf('%09d.txt', doc_id) AS path, text, '' AS note FROM documents)"
REPORT_FILE = (
    f"WITH {_target_hits(_DOC_FILES, 'path', 'text', TEXT_FUZZY, _TXT_HIT)}, "
    "k AS (SELECT * REPLACE (row_number() OVER (ORDER BY target) AS target_no) FROM t WHERE n > 0) "
    + _report_rows(
        [
            _fixed(
                0, "c", _RULE, q(" " * 11 + "文件涉密数据检查报告"), _RULE, q("检查方式: 文件路径检查"),
                q(f"检查时间: {CHECKED_AT}"), "'检查文件数: ' || targets",
                "'发现涉密文件数: ' || hit_targets", _THIN, q("详细结果："),
            ),
            _targets(
                "k",
                "list_concat(['', '【文件】' || target, '  类型: text', "
                "'  涉密信息 (' || n || ' 处):'], found)",
            ),
            _fixed(2, "c", _RULE, q("报告结束")),
        ]
    )
)

_TURNS = "(SELECT conv_id || '/' || turn || '.wav' AS path, text, '' AS note FROM conversations)"
_AUDIO_HIT = "'    时间 ' || line || 's | 关键词 [' || keyword || '] → ' || content"
REPORT_AUDIO = (
    f"WITH {_target_hits(_TURNS, 'path', 'text', PAGE_FUZZY, _AUDIO_HIT)} "
    + _report_rows(
        [
            _fixed(
                0, "c", _RULE, q(" " * 10 + "音频涉密数据检查报告"), _RULE, q("检查模式: 音频路径检查"),
                q(f"检查时间: {CHECKED_AT}"), "'扫描音频数: ' || targets",
                "'发现涉密音频数: ' || hit_targets", _THIN,
            ),
            _targets(
                "t",
                "list_concat(['', '【音频 ' || target_no || '】' || target], "
                "CASE WHEN n > 0 THEN list_concat(['  涉密信息 (' || n || ' 处):'], found) "
                "ELSE ['  未发现涉密数据。'] END)",
            ),
            _fixed(2, "c", _RULE, q("报告结束")),
        ]
    )
)

_ITEMS = "(SELECT item_id || '.png' AS path, text, '' AS note FROM benchmark)"
_IMAGE_HIT = "'- 区域 ' || line || ' | 关键词 `' || keyword || '` | ' || content"
REPORT_IMAGE = (
    f"WITH {_target_hits(_ITEMS, 'path', 'text', PAGE_FUZZY, _IMAGE_HIT)} "
    + _report_rows(
        [
            _fixed(
                0, "c", q("# 图片涉密数据检查报告"), "''", q("## 检查摘要"), "''", q("| 项目 | 内容 |"),
                q("| --- | --- |"), q("| 检查模式 | 图片路径检查 |"), q(f"| 检查时间 | {CHECKED_AT} |"),
                "'| 扫描图片数 | ' || targets || ' |'", "'| 发现涉密图片数 | ' || hit_targets || ' |'",
                "'| 涉密数据总行数 | ' || hits || ' |'", "''", q("### 图片类型分布"), "''",
                q("| 类型 | 数量 |"), q("| --- | --- |"), "'| png | ' || targets || ' |'", "''",
                q("## 详细结果"), "''",
            ),
            _targets(
                "t",
                "list_concat(CASE WHEN target_no > 1 THEN [''] ELSE [] END, "
                "['### 图片 ' || target_no, '**目标：** ' || target], "
                "CASE WHEN n > 0 THEN list_concat(['- **涉密信息：** ' || n || ' 处'], found) "
                "ELSE ['未发现涉密数据。'] END)",
            ),
        ]
    )
)

def _md_head(title: str, *rows: str) -> str:
    return _fixed(
        0, "c", q(f"# {title}"), "''", q("## 检查摘要"), "''", q("| 项目 | 内容 |"), q("| --- | --- |"),
        *rows, "''", q("## 详细结果"), "''",
    )


_BLANK = "CASE WHEN target_no > 1 THEN [''] ELSE [] END"
_MD_FOUND = (
    "CASE WHEN n > 0 THEN list_concat(['- **涉密信息：** ' || n || ' 处'], found) ELSE ['未发现涉密数据。'] END"
)
REPORT_FILE_MD = (
    f"WITH {_target_hits(_DOC_FILES, 'path', 'text', TEXT_FUZZY, _MD_HIT)}, "
    "k AS (SELECT * REPLACE (row_number() OVER (ORDER BY target) AS target_no) FROM t WHERE n > 0) "
    + _report_rows(
        [
            _md_head(
                "文件涉密数据检查报告", q("| 检查方式 | 文件路径检查 |"), q(f"| 检查时间 | {CHECKED_AT} |"),
                "'| 检查文件数 | ' || targets || ' |'", "'| 发现涉密文件数 | ' || hit_targets || ' |'",
            ),
            _targets("k", f"list_concat({_BLANK}, ['### 文件：' || target, '- **类型：** text'], {_MD_FOUND})"),
        ]
    )
)
_AUDIO_MD_HIT = "'- 时间 ' || line || 's | 关键词 `' || keyword || '` | ' || content"
REPORT_AUDIO_MD = (
    f"WITH {_target_hits(_TURNS, 'path', 'text', PAGE_FUZZY, _AUDIO_MD_HIT)} "
    + _report_rows(
        [
            _md_head(
                "音频涉密数据检查报告", q("| 检查模式 | 音频路径检查 |"), q(f"| 检查时间 | {CHECKED_AT} |"),
                "'| 扫描音频数 | ' || targets || ' |'", "'| 发现涉密音频数 | ' || hit_targets || ' |'",
            ),
            _targets(
                "t", f"list_concat({_BLANK}, ['### 音频 ' || target_no, '**目标：** ' || target], {_MD_FOUND})"
            ),
        ]
    )
)
_IMAGE_TXT_HIT = "'    区域 ' || line || ' | 关键词 [' || keyword || '] → ' || content"
REPORT_IMAGE_TXT = (
    f"WITH {_target_hits(_ITEMS, 'path', 'text', PAGE_FUZZY, _IMAGE_TXT_HIT)} "
    + _report_rows(
        [
            _fixed(
                0, "c", _RULE, q(" " * 10 + "图片涉密数据检查报告"), _RULE, q("检查模式: 图片路径检查"),
                q(f"检查时间: {CHECKED_AT}"), "'扫描图片数: ' || targets", q("图片类型分布: "),
                "'   png: ' || targets", "'发现涉密图片数: ' || hit_targets", "'涉密数据总行数: ' || hits", _THIN,
            ),
            _targets(
                "t",
                "list_concat(['', '【图片 ' || target_no || '】' || target], "
                "CASE WHEN n > 0 THEN list_concat(['  涉密信息 (' || n || ' 处):'], found) "
                "ELSE ['  未发现涉密数据。'] END)",
            ),
            _fixed(2, "c", _RULE, q("报告结束")),
        ]
    )
)

REPORT_DB = (
    f"WITH {_HITS}, s AS ({_STATS}), c AS (SELECT count(*) AS targets, CAST(sum(hits) AS BIGINT) AS hits, "
    "count_if(affected) AS affected FROM s), "
    'k AS (SELECT "table", hits, row_number() OVER (ORDER BY "table") AS target_no FROM s WHERE affected) '
    + _report_rows(
        [
            _fixed(
                0, "c", _RULE, q(" " * 10 + "数据库涉密数据检查报告"), _RULE, q("数据库信息: tables"),
                q(f"检查时间: {CHECKED_AT}"), "'扫描表数: ' || targets", "'涉密数据条数: ' || hits",
                "'涉及表数: ' || affected", _THIN, q("详细结果："),
            ),
            _targets("k", "['', '【表名】' || \"table\" || ' (共 ' || hits || ' 条)']"),
            "SELECT 1, CAST(target_no AS BIGINT), CAST(10 AS BIGINT), "
            "concat_ws(chr(1), row_pk, \"column\", keyword, content), "
            "'  行 ' || row_pk || ' | 字段 ' || \"column\" || ' | 关键词 [' || keyword || '] → ' || content "
            'FROM h JOIN k USING ("table")',
            _fixed(2, "c", _RULE, q("报告结束")),
        ]
    )
)


REPORT_DB_MD = (
    f"WITH {_HITS}, s AS ({_STATS}), c AS (SELECT count(*) AS targets, CAST(sum(hits) AS BIGINT) AS hits, "
    "count_if(affected) AS affected FROM s), "
    'k AS (SELECT "table", hits, row_number() OVER (ORDER BY "table") AS target_no FROM s WHERE affected) '
    + _report_rows(
        [
            _md_head(
                "数据库涉密数据检查报告", q("| 数据库信息 | tables |"), q(f"| 检查时间 | {CHECKED_AT} |"),
                "'| 扫描表数 | ' || targets || ' |'", "'| 涉密数据条数 | ' || hits || ' |'",
                "'| 涉及表数 | ' || affected || ' |'",
            ),
            _targets(
                "k",
                f"list_concat({_BLANK}, ['### 表名：' || \"table\", '- **命中数：** 共 ' || hits || ' 条'])",
            ),
            "SELECT 1, CAST(target_no AS BIGINT), CAST(10 AS BIGINT), "
            "concat_ws(chr(1), row_pk, \"column\", keyword, content), "
            "'- 行 `' || row_pk || '` | 字段 `' || \"column\" || '` | 关键词 `' || keyword || '` | ' || content "
            'FROM h JOIN k USING ("table")',
        ]
    )
)


def _kind_total(kind: str, source: str, keys: str, text: str, config: ScanConfig) -> str:
    return (
        f"SELECT {q(kind)} AS kind, (SELECT count(*) FROM {source}) AS sources, "
        f"(SELECT count(*) FROM ({hit_rows(source, keys, text, config)})) AS hits"
    )


OVERVIEW = (
    f"WITH {_HITS}, o AS ("
    + " UNION ALL ".join(
        [
            _kind_total("web", PAGE_TEXTS, "url", "text", PAGE_FUZZY),
            _kind_total("file", "documents", "doc_id", "text", TEXT_FUZZY),
            _kind_total("image", "benchmark", "item_id", "text", PAGE_FUZZY),
            _kind_total("audio", "conversations", "conv_id, turn", "text", PAGE_FUZZY),
            'SELECT \'db\', 1, (SELECT count(*) FROM (SELECT DISTINCT "table", row_no FROM h))',
        ]
    )
    + ") SELECT kind, sources, hits FROM o UNION ALL "
    "SELECT 'total', CAST(sum(sources) AS BIGINT), CAST(sum(hits) AS BIGINT) FROM o"
)

def _quoted_targets(section: int, source: str, key: str, config: ScanConfig) -> str:
    """Targets of one kind in the combined report, with their hits quoted."""
    first = (
        "'        → 第 ' || line || ' 行：关键词“' || keyword || '”，匹配内容“' || matched_text || '”'"
    )
    second = "'          原文：' || content"
    quoted = f"CASE WHEN content <> '' THEN [{first}, {second}] ELSE [{first}] END"
    listed = (
        "list_concat(['    ' || target_no || '. 来源：' || target], CASE WHEN n > 0 THEN "
        "list_concat(['      发现 ' || n || ' 处涉密信息：'], found) ELSE ['      无涉密内容'] END, [''])"
    )
    return (
        f"SELECT {section} AS section, target_no, generate_subscripts(ls, 1) - 1 AS seq, "
        f"'' AS sort_key, unnest(ls) AS line FROM (SELECT target_no, {listed} AS ls FROM ("
        f"SELECT s.{key} AS target, coalesce(n, 0) AS n, coalesce(found, []) AS found, "
        f"row_number() OVER (ORDER BY s.{key}) AS target_no FROM {source} s LEFT JOIN ("
        f"SELECT {key}, count(*) AS n, flatten(list({quoted} ORDER BY line)) AS found "
        f"FROM ({hit_rows(source, key, 'text', config)}) GROUP BY {key}) USING ({key})))"
    )


def _kind_heading(section: int, words: str) -> str:
    return _fixed(section, "(SELECT 1)", q(f"  ── {words} ──"), "''")


def _box_row(words: str, kind: str) -> str:
    return (
        f"'  │ ' || rpad({q(words)}, 21, ' ') || ' │ ' || rpad(CAST({kind}_n AS VARCHAR), 9, ' ') "
        f"|| ' │ ' || rpad(CAST({kind}_hits AS VARCHAR), 9, ' ') || ' │'"
    )


_COMBINED_TOTALS = (
    "n AS (SELECT (SELECT count(*) FROM pages) AS web_n, "
    f"(SELECT count(*) FROM ({hit_rows(PAGE_TEXTS, 'url', 'text', PAGE_FUZZY)})) AS web_hits, "
    "(SELECT count(*) FROM conversations) AS audio_n, "
    f"(SELECT count(*) FROM ({hit_rows(_TURNS, 'path', 'text', PAGE_FUZZY)})) AS audio_hits, "
    '1 AS db_n, (SELECT count(*) FROM (SELECT DISTINCT "table", row_no FROM h)) AS db_hits)'
)
_FIELD_LINE = "'          字段 ''' || \"column\" || ''' 包含涉密文本（例如：' || samples || '）'"
_TABLE_LINES = (
    'SELECT row_number() OVER (ORDER BY r."table") + 1 AS target_no, list_concat('
    "['        • 表 ' || r.\"table\" || '：总计 ' || r.total_rows || ' 行，涉密 ' || coalesce(sr, 0) "
    "|| ' 行'], coalesce(fl, [])) AS ls FROM r LEFT JOIN (SELECT \"table\", "
    f"any_value(sensitive_rows) AS sr, list({_FIELD_LINE} ORDER BY \"column\") AS fl "
    'FROM f GROUP BY "table") USING ("table")'
)
REPORT_COMBINED = (
    f"WITH {_HITS}, {_COMBINED_TOTALS}, f AS ({_FIELDS}), tl AS ({_TABLE_LINES}) "
    + _report_rows(
        [
            _fixed(
                0, "n", _WIDE, q("        涉密信息检查报告"), _WIDE, q(f"生成时间：{CHECKED_AT}"), "''",
                q("【一、总览】"), q("  检查类型：web, audio, db"),
                "'  检查目标总数：' || (web_n + audio_n + db_n)",
                "'  发现涉密信息条目总数：' || (web_hits + audio_hits + db_hits)", "''",
                q("  ┌───────────────────────┬───────────┬───────────┐"),
                q("  │ 类型                  │ 目标数量  │ 涉密条目  │"),
                q("  ├───────────────────────┼───────────┼───────────┤"),
                _box_row("网页", "web"), _box_row("音频", "audio"), _box_row("数据库", "db"),
                q("  └───────────────────────┴───────────┴───────────┘"),
                "''", q("【二、详细结果】"), "''",
            ),
            _kind_heading(1, "🌐 网页"),
            _quoted_targets(1, PAGE_TEXTS, "url", PAGE_FUZZY),
            _kind_heading(4, "🎵 音频"),
            _quoted_targets(4, _TURNS, "path", PAGE_FUZZY),
            _kind_heading(5, "🗄️ 数据库"),
            "SELECT 5, 1, unnest([0, 1]), '', unnest(['    1. 来源：tables', "
            "'      共检查 ' || (SELECT count(*) FROM r) || ' 个表：'])",
            "SELECT 5, target_no, generate_subscripts(ls, 1) - 1, '', unnest(ls) FROM tl",
            "SELECT 5, 2147483647, 0, '', ''",
            _fixed(
                7, "n", q("【三、结论与建议】"),
                "'   ⚠️ 共发现 ' || (web_hits + audio_hits + db_hits) || ' 处涉密信息，请立即核查并处理。'",
                q("   建议："), q("     1. 对涉密文件/数据进行脱敏或隔离；"),
                q("     2. 修改相关权限设置，限制访问；"), q("     3. 提交审计追踪，追究责任。"),
                "''", _WIDE, q("报告结束"), _WIDE,
            ),
        ]
    )
)

# --- all -----------------------------------------------------------------------------------------

_SCAN_FUZZY, _ = line_keyword("raw", ScanConfig(PAGE_EXACT.keywords, "regex", 2))
_SCAN_EXACT, _ = line_keyword("raw", PAGE_EXACT)
_DOCUMENT_LINES = lines("documents", "doc_id", "text")
_TRIMMED = strip("text")
_NEEDS = ", ".join(
    f"list_min(list_transform(regexp_extract_all(lower(raw), {q(_re(k))}, 0), "
    f"lambda m: length(m) - {len(k)}))"
    for k in SWEEP_FUZZY.keyword_list
)
_WORDS = (
    "SELECT DISTINCT keyword FROM (SELECT unnest(string_split("
    "regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' ')) AS keyword FROM benchmark) "
    "WHERE keyword <> ''"
)
_PART_WORDS = (
    "SELECT keyword, min(p_partkey) * 100 + length(keyword) AS ord FROM "
    "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS keyword FROM part) GROUP BY keyword"
)


def _best_exact(words: str) -> str:
    return (
        f"SELECT doc_id, line, best.k AS keyword, {strip('raw')} AS content FROM ("
        "SELECT doc_id, line, any_value(raw) AS raw, "
        "min({'e': instr(raw, keyword) + length(keyword) - 1, 'n': -length(keyword), 'k': keyword}) "
        f"AS best FROM ({_DOCUMENT_LINES}) JOIN ({words}) ON contains(raw, keyword) "
        "GROUP BY doc_id, line)"
    )


_PATTERN = (
    "'(?s)' || array_to_string(regexp_extract_all(keyword, '(?s).'), '.*?')"
)
_KEYWORD_FUZZY = (
    f"SELECT doc_id, line, best.k AS keyword, {strip('raw')} AS content, best.m AS matched_text FROM ("
    "SELECT doc_id, line, any_value(raw) AS raw, min({'o': ord, 'k': keyword, 'm': m}) AS best FROM ("
    "SELECT doc_id, line, raw, ord, keyword, list_filter(regexp_extract_all(lower(raw), "
    f"{_PATTERN}, 0), lambda x: length(x) <= length(keyword) + 1)[1] AS m "
    f"FROM ({_DOCUMENT_LINES}), ({_PART_WORDS})) WHERE m IS NOT NULL GROUP BY doc_id, line)"
)

_OFFICE_SUFFIX = "(['docx', 'xlsx', 'pptx'])[(doc_id % 3 + 1)::INT]"
_KEPT_LINES = "list_filter(string_split(text, chr(10)), lambda l: l <> '')"
_OFFICE_TEXT = (
    "CASE WHEN doc_id % 3 = 2 THEN array_to_string(list_transform("
    f"list_filter({_KEPT_LINES}, lambda l: trim(l) <> ''), lambda l, i: '===== Slide ' || i || ' =====' "
    f"|| chr(10) || {strip('l')}), chr(10)) ELSE array_to_string({_KEPT_LINES}, chr(10)) END"
)
_OFFICE_DOCS = (
    f"(SELECT doc_id || '.' || {_OFFICE_SUFFIX} AS path, {_OFFICE_SUFFIX} AS file_type, "
    f"{_OFFICE_TEXT} AS text FROM documents)"
)

_PAGE_FILES = f"(SELECT url, {_fp(PAGE_FUZZY).replace('text', 'html')} AS fp, text FROM pages JOIN {PAGE_TEXTS} USING (url))"

def _every_keyword(config: ScanConfig) -> str:
    """Each keyword on its own over the documents."""
    return " UNION ALL ".join(
        f"SELECT * FROM ({hit_rows('documents', 'doc_id', 'text', ScanConfig((k,), config.algorithm, config.max_insert))})"
        for k in config.keyword_list
    )


ORACLES = {
    "src_text_table": summed("benchmark", "item_id", "text", PAGE_EXACT),
    "src_pages": "SELECT url, any_value(length(html)) AS n_chars FROM pages GROUP BY url",
    "src_tables": TABLE_ROWS,
    "sink_report": f"SELECT line FROM ({REPORT_TXT})",
    "split_lines": f"SELECT doc_id, line, raw AS content FROM ({_DOCUMENT_LINES})",
    "html_text": f"SELECT page_id, text FROM {PAGE_TEXTS}",
    "page_note": (
        "SELECT page_id, CASE WHEN text = '' THEN '无法读取页面内容' ELSE '' END AS note "
        f"FROM {PAGE_TEXTS}"
    ),
    "decode_text": "SELECT doc_id, text FROM documents",
    "ooxml_text": f"SELECT doc_id, doc_id || '.' || {_OFFICE_SUFFIX} AS path, {_OFFICE_TEXT} AS text FROM documents",
    "ooxml_scan": summed(_OFFICE_DOCS, "path", "text", TEXT_FUZZY, "file_type, '' AS note"),
    "content_trim": (
        f"SELECT doc_id, {_TRIMMED} AS content, left({_TRIMMED}, 200) AS table_content, "
        f"CASE WHEN length({_TRIMMED}) > 80 THEN left({_TRIMMED}, 80) || '...' ELSE {_TRIMMED} END "
        "AS excerpt FROM documents"
    ),
    "fuzzy_scan": hit_rows("documents", "doc_id", "text", TEXT_FUZZY),
    "exact_scan": hit_rows("documents", "doc_id", "text", TEXT_EXACT),
    "page_scan": hit_rows(PAGE_TEXTS, "url", "text", PAGE_FUZZY),
    "page_scan_exact": hit_rows(PAGE_TEXTS, "url", "text", PAGE_EXACT),
    "charset_prefilter": "SELECT "
    + ", ".join(
        "count(*) FILTER ("
        + " AND ".join(f"contains(lower(raw), {q(c)})" for c in dict.fromkeys(k))
        + f") AS lines_{k}"
        for k in TEXT_FUZZY.keyword_list
    )
    + f" FROM ({_DOCUMENT_LINES})",
    "scan": (
        f"SELECT conv_id, turn, line, {_SCAN_FUZZY} AS fuzzy_keyword, {_SCAN_EXACT} AS exact_keyword "
        f"FROM ({lines('conversations', 'conv_id, turn', 'text')})"
    ),
    "parse_keywords": (
        "SELECT p_partkey, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS ord FROM ("
        "SELECT p_partkey, list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' ,, ') "
        "|| ' , ' || p_brand, ','), lambda k: trim(k)), lambda k: k <> '') AS ks FROM part)"
    ),
    "full_check": summed("documents", "doc_id", "text", TEXT_EXACT, "coalesce(h.n, 0) AS total_danger_lines"),
    "scan_all_fuzzy": _every_keyword(TEXT_FUZZY),
    "scan_all_exact": _every_keyword(TEXT_EXACT),
    "max_insert_sweep": (
        "SELECT CAST(n AS BIGINT) AS max_insert, count(*) AS lines FROM "
        f"(SELECT list_min([{_NEEDS}]) AS need FROM ({_DOCUMENT_LINES})) JOIN range(0, 11) r(n) "
        "ON need <= n GROUP BY n"
    ),
    "keyword_table_scan": _best_exact(_WORDS),
    "keyword_table_short": _best_exact(_PART_WORDS),
    "keyword_table_fuzzy": _KEYWORD_FUZZY,
    "keyword_table_join": _KEYWORD_FUZZY,
    "file_type": f"SELECT doc_id, {FILE_TYPE} AS file_type FROM documents",
    "is_text": f"SELECT doc_id, {_readable('text')} AS is_text FROM documents",
    "ext_mismatch": f"SELECT doc_id, {MISMATCH} AS ext_mismatch FROM documents",
    "image_type": (
        f"SELECT doc_id, coalesce(image_type, 'unknown') AS image_type, image_type IS NOT NULL AS is_image "
        f"FROM (SELECT doc_id, {_cycle(_IMAGES, 'image_type')} FROM documents)"
    ),
    "audio_type": (
        "SELECT doc_id, audio_type, audio_type IS NOT NULL AS is_audio "
        f"FROM (SELECT doc_id, {_cycle(_AUDIO, 'audio_type')} FROM documents)"
    ),
    "is_hidden": "SELECT doc_id, n_chars % 2 = 0 AS is_hidden FROM documents",
    "zip_encryption": (
        "SELECT doc_id, doc_id % 4 <> 0 AND n_chars % 3 > 0 AS is_encrypted, "
        "doc_id % 4 <> 0 AND n_chars % 3 = 2 AS is_pseudo FROM documents"
    ),
    "file_note": (
        f"SELECT {_ZIP_PATH} AS path, concat_ws('，', CASE WHEN n_chars % 2 = 0 THEN '隐藏文件' END, "
        "CASE WHEN doc_id % 4 <> 0 THEN CASE n_chars % 3 WHEN 1 THEN '加密' WHEN 2 THEN '伪加密' END END) "
        "AS note FROM documents"
    ),
    "upload_note": (
        f"SELECT {_ZIP_PATH} AS path, coalesce(CASE WHEN doc_id % 4 <> 0 THEN CASE n_chars % 3 "
        "WHEN 1 THEN '加密' WHEN 2 THEN '伪加密' END END, '') AS note FROM documents"
    ),
    "table_scan": _table_hits(TABLE_FUZZY),
    "table_scan_exact": _table_hits(TABLE_EXACT),
    "text_columns": f'SELECT "table", "column", count(*) AS cells FROM ({_cells()}) GROUP BY ALL',
    "row_key": (
        "SELECT 'part' AS \"table\", CAST(p_partkey AS VARCHAR) AS row_pk FROM part UNION ALL "
        "SELECT 'nation', md5(CAST(json_object('n_nationkey', CAST(n_nationkey AS VARCHAR), 'n_name', n_name, "
        "'n_regionkey', CAST(n_regionkey AS VARCHAR)) AS VARCHAR)) FROM nation"
    ),
    "table_stats": f"WITH {_HITS} {_STATS}",
    "scan_totals": (
        f"WITH {_HITS} SELECT count(*) AS tables_scanned, count(*) FILTER (affected) AS tables_affected, "
        f"CAST(sum(hits) AS BIGINT) AS hits FROM ({_STATS})"
    ),
    "field_stats": f"WITH {_HITS} {_FIELDS}",
    "extract_links": LINKS,
    "canonical_url": f"SELECT url, {_canonical('url')} AS canonical FROM pages",
    "same_site": (
        f"SELECT url, link, {_netloc('url')} AS site, {_netloc('link')} = {_netloc('url')} AS internal, "
        f"{_netloc('link')} = regexp_replace({_netloc('url')}, '^(m|blog)\\.', '') AS main_site "
        f"FROM ({LINKS})"
    ),
    "skip_ext": (
        f"SELECT url, {_skipped('url')} AS skipped, "
        f"{_skipped(_canonical('url') + chr(32) + '|| ' + q('/plan.PDF?v=1'))} AS named_skipped FROM pages"
    ),
    "frontier": (
        f"SELECT DISTINCT link, skipped FROM ({SITE_LINKS}) WHERE link NOT IN ({ALL_SEEDS})"
    ),
    "reachable": _reachable(SEEDS),
    "reachable_sizes": (
        f"SELECT {_netloc('url')} AS site, depth, count(*) AS addresses FROM ({_reachable(ALL_SEEDS)}) GROUP BY ALL"
    ),
    "fingerprint": (
        f"SELECT doc_id, {_fp(TEXT_FUZZY)} AS fp, 'file:' || {_fp(TEXT_EXACT)} AS file_key, "
        f"{_fp(TEXT_FUZZY, 'eng')} AS ocr_fp FROM documents"
    ),
    "reuse_results": (
        f"SELECT s.*, {_fp(TEXT_FUZZY)} AS fp FROM ({summed('documents', 'doc_id', 'text', TEXT_FUZZY)}) s "
        f"JOIN documents USING (doc_id) WHERE {_fp(TEXT_FUZZY)} IN ({_KNOWN})"
    ),
    "pending": (
        f"SELECT doc_id, {_fp(TEXT_FUZZY)} AS fp FROM documents WHERE {_fp(TEXT_FUZZY)} NOT IN ({_KNOWN})"
    ),
    "scan_incremental": (
        f"SELECT s.*, {_fp(TEXT_FUZZY)} IN ({_KNOWN}) AS reused FROM "
        f"({summed('documents', 'doc_id', 'text', TEXT_FUZZY)}) s JOIN documents USING (doc_id)"
    ),
    "stream_scan": (
        f"SELECT s.*, doc_id NOT IN ({_LABELLED}) AND {_fp(TEXT_FUZZY)} IN ({_KNOWN}) AS reused FROM "
        f"({summed('documents', 'doc_id', 'text', TEXT_FUZZY)}) s JOIN documents USING (doc_id)"
    ),
    "src_text_splits": (
        f"SELECT source, CAST(before + line AS BIGINT) AS line, keyword, content FROM "
        f"({hit_rows('documents', 'doc_id', 'text', TEXT_EXACT)}) JOIN (SELECT doc_id, source, coalesce(sum("
        "len(string_split(text, chr(10)))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) USING (doc_id)"
    ),
    "text_rescan": (
        f"SELECT *, true AS reused FROM ({summed('documents', 'doc_id', 'text', TEXT_FUZZY)})"
    ),
    "reuse_files": summed(
        f"(SELECT *, (head, body) IN (SELECT (doc_id % {len(_READABLE_TYPES) + 1}, text) FROM documents "
        f"WHERE doc_id IN ({_LABELLED})) AS reused FROM {_READABLE_FILES})",
        "path", "text", TEXT_EXACT, "file_type, is_hidden, ext_mismatch, note, reused",
    ),
    "file_scan": summed(_READABLE_FILES, "path", "text", TEXT_EXACT, "file_type, is_hidden, ext_mismatch"),
    "src_files": (
        "SELECT table_name || '.parquet' AS name, 'binary' AS file_type, false AS is_hidden, '' AS note "
        "FROM information_schema.tables WHERE table_schema = 'main'"
    ),
    "reuse_images": summed(
        _media(_IMAGES, "kind", "不是图片文件", "图片中未检测到文字", _TRIMMED),
        "path", "text", TEXT_FUZZY, "file_type, note, reused",
    ),
    "reuse_audio": summed(
        _media(_AUDIO, "'audio'", "不是音频文件", "语音识别未能提取文字", "text"),
        "path", "text", TEXT_FUZZY, "file_type, note, reused",
    ),
    "office_rescan": summed(
        _OFFICE_DOCS, "path", "text", TEXT_FUZZY,
        "file_type, false AS is_hidden, false AS ext_mismatch, '' AS note, true AS reused",
    ),
    "store_prune": (
        f"SELECT {_EVENT_KIND} AS kind, md5(props) AS fp, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS scanned_at "
        f"FROM events WHERE ts + to_seconds({_EVENT_TTL}) > TIMESTAMP '{STORE_AS_OF}' GROUP BY 1, 2"
    ),
    "page_rescan": (
        "SELECT s.*, CASE WHEN p.text = '' THEN '无法读取页面内容' ELSE '' END AS note, "
        f"true AS reused FROM ({summed(PAGE_TEXTS, 'url', 'text', PAGE_FUZZY)}) s "
        f"JOIN (SELECT url, text FROM {PAGE_TEXTS}) p USING (url)"
    ),
    "scan_unique": summed("documents", "doc_id", "text", TEXT_FUZZY),
    "ttl_filter": (
        f"SELECT event_id, {_EVENT_KIND} AS kind FROM events "
        f"WHERE ts + to_seconds({_EVENT_TTL}) > TIMESTAMP '{STORE_AS_OF}'"
    ),
    "latest_entries": (
        f"SELECT {_EVENT_KIND} AS kind, md5(props) AS fp, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS scanned_at "
        "FROM events GROUP BY 1, 2"
    ),
    "store_clear": (
        f"SELECT {_EVENT_KIND} AS kind, count(*) AS entries FROM events "
        "WHERE event_type <> 'click' GROUP BY 1"
    ),
    "page_store": (
        "SELECT s.*, CASE WHEN p.text = '' THEN '无法读取页面内容' ELSE '' END AS note, "
        f"starts_with(url, 'https:') AS reused FROM ({summed(PAGE_TEXTS, 'url', 'text', PAGE_FUZZY)}) s "
        f"JOIN (SELECT url, text FROM {PAGE_TEXTS}) p USING (url)"
    ),
    "source_summary": (
        "SELECT (SELECT count(*) FROM documents) AS targets, count(DISTINCT doc_id) AS hit_targets, "
        f"count(*) AS hits FROM ({hit_rows('documents', 'doc_id', 'text', TEXT_FUZZY)})"
    ),
    "type_distribution": (
        f"SELECT file_type, count(*) AS targets FROM (SELECT {FILE_TYPE} AS file_type FROM documents) GROUP BY 1"
    ),
    "overview": OVERVIEW,
    "hits_by_target": summed("documents", "doc_id", "text", TEXT_FUZZY),
    "line_list": (
        "SELECT d.doc_id, coalesce(l, '无') AS lines FROM documents d LEFT JOIN (SELECT doc_id, "
        "string_agg('第' || line || '行', '; ' ORDER BY line) AS l FROM "
        f"({hit_rows('documents', 'doc_id', 'text', TEXT_FUZZY)}) GROUP BY doc_id) h ON h.doc_id = d.doc_id"
    ),
    "sorted_targets": summed(PAGE_TEXTS, "url", "text", PAGE_FUZZY),
    "sample_topk": f"WITH {_HITS} {_SAMPLES}",
    "keyword_frequency": (
        "SELECT keyword, count(*) AS hits, count(DISTINCT doc_id) AS targets FROM "
        f"({hit_rows('documents', 'doc_id', 'text', TEXT_FUZZY)}) GROUP BY keyword"
    ),
    "verdict": (
        "SELECT source, CASE WHEN sum(n_hits) = 0 THEN '未发现涉密信息，安全可靠。' ELSE "
        "'共发现 ' || CAST(sum(n_hits) AS BIGINT) || ' 处涉密信息，请立即核查并处理。' END AS verdict FROM "
        f"({summed('documents', 'doc_id', 'text', TEXT_FUZZY)}) JOIN documents USING (doc_id) GROUP BY source"
    ),
    "image_scan": summed(_ITEMS, "path", "text", PAGE_FUZZY, "'png' AS file_type, note"),
    "audio_scan": summed(_TURNS, "path", "text", PAGE_FUZZY, "'audio' AS file_type, note"),
    "report_txt": REPORT_TXT,
    "report_md": REPORT_MD,
    "report_file": REPORT_FILE,
    "report_audio": REPORT_AUDIO,
    "report_image": REPORT_IMAGE,
    "report_file_md": REPORT_FILE_MD,
    "report_audio_md": REPORT_AUDIO_MD,
    "report_image_txt": REPORT_IMAGE_TXT,
    "report_db": REPORT_DB,
    "report_db_md": REPORT_DB_MD,
    "report_combined": REPORT_COMBINED,
    "store_stats": (
        f"WITH h AS ({hit_rows('documents', 'doc_id', 'text', TEXT_FUZZY)}), "
        f"d AS (SELECT {_fp(TEXT_FUZZY)} AS fp, min(doc_id) AS doc_id FROM documents "
        "WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1), "
        "e AS (SELECT doc_id, list({'line': line, 'keyword': keyword, 'content': content, "
        "'matched_text': matched_text} ORDER BY line) AS hits FROM h GROUP BY doc_id) "
        "SELECT count(*) AS total_entries, round(sum(strlen(CAST(to_json({'hits': coalesce(hits, []), "
        "'note': '', 'file_type': ''}) AS VARCHAR))) / 1048576, 2) AS size_mb "
        "FROM d LEFT JOIN e USING (doc_id)"
    ),
}
