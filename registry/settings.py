"""Parameters shared by the queries and their SQL counterparts."""

from __future__ import annotations

from datetime import datetime

from lineward.config import ScanConfig

TEXT_FUZZY = ScanConfig("license,token,mit,apache,reserved,555", "regex", 3)
TEXT_EXACT = ScanConfig('License, token = ",@,MIT,Apache,555', "ac")
PAGE_FUZZY = ScanConfig("nicht,thing,###,pour", "regex", 1)
PAGE_EXACT = ScanConfig("The,nicht,***", "ac")
TABLE_FUZZY = ScanConfig("urgent,low,building,economy,anvil", "regex", 3)
TABLE_EXACT = ScanConfig("URGENT,LOW,BUILDING,ECONOMY,anvil,license", "ac")
KEYWORD_FUZZY = ScanConfig((), "regex", 1)
KEYWORD_EXACT = ScanConfig((), "ac")
SWEEP_FUZZY = ScanConfig("license,token,mit,555", "regex", 3)

CHECKED_AT = "2024-01-31 00:00:00"
STORE_SCANNED_AT = datetime(2024, 1, 30, 12, 0, 0)
STORE_AS_OF = datetime(2024, 1, 31, 0, 0, 0)

# The first key column of each table, where it has one.
TABLE_KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id",
}
TEXT_COLUMNS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}

# Kinds of stored result that the event types stand for in the lifetime query.
EVENT_KINDS = {"click": "web", "view": "file", "signup": "image", "purchase": "audio", "error": "db"}
