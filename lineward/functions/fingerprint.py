"""Content fingerprints: the same content under the same configuration has the same key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineward.config import ScanConfig


def fingerprint(content: Column, config: ScanConfig, extractor: str = "") -> Column:
    """MD5 of the content bytes followed by the configuration; text counts as its UTF-8 bytes."""
    key = F.encode(F.lit(config.fingerprint_key(extractor)), "UTF-8")
    return F.md5(F.concat(content.cast("binary"), key))


def store_key(kind: str, content: Column, config: ScanConfig, extractor: str = "") -> Column:
    return F.concat(F.lit(f"{kind}:"), fingerprint(content, config, extractor))
