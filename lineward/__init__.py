"""Keyword scanning of texts, pages, files and tables on Spark."""

from lineward.config import DEFAULT_KEYWORDS, ScanConfig, parse_keywords

__all__ = ["DEFAULT_KEYWORDS", "ScanConfig", "parse_keywords"]
