"""Line and string expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a reported line (Unicode white space).
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Lengths of a shortened cell and of an excerpt, for display; hits and reports are whole.
TABLE_CONTENT_CHARS = 200
EXCERPT_CHARS = 80


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(STRIP_CHARS))


def lines_of(text: Column) -> Column:
    """All lines of a text. Only a line feed separates lines, trailing empty lines count."""
    return F.split(text, "\n", -1)


def table_content(col: Column) -> Column:
    return F.left(col, F.lit(TABLE_CONTENT_CHARS))


def excerpt(col: Column) -> Column:
    """The first 80 characters, marked when something was left out."""
    return F.when(
        F.length(col) > EXCERPT_CHARS, F.concat(F.left(col, F.lit(EXCERPT_CHARS)), F.lit("..."))
    ).otherwise(col)


def split_keywords(raw: Column) -> Column:
    """Keyword parsing as an expression, for lists that arrive as data."""
    return F.filter(F.transform(F.split(raw, ",", -1), strip), lambda k: k != "")


def md_cell(col: Column) -> Column:
    """Escape a value for a Markdown table cell."""
    return strip(F.replace(F.replace(col, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
