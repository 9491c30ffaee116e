"""Cleaning of converted texts, and what is counted in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions.text import WORDS_BLANK, count_of

# The line that a converter leaves at a page's end, blanks at a line's end, rows that rule a table.
SEPARATOR = r"(?m)^\s*---\s*end of page=\d+\s*---\s*$"
TRAILING = r"(?m)[ \t\r\f\x0b]+$"
TABLE_RULE = r"(?m)^\|[\s\-:|]+\|$"
HEADING = r"(?m)^#{1,6}\s+"


def without_separators(col):
    """The text without page separator lines."""
    return F.regexp_replace(col, "(?d)" + SEPARATOR, "")


def tidied(col):
    """Separators gone, four line breaks or more made three, no blanks at the ends of lines, one line break at the end."""
    short = F.regexp_replace(without_separators(col), r"\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(F.regexp_replace(short, "(?d)" + TRAILING, ""), r"\n\z", ""), F.lit("\n"))


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, md): the tidied texts; a null or empty text has no row."""
    return docs.where("md <> ''").select("doc_id", tidied(F.col("md")).alias("md"))


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, pages, words, sections, tables): page separators, words between blanks, headings, ruled tables."""
    md = F.col("md")
    return docs.where("md <> ''").select(
        "doc_id",
        count_of(md, "(?d)" + SEPARATOR).alias("pages"),
        count_of(md, WORDS_BLANK).alias("words"),
        count_of(md, "(?d)" + HEADING).alias("sections"),
        count_of(md, "(?d)" + TABLE_RULE).alias("tables"),
    )
