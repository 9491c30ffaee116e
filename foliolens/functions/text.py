"""Column expressions on text. All are built-in expressions; nulls give nulls."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of the three word counters.
WORDS_BLANK = r"[^\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORDS_LETTER = r"[\p{L}\p{N}_]+"
WORDS_CLASS = r"[A-Za-z0-9\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}'-]+"
OUTSIDE_CLASS = r"[^a-z0-9\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF} ]+"
TRIMMED = r"^[ \t\r\n]+|[ \t\r\n]+$"

_FOLD = {
    chr(c): unicodedata.normalize("NFD", chr(c))[0]
    for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))
    if len(unicodedata.normalize("NFD", chr(c))) > 1
}
FOLD_FROM, FOLD_TO = "".join(_FOLD), "".join(_FOLD.values())


def count_of(col: Column, pattern: str) -> Column:
    """How many times pattern matches."""
    return F.size(F.regexp_extract_all(col, F.lit(pattern), F.lit(0))).cast("bigint")


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, TRIMMED, "")


def comparable(col: Column) -> Column:
    """Lower case, everything outside Latin, Greek and Cyrillic letters and figures a blank, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), OUTSIDE_CLASS, " "), r"\s+", " "))


def loose(col: Column) -> Column:
    """Lower case, everything but letters, figures and _ a blank, collapsed."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]+", " "))


def unaccented(col: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(col), FOLD_FROM, FOLD_TO)


def slug(col: Column) -> Column:
    """Letters and figures of ASCII joined by hyphens, `paper` where nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " "))
    return F.coalesce(F.nullif(F.replace(s, F.lit(" "), F.lit("-")), F.lit("")), F.lit("paper"))


def heading_label(col: Column) -> Column:
    """A heading without marks, number (a final dot included) and upper case Roman numeral, in lower case."""
    s = F.regexp_replace(trimmed(col), r"^#{1,6}\s*", "")
    s = F.regexp_replace(s, r"\*\*|__|\*|_", "")
    s = F.regexp_replace(s, r"^\d+(?:\.\d+)*\.?\s*", "")
    s = F.regexp_replace(s, r"^\(?[IVXLCDM]+\)?\.?\s+", "")
    return F.lower(trimmed(F.regexp_replace(s, r"\s+", " ")))


def contains_any(col: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | col.contains(t)
    return out


def safe_float(col: Column) -> Column:
    """A number, or null where there is none."""
    return F.trim(col.cast("string")).try_cast("double")


def percent(share: Column, digits: int = 0) -> Column:
    """A share as a percentage, n/a for null."""
    return F.when(share.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", share.cast("double") * 100))


def day(moment: Column) -> Column:
    """The day of a time, as 2024-05-31."""
    return F.date_format(moment, "yyyy-MM-dd")
