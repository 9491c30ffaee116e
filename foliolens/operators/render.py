"""Rendering of reports: language, title, classes, boxes, sanitizing."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.session import ship

# Words of Hungarian reports, allowed tags, attributes and schemes.
HUNGARIAN = ["bírálói vélemény", "összefoglalás", "értékelés", "főbb észrevételek", "kisebb észrevételek", "javaslat", "módszertan", "irodalomjegyzék", "hivatkozás"]
TAGS = set("a blockquote br code div em h1 h2 h3 h4 h5 h6 hr img li ol p pre span strong sub sup table tbody td th thead tr ul".split())
ATTRIBUTES = {"a": {"href", "title", "name"}, "img": {"src", "alt", "title"}}
SCHEMES = ("http", "https", "mailto")
SEVERITIES = ["Critical", "Major", "Minor", "Suggestion"]
VOID = {"br", "hr", "img"}


def language(col):
    """hu where two of the marker words occur, else en."""
    n = F.lit(0)
    for m in HUNGARIAN:
        n = n + F.lower(col).contains(m).cast("int")
    return F.when(n >= 2, "hu").otherwise("en")


def title(docs: DataFrame) -> DataFrame:
    """(doc_id, title): the first manuscript label or level 1 heading that is no report title, else Untitled."""
    p = r"(?m)^(?:\*\*(?:Manuscript|Kézirat):\*\*[ \t]*([^\n]*)|#[ \t]+((?!Referee Report)[^\n]+))$"
    a, b = F.regexp_extract("md", p, 1), F.regexp_extract("md", p, 2)
    return docs.where("md <> ''").select("doc_id", F.coalesce(F.nullif(F.trim(F.regexp_replace(F.concat(a, b), r"^\*+|\*+$", "")), F.lit("")), F.lit("Untitled")).alias("title"))


def enhanced(col):
    """Severity cells with classes, suggested corrections in boxes."""
    for s in SEVERITIES:
        col = F.replace(col, F.lit(f"<td>{s}</td>"), F.lit(f'<td class="severity-{s.lower()}">{s}</td>'))
    return F.regexp_replace(
        col,
        r"(?is)<p>\s*(Suggested (?:correction|rewrite):)\s*(.*?)\s*</p>",
        '<div class="correction"><span class="correction-label">$1</span><br/>$2</div>',
    )


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in TAGS:
            return
        ok = {"id", "class"} | ATTRIBUTES.get(tag, set())
        kept = []
        for k, v in attrs:
            v = v or ""
            scheme = "".join(v.split()).lower().partition(":")[0] if ":" in v.split("/")[0] else ""
            if k in ok and not (k in ("href", "src") and scheme and scheme not in SCHEMES):
                kept.append(f' {k}="{escape(v)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if tag in TAGS and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(escape(data, quote=False))


def sanitized_text(html: str | None) -> str | None:
    """html with the allowed tags, attributes and schemes; other tags go, their text stays."""
    if html is None:
        return None
    c = _Cleaner()
    c.feed(html)
    c.close()
    return "".join(c.out)


def sanitized(df: DataFrame, column: str, out: str = "html") -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(sanitized_text)

    return df.withColumn(out, clean(F.col(column)))


def markdown_html(col):
    """Headings, paragraphs, rules, emphasis, code and links of simple Markdown as HTML."""
    h = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for n in range(6, 0, -1):
        h = F.regexp_replace(h, rf"(?m)^#{{{n}}}[ \t]+(.+)$", f"<h{n}>$1</h{n}>")
    h = F.regexp_replace(h, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    h = F.regexp_replace(h, r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "<em>$1</em>")
    h = F.regexp_replace(h, r"`([^`\n]+)`", "<code>$1</code>")
    h = F.regexp_replace(h, r"!\[([^\]\n]*)\]\(([^)\s]+)\)", '<img alt="$1" src="$2">')
    h = F.regexp_replace(h, r"(?<!!)\[([^\]\n]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(h, r"(?m)^((?!<h\d>)[^\n]+)$", "<p>$1</p>")


def page(title_col, date_col, body_col):
    """A whole HTML page; title and date are escaped, the body is taken as it is."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<!doctype html><html><head><title>"), esc(title_col), F.lit("</title></head><body><p class=\"date\">"), esc(date_col), F.lit("</p>"), body_col, F.lit("</body></html>"))
