"""Bibliographies: the section, its entries, and the fields of an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import heading_label, trimmed
from foliolens.operators.structure import lines

# Labels of reference sections, institutions that begin entries, and the patterns of sections, entries and fields.
LABELS = ["references", "bibliography", "works cited", "literature cited", "cited references", "reference list"]
INSTITUTION = r"^(OECD(/European Commission)?|World Health Organization|World Bank|Eurostat|European Institute for Gender Equality)\s*\("
NEXT_SECTION = r"(?i)^#{1,3}\s+\S|^\*{1,2}[A-Z][A-Za-z ]+\*{1,2}\s*$|^(Appendix|Supplementary)\b.*$|^(Acknowledg(?:e)?ments?)\s*$"
CONTINUATION = r"(?i)^#{1,6}\s*\d+(\.\d+)?\.?\s*(\[[^\]]+\]\([^)]+\)|https?://\S+)?\s*$"
NUMBERED = r"^\s*(\[\d+\]|\d+\.\s|\(\d+\))\s*"
AUTHOR_START = r"^\p{L}[\p{L}\p{M}]+(\s+\p{L}[\p{L}\p{M}]+){0,3},"
NAME_YEAR = r"^\p{L}[^!?]{0,100}\((19|20)\d{2}[a-z]?\)"
EARLY_YEAR = r"\b(19|20)\d{2}[a-z]?\b"
INLINE = r"\.\s+([A-ZÀ-ÖØ-ÝŐŰ][A-Za-zÀ-ÖØ-öø-ÿŐőŰű'’-]+,\s+[A-ZÀ-ÖØ-ÝŐŰ]|OECD(?:/European Commission)?\s*\(|World Health Organization\s*\(|World Bank\s*\(|Eurostat\s*\(|European Institute for Gender Equality\s*\()"
YEAR = r"\b((?:19|20)\d{2})\b"
DOI = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,}/[^\s\])}>\"',;]+(?:\s+[^\s\])}>\"',;]+)*)"
SHORTEST = 15


def section(docs: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line): the last reference section of each document, to the next section or the end.

    A heading that holds only a number, or a number and a link, does not end it. Documents without one have no row.
    """
    s = trimmed(F.col("text"))
    marked = lines(docs).select(
        "doc_id",
        "line_no",
        heading_label(F.col("text")).isin(LABELS).alias("is_ref"),
        (s.rlike(NEXT_SECTION) & ~s.rlike(CONTINUATION)).alias("ends"),
    )
    w = Window.partitionBy("doc_id")
    start = F.max(F.when(F.col("is_ref"), F.col("line_no"))).over(w)
    return (
        marked.withColumn("start", start)
        .where("start is not null")
        .groupBy("doc_id", "start")
        .agg(
            F.min(F.when((F.col("line_no") > F.col("start")) & F.col("ends") & ~F.col("is_ref"), F.col("line_no"))).alias("next"),
            F.max("line_no").alias("last"),
        )
        .select("doc_id", (F.col("start") + 1).alias("start_line"), F.coalesce(F.col("next") - 1, "last").alias("end_line"))
    )


def entries(block: DataFrame) -> DataFrame:
    """(doc_id, entry_no, entry): the entries of reference blocks given as (doc_id, line_no, text).

    A marker, or an author and a year at a line's start, begins an entry; lines of one are
    joined by a blank; a line with several entries is cut before a surname; what begins
    like no entry goes to the one before; entries of 15 characters or fewer are dropped.
    """
    s = trimmed(F.col("text"))
    head = F.substring(s, 1, 120)
    cue = s.rlike(NUMBERED) | (~F.col("text").rlike(r"^[ \t]") & head.rlike(EARLY_YEAR) & (s.rlike(AUTHOR_START) | s.rlike(NAME_YEAR)))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = (
        block.where(s != "")
        .select("doc_id", "line_no", s.alias("s"), F.sum(F.when(cue, 1).otherwise(0)).over(w).alias("e1"))
        .groupBy("doc_id", "e1")
        .agg(F.expr("listagg(s, ' ') within group (order by line_no)").alias("entry"))
    )
    pieces = first.select("doc_id", "e1", F.posexplode(F.split(F.regexp_replace("entry", INLINE, ".\u0001$1"), "\u0001")).alias("p", "piece"))
    piece = trimmed(F.col("piece"))
    starts = piece.rlike(AUTHOR_START) | piece.rlike(INSTITUTION) | piece.rlike(NUMBERED)
    w2 = Window.partitionBy("doc_id").orderBy("e1", "p")
    return (
        pieces.where(piece != "")
        .select("doc_id", "e1", "p", piece.alias("piece"), F.sum(F.when(starts, 1).otherwise(0)).over(w2).alias("e2"))
        .groupBy("doc_id", "e2")
        .agg(F.expr("listagg(piece, ' ') within group (order by e1, p)").alias("entry"))
        .where(F.length("entry") > SHORTEST)
        .select("doc_id", F.col("e2").alias("entry_no"), "entry")
    )


def fields(entries_: DataFrame, key: str, text: str) -> DataFrame:
    """(key, authors, title, year, doi, journal) of single entries; what is missing is ''.

    Blanks and line breaks are collapsed first; a doi broken by blanks is joined.
    """
    t = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    clean = F.regexp_replace("t", NUMBERED, "")
    year = F.regexp_extract("t", YEAR, 1)
    head = F.regexp_replace(F.trim(F.split("c", YEAR)[0]), r"[(.,;]+$", "")
    upto = F.instr(F.col("c"), ".") - 1
    authors = F.when((F.col("year") != "") & F.length(head).between(6, 499), head).when(upto.between(6, 299), F.trim(F.substr(F.col("c"), F.lit(1), upto))).otherwise("")
    quoted = F.regexp_extract("c", "[\"“](.+?)[\"”]", 1)
    marked = F.regexp_extract("c", r"[*_](.+?)[*_]", 1)
    after = F.regexp_replace(F.regexp_extract("c", r"\b(?:19|20)\d{2}\b(.*)$", 1), r"^[ .)\],;:]+", "")
    dot = F.instr(after, ".") - 1
    title = (
        F.when(F.length(quoted) > 10, F.trim(quoted))
        .when(F.length(marked) > 10, F.trim(marked))
        .when((F.col("year") != "") & (dot > 10), F.trim(F.substr(after, F.lit(1), dot)))
        .otherwise("")
    )
    spans = F.regexp_extract_all("t", F.lit(r"[*_]([^*_]+)[*_]"), F.lit(1))
    journal = (
        F.when(F.size(spans) >= 2, F.trim(F.element_at(spans, 2)))
        .when((F.size(spans) == 1) & (F.length(F.element_at(spans, 1)) < 120), F.trim(F.element_at(spans, 1)))
        .otherwise("")
    )
    doi = F.regexp_replace(F.regexp_replace(F.regexp_extract("t", DOI, 1), r"[<>{} ]", ""), r"[.,;:)\]}'\"]+$", "")
    return (
        entries_.select(F.col(key), t.alias("t"))
        .where("t <> ''")
        .withColumn("c", clean)
        .withColumn("year", year)
        .select(key, authors.alias("authors"), title.alias("title"), "year", doi.alias("doi"), journal.alias("journal"))
    )


def repaired_doi(col):
    """A text whose dois have no blanks, neither behind their prefix nor inside."""
    joined = F.regexp_replace(F.regexp_replace(col, r"(?i)(https?://(?:dx\.)?doi\.org/)\s+", "$1"), r"(?i)\bdoi:\s+", "doi:")
    broken = F.regexp_extract_all(joined, F.lit(r"10\.\d{4,}/[A-Za-z0-9._;()/:-]+(?:\s+[A-Za-z0-9._;()/:-]+)+"), F.lit(0))
    return F.aggregate(broken, joined, lambda text, doi: F.replace(text, doi, F.regexp_replace(doi, r"\s+", "")))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, entry_no, authors, title, year, doi, journal, raw_text): the references of whole texts, from the section to the fields."""
    inside = lines(docs).join(section(docs), "doc_id").where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    found = entries(inside.select("doc_id", "line_no", "text")).withColumn("id", F.concat_ws("/", "doc_id", "entry_no"))
    return found.join(fields(found, "id", "entry"), "id").select("doc_id", "entry_no", "authors", "title", "year", "doi", "journal", F.col("entry").alias("raw_text"))


def choose(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """The entries of `main`, or those of `fallback` for a document where main has fewer than 3 and fallback more."""
    a = main.groupBy("doc_id").agg(F.count("*").alias("n_main"))
    b = fallback.groupBy("doc_id").agg(F.count("*").alias("n_back"))
    pick = a.join(b, "doc_id", "full").select(
        "doc_id", ((F.coalesce("n_main", F.lit(0)) < 3) & (F.coalesce("n_back", F.lit(0)) > F.coalesce("n_main", F.lit(0)))).alias("back")
    )
    return main.join(pick.where("not back"), "doc_id", "left_semi").unionByName(fallback.join(pick.where("back"), "doc_id", "left_semi"))
