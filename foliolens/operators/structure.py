"""Lines, sections and their routing.

A document is (doc_id, md). Null and empty texts have no lines and no sections; a
document must come once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import WORDS_CLASS, WORDS_LETTER, contains_any, count_of, trimmed, unaccented

# Tokens of section headings, accents folded.
REFERENCES = ["references", "bibliography", "irodalom", "hivatkozas"]
ABSTRACT = ["abstract", "osszefoglalo"]
INTRODUCTION = ["introduction", "bevezetes"]
METHODS = ["method", "methodology", "identification", "modszertan"]
RESULTS = ["result", "results", "findings", "eredmeny", "eredmenyek"]
CONCLUSION = ["conclusion", "discussion", "kovetkeztetes"]
LITERATURE = ["literature", "related work", "background", "irodalom", "elmeleti hatter"]
ECONOMETRICS = ["method", "methodology", "model", "identification", "estimation", "regression"]
PLAIN_TITLES = r"(?i)^(Abstract|Introduction|Literature(\s+background)?|Materials\s+and\s+methods|Methods|Results|Discussion|Conclusions?|References|Bibliography|Appendix)\s*$"
GROUP_SIZE = 3


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines from 1; one final line break ends the last line."""
    parts = F.split(F.regexp_replace("md", r"\n\z", ""), "\n")
    return docs.where("md <> ''").select("doc_id", F.posexplode(parts).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line_no"), "text")


def chunk_map(docs: DataFrame) -> DataFrame:
    """The sections by headings of level 1 to 3: id, heading, level, lines, words and five tags.

    Text before the first heading is in no section; a document without headings is one.
    """
    stripped = trimmed(F.col("text"))
    heads = lines(docs).withColumn("mark", F.regexp_extract(stripped, r"^(#{1,3})\s+(.+?)\s*$", 1)).withColumn(
        "title", F.regexp_extract(stripped, r"^(#{1,3})\s+(.+?)\s*$", 2)
    )
    w = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = heads.withColumn("no", F.sum(F.when(F.col("mark") != "", 1).otherwise(0)).over(w)).withColumn(
        "headed", F.max(F.col("mark") != "").over(Window.partitionBy("doc_id"))
    )
    text = F.col("text")
    return (
        numbered.where((F.col("no") > 0) | ~F.col("headed"))
        .groupBy("doc_id", "no")
        .agg(
            F.min_by("title", "line_no").alias("title"),
            F.min_by(F.length("mark"), "line_no").alias("level"),
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.sum(count_of(text, WORDS_LETTER)).alias("words"),
            F.max(text.contains("$") | text.contains("\\(") | text.contains("\\[")).alias("has_equations"),
            F.max(text.rlike(r"^\s*\|.+\|\s*$")).alias("has_tables"),
            F.max(text.contains("![") | text.rlike(r"(?i)^\s*figure\s+\d+")).alias("has_figures"),
        )
        .withColumn("heading", F.when(F.col("no") == 0, "Document").otherwise(F.col("title")))
        .withColumn("label", unaccented(F.col("heading")))
        .select(
            "doc_id",
            F.greatest("no", F.lit(1)).cast("int").alias("chunk_no"),
            F.concat(F.lit("c"), F.greatest("no", F.lit(1))).alias("chunk_id"),
            "heading",
            "level",
            "start_line",
            "end_line",
            "words",
            "has_equations",
            "has_tables",
            "has_figures",
            contains_any(F.col("label"), REFERENCES).alias("is_references"),
            contains_any(F.col("label"), ABSTRACT).alias("is_abstract"),
        )
    )


def single_chunks(docs: DataFrame) -> DataFrame:
    """The map of the mode without sections: one chunk a document, assigned to every dimension."""
    ls = lines(docs)
    return ls.groupBy("doc_id").agg(
        F.lit("c1").alias("chunk_id"),
        F.lit("Document").alias("heading"),
        F.lit(0).alias("level"),
        F.lit(1).alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.sum(count_of(F.col("text"), WORDS_LETTER)).alias("words"),
    )


def page_chunks(pages: DataFrame) -> DataFrame:
    """One chunk a page of (doc_id, page_no, text): level 0, the first line of text up to 120 characters as heading."""
    parts = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "")
    n = F.size(F.split("text", "\n"))
    return pages.select(
        "doc_id",
        F.concat(F.lit("p"), "page_no").alias("chunk_id"),
        F.coalesce(F.substring(F.get(parts, F.lit(0)), 1, 120), F.concat(F.lit("Page "), "page_no")).alias("heading"),
        F.lit(0).alias("level"),
        F.lit(1).alias("start_line"),
        F.greatest(F.lit(1), n).alias("end_line"),
        count_of(F.col("text"), WORDS_LETTER).alias("words"),
        F.col("page_no").alias("page_start"),
        F.col("page_no").alias("page_end"),
    )


def _ids(cond):
    return F.array_sort(F.collect_list(F.when(cond, F.col("chunk_no"))))


def section_pairs(chunks: DataFrame) -> DataFrame:
    """(doc_id, first_id, second_id): introduction and methods with the last two results, abstract with the
    last conclusion; where there is none, the first section with the last."""
    label = unaccented(F.col("heading"))
    per = chunks.groupBy("doc_id").agg(
        _ids(contains_any(label, INTRODUCTION)).alias("intro"),
        _ids(contains_any(label, METHODS)).alias("methods"),
        _ids(contains_any(label, RESULTS)).alias("results"),
        _ids(F.col("is_abstract")).alias("abstract"),
        _ids(contains_any(label, CONCLUSION)).alias("conclusion"),
        F.min("chunk_no").alias("lo"),
        F.max("chunk_no").alias("hi"),
    )
    last_two = F.slice("results", F.greatest(F.lit(1), F.size("results") - 1), 2)
    # F.slice starts at 1 of an empty array as well
    cross = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))
    one = lambda c: F.slice(c, 1, 1)
    end = F.slice("conclusion", F.greatest(F.lit(1), F.size("conclusion")), 1)
    found = F.array_distinct(
        F.filter(F.concat(cross(one("intro"), last_two), cross(one("methods"), last_two), cross(one("abstract"), end)), lambda p: p["a"] != p["b"])
    )
    fallback = F.filter(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))), lambda p: p["a"] != p["b"])
    return (
        per.withColumn("found", found)
        .select("doc_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(fallback)).alias("p"))
        .select("doc_id", F.concat(F.lit("c"), "p.a").alias("first_id"), F.concat(F.lit("c"), "p.b").alias("second_id"))
    )


def chunk_groups(chunks: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """(doc_id, group_no, pos, chunk_id): the sections in tumbling groups; a size below 1 counts as 1."""
    size = max(1, size)
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1
    return chunks.withColumn("rn", rn).select(
        "doc_id", (F.floor(F.col("rn") / size) + 1).cast("int").alias("group_no"), (F.col("rn") % size + 1).cast("int").alias("pos"), "chunk_id"
    )


def dimension_assignments(chunks: DataFrame) -> DataFrame:
    """(doc_id, dimension, group_no, pos, chunk_id): which sections each review dimension reads."""
    label = unaccented(F.col("heading"))
    c = chunks.withColumns(
        {
            "empirical": F.col("has_tables") | F.col("has_figures"),
            "econ": contains_any(label, ECONOMETRICS),
            "lit": contains_any(label, LITERATURE),
        }
    ).withColumn("any_econ", F.max("econ").over(Window.partitionBy("doc_id")))
    dims = F.array(
        F.when(F.col("has_equations"), F.lit("math-logic")),
        F.when(F.col("empirical"), F.lit("empirical")),
        F.when(F.col("econ") | (~F.col("any_econ") & F.col("empirical")), F.lit("econometrics")),
        F.when(F.col("lit"), F.lit("literature")),
        F.when(F.col("is_references"), F.lit("references")),
    )
    flat = c.select("doc_id", "chunk_no", "chunk_id", F.explode(F.filter(dims, lambda d: d.isNotNull())).alias("dimension"))
    rn = F.row_number().over(Window.partitionBy("doc_id", "dimension").orderBy("chunk_no"))
    flat = flat.withColumn("pos", rn).select("doc_id", "dimension", F.lit(1).alias("group_no"), "pos", "chunk_id")
    grouped = chunk_groups(chunks).select(
        "doc_id", F.explode(F.array(*(F.lit(d) for d in ("notation", "exposition", "language")))).alias("dimension"), "group_no", "pos", "chunk_id"
    )
    pairs = section_pairs(chunks)
    order = Window.partitionBy("doc_id").orderBy("first_id", "second_id")
    pairs = pairs.withColumn("group_no", F.row_number().over(order)).select(
        "doc_id", F.lit("cross-section").alias("dimension"), "group_no", F.posexplode(F.array("first_id", "second_id")).alias("p", "chunk_id")
    ).select("doc_id", "dimension", "group_no", (F.col("p") + 1).alias("pos"), "chunk_id")
    return flat.unionByName(grouped).unionByName(pairs)


def recovered_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines with plain section titles made headings, where a blank line stands beside them."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = trimmed(F.col("text"))
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\.\s+(.+?)\s*$", 1)
    title = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\.\s+(.+?)\s*$", 2)
    level = F.least(F.lit(4), F.size(F.split(number, r"\.")) + 1)
    free = (F.length(s) <= 120) & (
        (F.coalesce(trimmed(F.lag("text").over(w)), F.lit("")) == "") | (F.coalesce(trimmed(F.lead("text").over(w)), F.lit("")) == "")
    )
    return lines(docs).select(
        "doc_id",
        "line_no",
        F.when(s == "", "")
        .when(s.rlike(r"^#{1,6}\s+"), s)
        .when(free & (number != "") & title.rlike(r"\p{L}"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(". "), title))
        .when(free & s.rlike(PLAIN_TITLES), F.concat(F.lit("## "), s))
        .otherwise(F.regexp_replace("text", r"[ \t\r]+$", ""))
        .alias("text"),
    )


def sentences_of(col, least: int = 10):
    """The rough sentences of a text of at least so many words, an array of (pos, sentence)."""
    parts = F.split(F.regexp_replace(col, r"([.!?])\s+", "$1\u0001"), "\u0001")
    each = F.transform(parts, lambda s, k: F.struct((k + 1).alias("pos"), trimmed(s).alias("sentence")))
    return F.filter(each, lambda x: count_of(x["sentence"], WORDS_CLASS) >= least)


def sentences(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, pos, sentence): rough sentences of at least so many words, after . ! ? and blanks."""
    return docs.where("md <> ''").select("doc_id", F.inline(sentences_of(F.col("md"), least)))


def paragraphs_of(col) -> tuple:
    """The first and the last paragraph of more than 20 characters and 5 words, the last before a reference word; '' for none."""

    def good(text):
        return F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: (F.length(p) > 20) & (count_of(p, WORDS_CLASS) >= 5))

    first, last = good(col), good(F.split(col, r"(?i)\b(?:References|Bibliography|Works\s+Cited)\b")[0])
    return F.coalesce(F.get(first, F.lit(0)), F.lit("")), F.coalesce(F.when(F.size(last) > 0, F.element_at(last, -1)), F.lit(""))


def paragraph_bounds(docs: DataFrame) -> DataFrame:
    """(doc_id, first_paragraph, last_paragraph): of more than 20 characters and 5 words; the last before a reference word."""
    first, last = paragraphs_of(F.col("md"))
    return docs.where("md <> ''").select("doc_id", first.alias("first_paragraph"), last.alias("last_paragraph"))


def paragraph_words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, last_line, words): the paragraphs, runs of lines that are not blank, by their first line; a heading begins one."""
    s = trimmed(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = (s == "") | s.rlike(r"^#{1,3}\s+\S")
    run = lines(docs).withColumns({"blank": s == "", "run": F.sum(starts.cast("int")).over(w)})
    words = F.sum(count_of(F.col("text"), WORDS_LETTER))
    return run.where(~F.col("blank")).groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last_line"), words.alias("words")).drop("run")


def bounded_pieces(chunks: DataFrame, line_words: DataFrame, target: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_id, piece, start_line, end_line): sections cut at lines once `target` words are passed, each
    piece reaching back over the lines that hold the last `overlap` words.

    line_words: doc_id, line_no, words. A line is never cut. With a column last_line the rows are paragraphs, as
    `paragraph_words` gives them, and cuts are at paragraphs only.
    """
    if "last_line" not in line_words.columns:
        line_words = line_words.withColumn("last_line", F.col("line_no"))
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("line_no")
    inside = chunks.select("doc_id", "chunk_id", "start_line", "end_line").join(line_words, "doc_id").where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    before = inside.withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    piece = before.withColumn("piece", F.floor(F.col("before") / target) + 1)
    own = piece.groupBy("doc_id", "chunk_id", "piece").agg(F.min("line_no").alias("first_line"), F.max("last_line").alias("end_line"), F.min("before").alias("from_word"))
    reach = before.select("doc_id", "chunk_id", F.col("line_no").alias("l"), (F.col("before") + F.col("words")).alias("upto"))
    back = own.join(reach, ["doc_id", "chunk_id"]).where((F.col("upto") > F.col("from_word") - overlap) & (F.col("l") <= F.col("first_line")))
    return back.groupBy("doc_id", "chunk_id", "piece", "end_line").agg(F.min("l").alias("start_line")).select(
        "doc_id", "chunk_id", F.col("piece").cast("int").alias("piece"), "start_line", "end_line"
    )
