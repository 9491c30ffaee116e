"""Checks of a whole manuscript: its kind, citations, acronyms and numbers, and the completeness of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import WORDS_LETTER, count_of, trimmed, unaccented
from foliolens.operators.structure import lines

# Words from which a text is read by chapters, references a batch, fields of a finding.
CHAPTERWISE, BATCH = 60_000, 20
FIELDS = ["finding_text", "severity", "confidence", "evidence", "location", "correction"]
#: A surname, what may follow it, and a year, with or without a bracket.
CITED = r"(\p{Lu}[\p{L}'’-]+)(?:,? et al\.?| (?:and|&|und|et|és) \p{Lu}[\p{L}'’-]+)?,? \(?((?:18|19|20)\d{2})"
ACRONYM = r"^[A-Z][A-Z0-9]{1,6}$"
NUMBER = r"\d+\.\d+"


def document_type(docs: DataFrame) -> DataFrame:
    """(doc_id, words, kind, by_chapter): a text of more than CHAPTERWISE words is a dissertation, read by chapters."""
    words = count_of(F.col("md"), WORDS_LETTER)
    long = F.col("words") > CHAPTERWISE
    return docs.where("md <> ''").select("doc_id", words.alias("words")).select("doc_id", "words", F.when(long, "dissertation").otherwise("article").alias("kind"), long.alias("by_chapter"))


def reference_batches(refs: DataFrame, size: int = BATCH) -> DataFrame:
    """(paper_id, ref_id, batch_no, pos): the references of a paper in batches of at most `size`, in their order."""
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("ref_index", "ref_id")) - 1
    return refs.select("paper_id", "ref_id", n.alias("n")).select("paper_id", "ref_id", (F.floor(F.col("n") / size) + 1).alias("batch_no"), (F.col("n") % size + 1).alias("pos"))


def first_surname(authors):
    """The first author's surname, folded, of a list as JSON or with semicolons; null for none.

    The words before a comma, else the last word of the name.
    """
    one = F.regexp_extract(authors, r"^\[?\s*\"?([^\";\]]*)", 1)
    name = F.when(one.contains(","), F.split(one, ",")[0]).otherwise(F.regexp_extract(F.trim(one), r"([^ ]+)$", 1))
    return F.nullif(unaccented(F.trim(name)), F.lit(""))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, surname, year): the distinct citations by author and year in a text, surnames folded."""
    all_of = lambda k: F.regexp_extract_all("md", F.lit(CITED), F.lit(k))
    each = docs.where("md <> ''").select("doc_id", F.explode(F.arrays_zip(all_of(1).alias("s"), all_of(2).alias("y"))).alias("c"))
    return each.select("doc_id", unaccented(F.col("c.s")).alias("surname"), F.col("c.y").alias("year")).distinct()


def citation_completeness(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, surname, year, cited, listed): citations and references by first author and year, on either side or both.

    docs: doc_id, md; refs: paper_id, authors, year. References without an author or year are left out.
    """
    cited = citations(docs).withColumnRenamed("doc_id", "paper_id").withColumn("cited", F.lit(True))
    year = F.regexp_extract("year", r"((?:18|19|20)\d{2})", 1)
    listed = refs.select("paper_id", first_surname(F.col("authors")).alias("surname"), year.alias("year")).where("surname is not null and year <> ''").distinct().withColumn("listed", F.lit(True))
    j = cited.join(listed, ["paper_id", "surname", "year"], "full")
    return j.select("paper_id", "surname", "year", F.coalesce("cited", F.lit(False)).alias("cited"), F.coalesce("listed", F.lit(False)).alias("listed"))


def self_citations(refs: DataFrame, own: DataFrame) -> DataFrame:
    """(paper_id, refs, own_refs, share): how many references have the paper's own author first.

    own: paper_id, authors. A paper without references has no row, one without authors of its own a share of 0.
    """
    mine = own.select("paper_id", first_surname(F.col("authors")).alias("surname")).where("surname is not null").distinct().withColumn("mine", F.lit(1))
    each = refs.select("paper_id", "ref_id", first_surname(F.col("authors")).alias("surname")).distinct()
    per = each.join(mine, ["paper_id", "surname"], "left").groupBy("paper_id").agg(F.count("*").alias("refs"), F.count("mine").alias("own_refs"))
    return per.withColumn("share", F.col("own_refs") / F.col("refs"))


def acronyms(docs: DataFrame) -> DataFrame:
    """(doc_id, acronym, first_line, defined_line, uses): words of capitals, and where one first stands in brackets.

    defined_line is null for one that never does.
    """
    word = F.regexp_extract_all("text", F.lit(r"\(?[\p{L}\p{N}_]+\)?"), F.lit(0))
    each = lines(docs).select("doc_id", "line_no", F.explode(word).alias("w")).withColumn("acronym", F.regexp_replace("w", r"[()]", "")).where(F.col("acronym").rlike(ACRONYM))
    boxed = F.col("w").startswith("(") & F.col("w").endswith(")")
    return each.groupBy("doc_id", "acronym").agg(F.min("line_no").alias("first_line"), F.min(F.when(boxed, F.col("line_no"))).alias("defined_line"), F.count("*").alias("uses"))


def number_check(docs: DataFrame) -> DataFrame:
    """(doc_id, number, line_no, in_table): the decimals of the text by first line, and whether a table of it has the same.

    A row of a table begins and ends with a pipe.
    """
    s = trimmed(F.col("text"))
    each = lines(docs).select("doc_id", "line_no", s.rlike(r"^\|.*\|$").alias("row"), F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("number"))
    per = each.groupBy("doc_id", "number").agg(F.min(F.when(~F.col("row"), F.col("line_no"))).alias("line_no"), F.max("row").alias("in_table"))
    return per.where("line_no is not null").select("doc_id", "number", "line_no", "in_table")


def finding_gaps(found: DataFrame) -> DataFrame:
    """found with `missing`, the required fields that are null or blank joined by commas, and `complete`."""
    absent = [F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in FIELDS]
    out = found.withColumn("missing", F.array_join(F.filter(F.array(*absent), lambda x: x.isNotNull()), ","))
    return out.withColumn("complete", F.col("missing") == "")
