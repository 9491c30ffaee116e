"""The inputs of the core queries, from the supplied tables. Copies of a row count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.operators.structure import lines
from foliolens.session import table

# Sentences that make rules hold or keep them from holding, dealt to documents by their number.
SEEDS = [
    "Title: scope. The paper does not aim to provide cross-country comparisons.\nIt refers to the international context.",
    "The development gender ratio paradox: changes in gender composition do not simply track increases in GDP per capita.",
    "We reject Hypothesis H 2 although trends in the share of female physicians are closely aligned.",
    "The United States and the United Kingdom are approaching parity by 2023. The sign is uniformly negative, see N/A cells.",
    "TITLE-ABS-KEY (effect)) was the query.\nThe patients were screened by two of us.",
    "PRISMA was followed and effects significantly promote trade.",
    "PRISMA was followed and effects significantly promote trade; risk of bias was assessed.",
    "Research other than articles was excluded.\nSee the Handbook of rules (pp. 12-19) by Springer.",
    "On the one hand this is a limitation. However, interpretation remains limited.",
    "On the one hand this is one. However, on the other hand it is not.",
    "Digital trade rules are studied in RQ1 and RQ2, and data-free flow clauses between the two countries.",
    "Digital trade rules, here defined as clauses, are studied in RQ1 and RQ2 by adding interactive items.",
    "Google Scholar returned 48 hits on the global network. VOSviewer shows a multi-centered network pattern.",
    "We coded the selected literature individually. It has been stagnant. Later, it gradually transitioned.",
    "We coded the selected literature individually with a codebook, only in isolated years.",
    "To interpret international differences we look on.\nOne more line.\nRegional specificities also include wages.",
    "| a<br>2 | b |\nIn the early days nothing was said.",
    "Nothing of note stands here.",
    "These are public-sector professions, predominantly publicly financed health systems. The distribution of regular income differs.",
    "Two of them (Hungary and Poland show the lowest, but still strong coefficients) stand out in gender-balanced labour markets with lower - but more rapidly increasing shares.",
    "The third category is Poisson Pseudo Maximum Likelihood. Centralization is high (Elsig & Klotz, 2022). These mechanisms work.",
    "The Report 2025 indicates that trade is expected to increase by a third to reach a peak in 2024.",
    "Here financial development may play a regulatory role in the division of the GVC division of labor.",
    "It provides a reference for the new Digital Partnership Agreement and is no longer limited to goods. However, it has evolved.",
    "It eases constraints by narrowing the gap in information and communication technology.",
]


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, md): the texts of original_converted."""
    return table(spark, d, "original_converted").where("extracted_text <> ''").select(F.col("paper_id").alias("doc_id"), F.col("extracted_text").alias("md")).distinct()


def seeded(spark: SparkSession, d: str, *shifts: int) -> DataFrame:
    """docs with one of SEEDS at the end for each shift, by default for 0."""
    seeds = F.array(*(F.lit(s) for s in SEEDS))
    at = lambda k: ((F.col("doc_id") + k) % len(SEEDS) + 1).cast("int")
    return docs(spark, d).select("doc_id", F.concat_ws("\n\n", "md", *(F.element_at(seeds, at(k)) for k in shifts or (0,))).alias("md"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, md): the texts beside sources from which they differ in five ways."""
    k = F.col("doc_id") % 5
    source = (
        F.when(k == 1, F.regexp_replace("md", r"(?m)^#{1,6}[ ]+", ""))
        .when(k == 2, F.concat("md", F.lit("\n"), F.repeat(F.lit("Extra words that the conversion lost here. "), 30)))
        .when(k == 3, F.concat(F.col("md"), F.lit("\n\n| a | b |\n\nmore text\n\n| c | d |\n\n| e | f |\n")))
        .when(k == 4, F.concat(F.lit("Another opening paragraph, long enough to matter here.\n\n"), "md"))
        .otherwise(F.col("md"))
    )
    return docs(spark, d).select("doc_id", source.alias("source"), "md")


def paged(spark: SparkSession, d: str) -> DataFrame:
    """docs with the page separators, blank lines and trailing blanks that a converter leaves."""
    tail = "  \n\n\n\n\n\n--- end of page=7 ---\n\n  --- end of page=8 ---  \n\n\n\nlast line \t\n\n"
    return docs(spark, d).select("doc_id", F.concat("md", F.lit(tail)).alias("md"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page_no, text): 40 lines a page; some pages are empty."""
    page = (F.floor((F.col("line_no") - 1) / 40) + 1).cast("int")
    p = lines(docs(spark, d)).groupBy("doc_id", page.alias("page_no")).agg(F.expr("listagg(text, '\\n') within group (order by line_no)").alias("text"))
    empty = (F.col("doc_id") % 7 == 0) | ((F.col("doc_id") % 3 == 0) & (F.col("page_no") % 2 == 0)) | ((F.col("doc_id") % 11 == 1) & (F.col("page_no") > 1))
    return p.select("doc_id", "page_no", F.when(empty, "").otherwise(F.col("text")).alias("text"))


def references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "original_references").select("ref_id", "paper_id", "ref_index", "title", "authors", "year", "doi", "journal", "raw_text").distinct()


def bibliography(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, text): the raw references of a paper, one after the other."""
    parts = references(spark, d).where("raw_text <> ''").select(F.col("paper_id").alias("doc_id"), "ref_index", F.posexplode(F.split("raw_text", "\n")).alias("p", "text"))
    return parts.select("doc_id", (F.col("ref_index").cast("bigint") * 1000 + F.col("p")).alias("line_no"), "text")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The earlier lookup's answers with tier and similarity between 0 and 1."""
    m = table(spark, d, "match_results").select("match_id", "ref_id", "found", "source", "title", "doi", "similarity", "year").distinct()
    s = F.coalesce("similarity", F.lit(0.0))
    return m.select(
        "match_id", "ref_id", F.coalesce("found", F.lit(False)).alias("found"), "source", F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(9)).alias("tier"),
        "title", "doi", F.when(s > 1, s / 100).otherwise(s).alias("similarity"), "year",
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_records").select("record_id", "tier", "title", "authors", "year", "doi", "venue").distinct()
