"""Entry points over whole corpora: preparing reviews, and functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions.text import slug
from foliolens.operators import bibliography, compare, fidelity, lint, matching, render, structure, workspace
from foliolens.session import ship


def prepare_reviews(docs: DataFrame, sources: DataFrame, answers: DataFrame, day: str = "") -> dict[str, DataFrame]:
    """The artifacts of all documents by name, as `workspace.write_artifacts` takes them.

    docs: doc_id, md; sources: doc_id, source; answers: as `matching.verdicts` takes them, of ref_id doc_id * 1,000,000 +
    entry_no. A document that fails a check keeps its artifacts, its status says so.
    """
    pairs = docs.join(sources, "doc_id")
    refs = bibliography.extract(docs)
    keyed = refs.withColumn("ref_id", F.col("doc_id") * 1_000_000 + F.col("entry_no")).withColumnRenamed("doc_id", "paper_id")
    chunks = structure.chunk_map(docs)
    checks = fidelity.conversion_report(pairs)
    found = lint.findings(docs)
    linted = lint.report(docs, found).select("doc_id", "status", "finding_count")
    titles = render.title(docs)
    counts = refs.groupBy("doc_id").agg(F.count("*").alias("refs"))
    papers = titles.select("doc_id", slug(F.col("title")).alias("slug"))
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    state = papers.join(n, "doc_id", "left").join(counts, "doc_id", "left").join(checks.select("doc_id", "status"), "doc_id", "left")
    report = titles.join(checks.select("doc_id", "status"), "doc_id", "left").withColumn("day", F.lit(day))
    return {
        "input/original": sources,
        "input/original_converted": docs,
        "input/original_references": refs,
        "verification/original_verification": checks,
        "verification/consistency_lint_report": found,
        "verification/reference_report": matching.verdicts(keyed, answers),
        "chunks/chunk_map": chunks,
        "agent_outputs": workspace.stubs(docs),
        "output/review_EN": workspace.review_template(report),
        "output/manifest": compare.manifest(papers, chunks, counts, linted),
        "NEXT_STEPS": workspace.next_steps(state),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions that SQL lacks known to a session; their names."""
    ship(spark)

    @F.pandas_udf("double")
    def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("boolean")
    def contains_roughly(text: pd.Series, needle: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None else fidelity.fuzzy_contains(n, t, r) for t, n, r in zip(text, needle, least, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def sanitized_html(s: pd.Series) -> pd.Series:
        return s.map(render.sanitized_text)

    functions = {"title_similarity": title_similarity, "contains_roughly": contains_roughly, "sanitized_html": sanitized_html}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
