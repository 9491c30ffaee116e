"""What a prepared review holds: native text, passes to fill, templates, and the artifacts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.sources.files import write_workspace

# The review dimensions, and the artifacts of a review.
DIMENSIONS = ["math-logic", "notation", "exposition", "empirical", "cross-section", "econometrics", "literature", "references", "language"]
ARTIFACTS = [
    "input/original", "input/original_converted", "input/original_references", "verification/original_verification", "verification/consistency_lint_report",
    "verification/reference_report", "chunks/chunk_map", "agent_outputs", "output/review_EN", "output/manifest", "NEXT_STEPS",
]
SECTIONS = [
    ("Summary", "What the paper does, in one or two paragraphs."), ("Overall Assessment", "Strengths, concerns, recommendation."), ("Major Comments", "1. Issue, evidence, correction."),
    ("Minor Comments", "1. Issue, correction."), ("Econometric/Statistical Methodology", "Methods."), ("Literature and References", "Coverage, and what the verification of references says."),
    ("Language and Presentation", "Language."), ("Suggestions for Improvement", "Optional."), ("Appendix A: Detailed Findings", "| ID | Dimension | Severity | Confidence | Location | Evidence | Correction |\n|---|---|---|---|---|---|---|"),
    ("Appendix B: Low-Confidence Findings", "Findings below 50."),
]


def native_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, md): the pages of (doc_id, page_no, text) as sections `## Page N`; a null text is an empty page."""
    part = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"))
    return pages.select("doc_id", "page_no", part.alias("part")).groupBy("doc_id").agg(F.expr("listagg(part, '\\n') within group (order by page_no)").alias("md"))


def stubs(papers: DataFrame) -> DataFrame:
    """(doc_id, dimension, body): an empty pass of each dimension for every paper."""
    name = F.explode(F.array(*map(F.lit, DIMENSIONS)))
    return papers.select("doc_id").distinct().select("doc_id", name.alias("dimension")).withColumn("body", F.concat(F.lit("# "), "dimension", F.lit(" findings\n\n_Nothing found yet._\n")))


def review_template(papers: DataFrame) -> DataFrame:
    """(doc_id, md): the report to be filled. papers: doc_id, title, status, day."""
    head = F.format_string("# Referee Report\n\n**Manuscript:** %s\n**Conversion Verification:** %s\n**Date:** %s\n\n", F.coalesce("title", F.lit("Untitled")), F.coalesce("status", F.lit("UNKNOWN")), F.coalesce("day", F.lit("")))
    return papers.select("doc_id", F.concat(head, F.lit("\n\n".join(f"## {h}\n\n{t}" for h, t in SECTIONS) + "\n")).alias("md"))


def next_steps(manifests: DataFrame) -> DataFrame:
    """(doc_id, md): what is left to do. manifests: doc_id, slug, chunks, refs, status."""
    text = F.format_string(
        "# Next steps for %s\n\n1. Read the conversion report (%s).\n2. Fill the %s passes over %s chunks.\n3. Look at %s references.\n4. Write the report.\n",
        F.col("slug"), F.coalesce("status", F.lit("UNKNOWN")), F.lit(str(len(DIMENSIONS))), F.coalesce("chunks", F.lit(0)).cast("string"), F.coalesce("refs", F.lit(0)).cast("string"),
    )
    return manifests.select("doc_id", text.alias("md"))


def write_artifacts(tables: dict[str, DataFrame], base: str, run_id: str, overwrite: bool = False) -> None:
    """The artifacts of a run, each a table under base/run_id; a name that is none of ARTIFACTS is an error."""
    if unknown := set(tables) - set(ARTIFACTS):
        raise ValueError(f"no artifacts: {', '.join(sorted(unknown))}")
    write_workspace(tables, base, run_id, overwrite)
