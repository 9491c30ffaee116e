"""The queries of the core operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as t
from foliolens.operators import bibliography, cleanup, compare, fidelity, lint, manuscript, matching, render, structure, workspace
from foliolens.plans import oracle, views
from foliolens.session import table


def _wide(df: DataFrame) -> DataFrame:
    """df with whole numbers as bigint, as the SQL gives them."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))


def _chunks(s, d):
    return structure.chunk_map(views.docs(s, d))


def _modes(s, d, rough=False):
    c = fidelity.conversion_report(views.pairs(s, d), rough)
    n = fidelity.native_report(views.pages(s, d))
    refs = views.references(s, d).groupBy(F.col("paper_id").alias("doc_id")).agg(F.count("*").alias("refs"))
    size = lambda col: F.size(F.filter(F.split(col, ","), lambda x: x != ""))
    mode = F.explode(F.array(F.struct(F.lit("chunked").alias("mode"), F.lit(1).alias("mode_ord")), F.struct(F.lit("no-chunk").alias("mode"), F.lit(2).alias("mode_ord"))))
    two = c.select("*", mode.alias("m")).select(
        "doc_id", "m.mode", "m.mode_ord", "status", F.col("word_diff_pct").alias("word_diff"),
        F.when((F.col("m.mode_ord") == 1) & (F.col("spot_checked") > 0), F.col("spot_hits") / F.col("spot_checked")).alias("spot_ratio"), size("warnings").alias("warnings"), size("failures").alias("failures"),
    )
    null = F.lit(None).cast("double")
    one = n.select("doc_id", F.lit("native").alias("mode"), F.lit(3).alias("mode_ord"), "status", null.alias("word_diff"), null.alias("spot_ratio"), "warnings", "failures")
    return compare.scored(two.unionByName(one).join(refs, "doc_id", "left").withColumn("refs", F.coalesce("refs", F.lit(0))))


def _found(s, d):
    return lint.findings(views.seeded(s, d))


def _modes_found(s, d):
    """The findings of three variants of each text, in one pass; a document's key holds the variant meanwhile."""
    parts = [
        views.seeded(s, d, *shifts).select(F.concat_ws("/", F.col("doc_id"), F.lit(f"m{k}")).alias("doc_id"), "md") for k, shifts in enumerate(((0, 1), (1, 2), (0, 2)), 1)
    ]
    found = lint.findings(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    key = F.split("doc_id", "/")
    return found.select(key[1].alias("mode"), key[0].cast("bigint").alias("doc_id"), "rule_id", "severity", "confidence", "line")


def _word_counts(s, d):
    md = F.col("md")
    return views.docs(s, d).select("doc_id", t.count_of(md, t.WORDS_BLANK).alias("blanks"), t.count_of(md, t.WORDS_LETTER).alias("letters"), t.count_of(md, t.WORDS_CLASS).alias("classes"))


def _bounded(s, d):
    docs = views.docs(s, d)
    words = structure.lines(docs).select("doc_id", "line_no", t.count_of(F.col("text"), t.WORDS_LETTER).alias("words"))
    return structure.bounded_pieces(structure.chunk_map(docs), words, 120, 30)


def _paragraphs(s, d):
    docs = views.docs(s, d)
    return structure.bounded_pieces(structure.chunk_map(docs), structure.paragraph_words(docs), 120, 30)


def _quotes(s, d):
    docs = views.docs(s, d)
    q = structure.sentences(docs).select("doc_id", F.when(F.col("pos") % 4 == 0, F.concat("sentence", F.lit(" x"))).otherwise(F.col("sentence")).alias("quote"))
    return q.join(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("quotes"), F.count_if(F.col("md").contains(F.col("quote"))).alias("present"))


def _own(s, d):
    """A paper's own authors, for want of a column: those of its first reference."""
    refs = views.references(s, d)
    return refs.groupBy("paper_id").agg(F.min_by("authors", "ref_index").alias("authors"))


def _gaps(s, d):
    seeded = views.seeded(s, d)
    found = manuscript.finding_gaps(lint.detailed(seeded, lint.findings(seeded)))
    return found.select("doc_id", "rule_id", "evidence", "location", "missing", "complete")


def _template(s, d):
    docs = views.docs(s, d)
    papers = render.title(docs).join(fidelity.native_report(views.pages(s, d)).select("doc_id", "status"), "doc_id", "left")
    return workspace.review_template(papers.withColumn("day", F.lit("2024-05-31")))


def _symbols(s, d):
    each = structure.lines(views.docs(s, d)).select("doc_id", "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"\\[a-z]+"), F.lit(0))).alias("symbol"))
    return each.groupBy("doc_id", "symbol").agg(F.min("line_no").alias("first_line"), F.count("*").alias("uses"))


def _manifest(s, d):
    papers = table(s, d, "papers").select(F.col("paper_id").alias("doc_id"), t.slug(F.col("slug")).alias("slug")).distinct()
    refs = views.references(s, d).groupBy(F.col("paper_id").alias("doc_id")).agg(F.count("*").alias("refs"))
    seeded = views.seeded(s, d)
    return compare.manifest(papers, _chunks(s, d), refs, lint.report(seeded, lint.findings(seeded)).select("doc_id", "status", "finding_count"))


def _html(s, d):
    docs = views.docs(s, d).withColumn("raw", F.concat(render.markdown_html(F.col("md")), F.lit("<script>x</script><td>Major</td>")))
    return render.sanitized(docs.withColumn("raw", render.enhanced(F.col("raw"))), "raw").select("doc_id", "html")


def _language(s, d):
    docs = views.docs(s, d).withColumn("md", F.when(F.col("doc_id") % 3 == 0, F.concat("md", F.lit(" Módszertan és Javaslat"))).otherwise(F.col("md")))
    return docs.select("doc_id", render.language(F.col("md")).alias("language"))


def _slugs(s, d):
    return table(s, d, "papers").select("paper_id", t.slug(F.coalesce("slug", F.lit(""))).alias("slug")).distinct()


def _gate(s, d):
    return compare.confidence_gate(_found(s, d)).groupBy("gate").agg(F.count("*").alias("n"))


def _tiers(s, d):
    return compare.precision_tiers(_found(s, d)).groupBy("tier").agg(F.count("*").alias("n"))


_QUERIES = {
    "lines": lambda s, d: structure.lines(views.docs(s, d)),
    "word_counts": _word_counts,
    "sentences": lambda s, d: structure.sentences(views.docs(s, d)),
    "paragraph_bounds": lambda s, d: structure.paragraph_bounds(views.docs(s, d)),
    "chunk_map": _chunks,
    "single_chunks": lambda s, d: structure.single_chunks(views.docs(s, d)),
    "page_chunks": lambda s, d: structure.page_chunks(views.pages(s, d)),
    "chunk_groups": lambda s, d: structure.chunk_groups(_chunks(s, d)),
    "section_pairs": lambda s, d: structure.section_pairs(_chunks(s, d)),
    "dimension_assignments": lambda s, d: structure.dimension_assignments(_chunks(s, d)),
    "heading_recovery": lambda s, d: structure.recovered_headings(views.docs(s, d)),
    "bounded_pieces": _bounded,
    "paragraph_pieces": _paragraphs,
    "reference_section": lambda s, d: bibliography.section(views.docs(s, d)),
    "reference_entries": lambda s, d: bibliography.entries(views.bibliography(s, d)),
    "reference_fields": lambda s, d: bibliography.fields(views.references(s, d), "ref_id", "raw_text"),
    "reference_raw": lambda s, d: matching.raw_fallback(views.references(s, d)),
    "doi_match": lambda s, d: matching.doi_matches(views.references(s, d), views.records(s, d)),
    "catalog_lookup": lambda s, d: matching.lookup(views.references(s, d), views.records(s, d)),
    "reference_status": lambda s, d: matching.verdicts(views.references(s, d), views.answers(s, d)),
    "reference_summary": lambda s, d: matching.summary(matching.verdicts(views.references(s, d), views.answers(s, d))),
    "lint_findings": lambda s, d: _found(s, d).drop("line"),
    "lint_first_line": lambda s, d: _found(s, d).select("doc_id", "rule_id", F.coalesce("line", F.lit(0)).alias("line")),
    "lint_report": lambda s, d: lint.report(views.seeded(s, d), _found(s, d)),
    "table_blocks": lambda s, d: fidelity.table_blocks(views.docs(s, d)),
    "figure_captions": lambda s, d: fidelity.figure_captions(views.docs(s, d)),
    "conversion_report": lambda s, d: fidelity.conversion_report(views.pairs(s, d), rough=False),
    "conversion_report_whole": lambda s, d: fidelity.conversion_report(views.pairs(s, d)),
    "native_report": lambda s, d: fidelity.native_report(views.pages(s, d)),
    "spot_check": lambda s, d: fidelity.spot_check(views.pairs(s, d)),
    "fuzzy_spot_check": lambda s, d: fidelity.fuzzy_spot_check(views.pairs(s, d)),
    "mode_scores": lambda s, d: _modes(s, d).select("doc_id", "mode", "status", "score"),
    "best_mode": lambda s, d: compare.best(_modes(s, d)),
    "mode_report": lambda s, d: compare.comparison(_modes(s, d, rough=True)),
    "consensus": lambda s, d: lint.consensus(_modes_found(s, d)),
    "unique_findings": lambda s, d: lint.unique_findings(_modes_found(s, d)),
    "confidence_gate": _gate,
    "precision_tiers": _tiers,
    "slugs": _slugs,
    "language_detect": _language,
    "title_extract": lambda s, d: render.title(views.docs(s, d)),
    "sanitize_html": _html,
    "quote_exists": _quotes,
    "citation_completeness": lambda s, d: manuscript.citation_completeness(views.docs(s, d), views.references(s, d)),
    "self_citations": lambda s, d: manuscript.self_citations(views.references(s, d), _own(s, d)),
    "acronym_inventory": lambda s, d: manuscript.acronyms(views.docs(s, d)),
    "number_check": lambda s, d: manuscript.number_check(views.docs(s, d)),
    "document_type": lambda s, d: manuscript.document_type(views.docs(s, d)),
    "reference_batches": lambda s, d: manuscript.reference_batches(views.references(s, d)),
    "finding_gaps": _gaps,
    "clean_text": lambda s, d: cleanup.cleaned(views.paged(s, d)),
    "document_stats": lambda s, d: cleanup.stats(views.paged(s, d)),
    "year_values": lambda s, d: views.references(s, d).select("ref_id", matching.year_of(F.col("year")).alias("year"), matching.bare_doi(F.col("doi")).alias("doi")),
    "reference_extract": lambda s, d: bibliography.extract(views.docs(s, d)),
    "native_markdown": lambda s, d: workspace.native_markdown(views.pages(s, d)),
    "stubs": lambda s, d: workspace.stubs(views.docs(s, d)),
    "review_template": _template,
    "text_footnotes": lambda s, d: fidelity.text_footnotes(views.docs(s, d)),
    "reference_counts": lambda s, d: fidelity.source_references(views.docs(s, d)).withColumnRenamed("refs", "in_source").join(fidelity.references(views.docs(s, d)).withColumnRenamed("refs", "in_md"), "doc_id", "left"),
    "symbol_inventory": _symbols,
    "manifest": _manifest,
}


def queries():
    return {name: (lambda s, d, f=f: _wide(f(s, d))) for name, f in _QUERIES.items()}


def oracle_sql():
    return oracle.oracle_sql()
