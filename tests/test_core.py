"""Operators of the core on small inputs."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from foliolens.operators import bibliography, cleanup, compare, fidelity, lint, manuscript, matching, render, structure, workspace
from foliolens.plans import review
from foliolens.sources import files
from foliolens.streaming.ingest import ingest_markdown

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, md string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), DOCS)


def rules(spark, text):
    return {r.rule_id for r in lint.findings(docs(spark, text)).collect()}


def test_lines_and_chunks_partition_the_text(spark):
    d = docs(spark, "pre\n# A\nx $y$\n## B ##\n| a | b |\n", "no heading\nhere", "", None)
    got = structure.lines(d).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 5, 2: 2}
    c = {(r.doc_id, r.chunk_id): r for r in structure.chunk_map(d).collect()}
    assert set(c) == {(1, "c1"), (1, "c2"), (2, "c1")}
    assert (c[1, "c1"].start_line, c[1, "c1"].end_line, c[1, "c1"].has_equations) == (2, 3, True)
    assert (c[1, "c2"].start_line, c[1, "c2"].end_line, c[1, "c2"].has_tables) == (4, 5, True)
    assert c[2, "c1"].heading == "Document" and c[2, "c1"].words == 3


def test_two_sections_route_to_the_first_last_pair(spark):
    d = docs(spark, "## One\n\ntext\n\n## Two\n\ntext\n")
    chunks = structure.chunk_map(d)
    assert [(r.first_id, r.second_id) for r in structure.section_pairs(chunks).collect()] == [("c1", "c2")]
    dims = {(r.dimension, r.group_no, r.pos, r.chunk_id) for r in structure.dimension_assignments(chunks).collect()}
    assert ("notation", 1, 2, "c2") in dims and ("cross-section", 1, 1, "c1") in dims
    assert not [x for x in dims if x[0] == "references"]


def test_pairs_prefer_the_last_results_and_skip_themselves(spark):
    heads = ["Abstract", "Introduction", "Methods", "Results one", "Results two", "Results three", "Discussion"]
    chunks = structure.chunk_map(docs(spark, "\n\n".join(f"# {h}\n\nx" for h in heads)))
    got = {(r.first_id, r.second_id) for r in structure.section_pairs(chunks).collect()}
    assert got == {("c2", "c5"), ("c2", "c6"), ("c3", "c5"), ("c3", "c6"), ("c1", "c7")}


def test_groups_below_one_count_as_one(spark):
    chunks = structure.chunk_map(docs(spark, "# A\n# B\n# C\n# D\n"))
    assert {(r.group_no, r.pos) for r in structure.chunk_groups(chunks, 0).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {(r.chunk_id, r.group_no) for r in structure.chunk_groups(chunks).collect()} == {("c1", 1), ("c2", 1), ("c3", 1), ("c4", 2)}


def test_heading_recovery(spark):
    text = "1. Intro\n\nbody 2. not\n2.1. Deeper part\n\nMethods\n\n# Kept  \n\n3. 12345\n"
    got = {r.line_no: r.text for r in structure.recovered_headings(docs(spark, text)).collect()}
    assert got[1] == "## 1. Intro" and got[4] == "### 2.1. Deeper part" and got[6] == "## Methods" and got[8] == "# Kept" and got[10] == "3. 12345"


@pytest.mark.parametrize(
    ("text", "yes", "no"),
    [
        ("TITLE-ABS-KEY (effect)) x\nThe patients were screened", {"C12", "C22", "C34"}, {"C28"}),
        ("Research other than articles was excluded. A Handbook (pp. 1-2). digital trade rules RQ1 RQ2", {"C29", "C31"}, set()),
        ("PRISMA significantly promotes", {"C28"}, set()),
        ("PRISMA significantly promotes; risk of bias", set(), {"C28"}),
        ("data-free flow clauses; interactive items; division of the GVC division of labor. On the one hand x. However y", {"C16", "C19", "C24", "C25"}, set()),
        ("On the one hand x. However, on the other hand y", set(), {"C24"}),
        ("provides a reference for the big Digital Partnership Agreement; new constraints by narrowing the gap in information and communication technology. It has been stagnant. Later, it gradually transitioned", {"C26", "C35", "C36"}, set()),
        ("Google Scholar returned 48 on the global network; VOSviewer with a network pattern", {"C30", "C32"}, set()),
        ("a<br>2 | b", {"C08"}, set()),
        ("a<br>23 | b", set(), {"C08"}),
        ("To interpret international differences\nx\nRegional specificities also include", {"C09"}, set()),
        ("Regional specificities also include\nTo interpret international differences", set(), {"C09"}),
    ],
)
def test_lint_rules(spark, text, yes, no):
    got = rules(spark, text)
    assert yes <= got and not no & got


def test_lint_line_is_null_where_the_phrase_wraps(spark):
    got = lint.findings(docs(spark, "between the\ntwo countries", "x\nbetween the two countries")).collect()
    assert {r.doc_id: r.line for r in got if r.rule_id == "C17"} == {1: None, 2: 2}
    r = lint.report(docs(spark, "fine"), lint.findings(docs(spark, "fine"))).first()
    assert (r.status, r.finding_count) == ("PASS", 0)


def test_own_rules_extend_the_table(spark):
    own = [lint.Rule("X1", "Minor", 50, r"foo", (r"foo",), (), (r"bar",))]
    assert {r.doc_id for r in lint.findings(docs(spark, "foo", "foo bar"), own).collect() if r.rule_id == "X1"} == {1}


BIB = """text
**8 References**
Alpha, B. (2001). A first long title here. Journal.
## 12 https://doi.org/10.1000/x
Beta, C. (2002). A second long title here. Journal.
Gamma, D. (2003). A third one that
   wraps over a line. Journal. Delta, E. (2004). Joined on one line.
## Appendix
no"""


def test_bibliography(spark):
    d = docs(spark, BIB, "no section")
    s = bibliography.section(d).collect()
    assert [(r.doc_id, r.start_line, r.end_line) for r in s] == [(1, 3, 7)]
    block = structure.lines(d).join(bibliography.section(d), "doc_id").where("line_no between start_line and end_line and text not like '##%'")
    got = [r.entry for r in bibliography.entries(block.select("doc_id", "line_no", "text")).orderBy("entry_no").collect()]
    assert [g[:5] for g in got] == ["Alpha", "Beta,", "Gamma", "Delta"] and "wraps" in got[2]


def test_fields_of_a_reference(spark):
    raw = '[3] Alpha, B.; Beta, C.: "A long quoted title," *Some Journal*, 2001. doi:10.1000/ab c.'
    r = bibliography.fields(spark.createDataFrame([(1, raw), (2, None), (3, "")], "k long, t string"), "k", "t").collect()
    assert len(r) == 1
    assert r[0].year == "2001" and r[0].title == "A long quoted title," and r[0].doi == "10.1000/abc" and r[0].journal == "Some Journal"


def test_bibliography_fallback(spark):
    e = "doc_id long, entry string"
    a = spark.createDataFrame([(1, "x"), (2, "a"), (2, "b"), (2, "c")], e)
    b = spark.createDataFrame([(1, "y"), (1, "z"), (3, "w")], e)
    got = {(r.doc_id, r.entry) for r in bibliography.choose(a, b).collect()}
    assert got == {(1, "y"), (1, "z"), (2, "a"), (2, "b"), (2, "c"), (3, "w")}


def _verdict(spark, ref, *answers):
    cols = "ref_id long, paper_id long, title string, authors string, year string, doi string, journal string, raw_text string"
    refs = spark.createDataFrame([(1, 1, *ref, None, None)[:3] + (None,) + ref[1:] + (None,)], cols)
    a = spark.createDataFrame([(k, 1, *x) for k, x in enumerate(answers)], "match_id long, ref_id long, found boolean, source string, tier int, title string, doi string, similarity double, year string")
    r = matching.verdicts(refs, a).first()
    return r.status, r.confidence, r.reasons, r.verified_by


@pytest.mark.parametrize(
    ("sim", "doi", "want"),
    [
        (0.9, "10.1000/x", ("verified", 100, "", "c1")),
        (0.8, "10.1000/x", ("suspicious", 75, "R3", "c1")),
        (0.5, "10.1000/x", ("suspicious", 60, "R3", None)),
        (0.9, None, ("verified", 90, "", "c1")),
        (0.75, None, ("suspicious", 70, "R3", "c1")),
        (0.2, None, ("suspicious", 40, "R3", None)),
    ],
)
def test_decision_table(spark, sim, doi, want):
    assert _verdict(spark, ("A title", "2001", "10.1000/X", ""), (True, "c1", 1, "A title", doi, sim, "2001")) == want


def test_not_found_and_year_mismatch(spark):
    assert _verdict(spark, ("Three word title", None, None, None)) == ("unverifiable", 0, "", None)
    assert _verdict(spark, ("A title of five words", None, "10.1000/x", "J")) == ("suspicious", 40, "R1,R2,R4", None)
    assert _verdict(spark, ("A title", "2001", None, ""), (True, "c1", 1, "A title", None, 0.95, "2002")) == ("suspicious", 80, "R5", "c1")


def test_cascade_takes_the_first_good_tier(spark):
    a = spark.createDataFrame([(1, 1, True, 1, 0.8), (2, 1, True, 2, 0.86), (3, 1, True, 3, 1.0), (4, 2, True, 1, 0.5), (5, 2, True, 2, 0.5), (6, 3, False, 1, 0.0)], "match_id long, ref_id long, found boolean, tier int, similarity double")
    assert {r.ref_id: r.match_id for r in matching.cascade(a).collect()} == {1: 2, 2: 4, 3: 6}


def test_lookup_finds_titles_and_dois(spark):
    refs = spark.createDataFrame([(1, "A study of rural lighthouses", None), (2, None, "10.1000/x"), (3, "Something else entirely", None), (4, None, None)], "ref_id long, title string, doi string")
    recs = spark.createDataFrame([(10, 1, "A study of rural lighthouse", None), (11, 2, "Any", "10.1000/X"), (12, 1, None, None)], "record_id long, tier int, title string, doi string")
    got = {(r.ref_id, r.record_id, round(r.similarity, 2)) for r in matching.lookup(refs, recs).collect()}
    assert got == {(1, 10, 0.98), (2, 11, 1.0)}


def _all_pairs(refs, recs, least):
    """{(ref_id, tier): the highest ratio of two titles}, by comparing every pair."""
    from difflib import SequenceMatcher

    out = {}
    for i, t in refs:
        for n, tier, u in recs:
            if t and u and 2 * min(len(t), len(u)) / (len(t) + len(u)) >= least:
                m = SequenceMatcher(None, t, u)
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (s := m.ratio()) >= least:
                    x = out.get((i, tier))
                    if x is None or s > x[0] or (s == x[0] and n < x[1]):
                        out[i, tier] = (s, n)
    return out


def test_lookup_finds_what_comparing_all_titles_finds(spark):
    import random

    rng = random.Random(5)
    words = "volunteering inheritance wartime question lighthouses rural tenancy harbours colonial libraries a the of after".split()
    titles = [" ".join(rng.sample(words, rng.randint(3, 13))) for _ in range(60)] + ["volunteering inheritance and the wartime question", "灯台の歴史と地方の暮らし", "kölcsön"]

    def slip(t, k):
        for _ in range(k):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "x", "rn"]) + t[i + 1 :]
        return " ".join(t.split())

    recs = [(100 + i, 1 + i % 2, t) for i, t in enumerate(titles)]
    refs = [(i, slip(t, i % 5)) for i, t in enumerate(titles)] + [(90, "vounteering inheritance and the wartime uestion"), (91, "the volunteernig inheritnace and wartime question")]
    refs += [(92, "灯台の歴史と地力の暮らし"), (93, "kölcsön"), (94, None), (95, "")]
    a = spark.createDataFrame([(*x, None) for x in refs], "ref_id long, title string, doi string")
    b = spark.createDataFrame([(*x, None) for x in recs], "record_id long, tier int, title string, doi string")
    got = {(r.ref_id, r.tier): (r.similarity, r.record_id) for r in matching.lookup(a, b).collect()}
    want = _all_pairs(refs, recs, 0.85)
    assert {k: got.get(k) for k in want} == want and len(want) > 40
    assert {got[k][1] for k in ((90, 1), (91, 1))} == {160} and (92, 2) in got and (93, 1) in got
    assert all(s >= 0.7 for s, _ in got.values())
    assert matching.lookup(a.where("false"), b).count() == 0 and matching.lookup(a, b.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_lookup_loses_no_verified_title_of_the_tables(spark):
    """On all of sf0.001 every best title of a ratio of 0.85 or more is found, as by comparing all pairs."""
    from pyspark.sql import functions as F

    from foliolens.functions.text import loose
    from foliolens.plans import views

    refs, recs = views.references(spark, DATA).withColumn("doi", F.lit(None).cast("string")), views.records(spark, DATA)
    r = refs.select("ref_id", loose(F.coalesce("title", F.lit(""))).alias("t")).collect()
    c = recs.select("record_id", "tier", loose(F.coalesce("title", F.lit(""))).alias("u")).collect()
    want = _all_pairs([tuple(x) for x in r], [tuple(x) for x in c], 0.85)
    got = {(x.ref_id, x.tier): (x.similarity, x.record_id) for x in matching.lookup(refs, recs).collect()}
    assert {k: got.get(k) for k in want} == want and len(want) > 300


def test_captions_tables_and_native(spark):
    text = "| a | b |\n| c | d |\n\n**Table 1.** x\nTable 2. y\nTables 3\n| e | f |\n![cap](x.png)\n**Figure 1:** bold\nFigure 2. cap\nFigure 3. BOLD\n"
    t = fidelity.table_blocks(docs(spark, text)).first()
    assert (t.blocks, t.captions) == (2, 2)
    assert [r.caption for r in fidelity.figure_captions(docs(spark, text)).orderBy("pos").collect()] == ["cap", "bold"]
    pages = spark.createDataFrame([(1, 1, "two words"), (1, 2, ""), (1, 3, None), (2, 1, ""), (3, 1, "word " * 200)], "doc_id long, page_no int, text string")
    assert {r.doc_id: (r.status, r.warnings, r.failures) for r in fidelity.native_report(pages).collect()} == {1: ("WARN", 2, 0), 2: ("FAIL", 1, 1), 3: ("PASS", 0, 0)}


def test_conversion_report(spark):
    body = "# H\n\n" + " ".join(f"word{i}" for i in range(60)) + ".\n"
    p = spark.createDataFrame([(1, body, body), (2, body + "lost " * 20, body), (3, "# a\n# b\n# c\n# d\n# e\n" + body, body.replace("# H", "a b c d e H"))], "doc_id long, source string, md string")
    r = {x.doc_id: x for x in fidelity.conversion_report(p).collect()}
    assert r[1].status == "PASS" and r[2].status == "FAIL" and "V1" in r[2].failures and "V2" in r[3].warnings


def test_conversion_report_bears_slips_and_warns_of_lost_references_and_captions(spark):
    names = "amber birch cedar dune elm fern grove heath iris juniper kelp larch".split()
    said = [f"The {a} survey of {b} fields reports that {c} yields were lower than ever before, and the later counts of the same plots agree with this in nearly all regions." for a, b, c in zip(names, names[1:], names[2:])]
    head = "# Title\n\n" + "\n\n".join(said)
    refs = "\n\n# References\n\n" + "".join(f"[{k}] {n.title()}, A. (20{k:02}) A title of some length. \n" for k, n in enumerate(names, 10))
    fig = "Figure 1. Yields of all the fields by year and kind of tree, drawn from the counts of the survey"
    plain = head + refs
    slips = plain.replace("reports", "rep0rts")
    other = plain.replace("The amber survey of birch fields reports that cedar", "Nothing of that kind was ever written in any")
    rows = [(1, slips, plain), (2, plain, head + "\n\n# References\n\n" + refs[20:400]), (3, plain, plain), (4, head + "\n\n" + fig + "\n" + refs, plain), (5, head + "\n\n" + fig + "\n" + refs, head + "\n\n" + fig.replace("Yields", "Yie1ds") + "\n" + refs), (6, other, plain)]
    r = {x.doc_id: x for x in fidelity.conversion_report(spark.createDataFrame(rows, "doc_id long, source string, md string")).collect()}
    assert (r[1].status, r[1].spot_hits) == ("PASS", r[1].spot_checked) and r[1].spot_checked > 2
    assert "V4" in r[2].warnings and r[3].status == "PASS" and "V6" in r[6].failures
    assert "V7" in r[4].warnings and "V7" not in r[5].warnings


def test_fuzzy_containment():
    hay = "the quick brown fox jumps over the lazy dog and runs far away from here"
    assert fidelity.fuzzy_contains("quick brown fox", hay, 0.85)
    assert fidelity.fuzzy_contains("quick brown fox jumped over the lazy dog and runs", hay, 0.7)
    assert not fidelity.fuzzy_contains("completely other words that never occur", hay, 0.85)
    assert fidelity.fuzzy_contains("", hay, 0.85)


def test_spans(spark):
    rows = [(1, 1, "Title", 14.0, 0), (1, 2, "body", 10.0, 0), (1, 3, "1 Bold head", 10.0, 16), (1, 4, "1 Bold head", 10.0, 16), (1, 5, "more", 10.0, 0), (1, 6, "1 note", 8.0, 0), (1, 7, "goes on", 8.0, 0), (1, 8, "2 note", 8.5, 0), (1, 9, "§ none", 8.0, 0), (1, 10, "3", 8.0, 0), (1, 11, "4 tiny", 4.0, 0), (1, 12, "5 big", 8.6, 0)]
    rows += [(2, 1, "body of six", 6.0, 0), (2, 2, "1 note", 4.5, 0)]
    s = spark.createDataFrame(rows, "doc_id long, ord int, text string, size double, flags int")
    assert {r.doc_id: r["size"] for r in fidelity.body_size(s).collect()}[1] == 10.0
    assert [r.text for r in fidelity.span_headings(s).orderBy("ord").collect()] == ["Title", "1 Bold head"]
    assert {r.doc_id: r.footnotes for r in fidelity.span_footnotes(s).collect()} == {1: 2, 2: 0}
    notes = docs(spark, "1 Note\n2 note\n† mark\n* more\n‡", "1 Note\n 22 Note\n* one", "none", "")
    assert {r.doc_id: r.footnotes for r in fidelity.text_footnotes(notes).collect()} == {1: 2, 2: 2, 3: 0}


def test_scores_and_best_mode(spark):
    cols = "doc_id long, mode string, mode_ord int, status string, word_diff double, spot_ratio double, warnings int, failures int, refs int"
    m = compare.scored(spark.createDataFrame([(1, "a", 1, "PASS", 1.0, 1.0, 1, 0, 10), (1, "b", 2, "WARN", None, None, 0, 0, 0)], cols))
    assert [r.score for r in m.orderBy("mode_ord").collect()] == [200 + 40 - 2 - 6 + 2, 100 - 30]
    x = spark.createDataFrame([Row(doc_id=1, mode="f", mode_ord=1, status="FAIL", score=1000.0), Row(doc_id=1, mode="p", mode_ord=2, status="PASS", score=10.0)])
    assert compare.best(x).first().mode == "p"
    f = compare.failed(spark.createDataFrame([(1, "a", 1)], "doc_id long, mode string, mode_ord int")).first()
    assert f.status == "FAIL" and f.word_diff is None and f.score == -100
    assert "n/a" in compare.comparison(m).first().report


def test_consensus_and_unique(spark):
    f = spark.createDataFrame([(1, "a", "C1", "Major", 90), (1, "b", "C1", "Major", 95), (1, "a", "C2", "Minor", 80)], "doc_id long, mode string, rule_id string, severity string, confidence int")
    c = lint.consensus(f).collect()
    assert [(r.rule_id, r.max_confidence, r.present_in) for r in c] == [("C1", 95, "a,b")]
    assert [(r.mode, r.rule_id) for r in lint.unique_findings(f).collect()] == [("a", "C2")]


def test_rendering(spark):
    from pyspark.sql import functions as F

    d = docs(spark, "# Referee Report\n\n**Manuscript:** My *Paper*\n", "## no", "# The title\n")
    assert {r.doc_id: r.title for r in render.title(d).collect()} == {1: "My *Paper", 2: "Untitled", 3: "The title"}
    h = spark.createDataFrame([("<td>Major</td><p>Suggested correction: do it</p>",)], "h string").select(render.enhanced(F.col("h")).alias("h")).first().h
    assert 'class="severity-major"' in h and '<div class="correction">' in h
    assert render.sanitized_text('<p onclick="x">a<script>b</script><a href="javascript:x" title="t">c</a><img src="http://x/y"></p>') == '<p>ab<a title="t">c</a><img src="http://x/y"></p>'
    assert render.sanitized_text(None) is None
    l = docs(spark, "összefoglalás és Értékelés", "summary").select(render.language(F.col("md")).alias("l")).collect()
    assert [x.l for x in l] == ["hu", "en"]


def test_files_and_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nx")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in/c.pdf").write_bytes(b"nope")
    (tmp_path / "r.json").write_text(json.dumps([{"title": "T", "authors": ["A", "B"], "year": "2001"}, {"title": "U", "authors": "C"}]))
    assert files.read_markdown(spark, str(tmp_path / "in")).first().md == "# A\n\nx"
    assert sorted(r.status for r in files.read_pdfs(spark, str(tmp_path / "in")).collect()) == ["not-a-pdf", "ok"]
    refs = files.read_references(spark, str(tmp_path / "r.json")).orderBy("ref_index").collect()
    assert refs[0].authors == '["A","B"]' and refs[1].authors == "C" and refs[1].year == ""
    df = spark.range(2)
    files.write_workspace({"t": df}, str(tmp_path / "ws"), "run")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_workspace({"t": df}, str(tmp_path / "ws"), "run")
    for n in ("1", "2"):
        ingest_markdown(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == int(n)
        (tmp_path / "in/d.md").write_text("new")
    one = spark.createDataFrame([(1, "x", "b")], "doc_id long, dimension string, body string")
    assert files.absent_passes(one, one.unionByName(spark.createDataFrame([(1, "y", "b")], one.schema))).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1), st.integers(0, 60), st.integers(0, 60))
def test_length_bound_never_drops_a_match(t, la, lb):
    """The exact bound of the ratio: 2 min / (la + lb) >= t implies the lengths' window."""
    if la and lb and t > 0 and 2 * min(la, lb) / (la + lb) >= t:
        assert la * t / (2 - t) - 1e-9 <= lb <= la * (2 - t) / t + 1e-9


def test_cleanup(spark):
    d = docs(spark, "# A  \n\n\n\n\n--- end of page=1 ---\n| a |\n|---|\n| b |\n", "x", "", None)
    assert {r.doc_id: r.md for r in cleanup.cleaned(d).collect()} == {1: "# A\n\n| a |\n|---|\n| b |\n", 2: "x\n"}
    assert tuple(cleanup.stats(d).where("doc_id = 1").first())[1:] == (1, 14, 1, 1)


def test_years_dois_and_queries(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("(1998)", None, 2005, ["A", "B", "C"]), ("x1998", "1700", None, None), (None, "2001-05", 3000, [])], "a string, b string, c int, n array<string>")
    got = [tuple(r) for r in d.select(matching.year_of(F.col("a")), matching.first_year(F.col("b"), F.col("c"), F.col("a"), F.col("a")), matching.query_text(F.lit(" T "), F.col("n"), 1), matching.query_text(F.lit("T"), F.col("n"), 2)).collect()]
    assert got == [("1998", "2005", "T A B", "T"), (None, None, "T", "T"), (None, "2001", "T", "T")]
    one = spark.range(1).select(matching.bare_doi(F.lit("https://doi.org/10.1/x")), bibliography.repaired_doi(F.lit("see doi: 10.1000/ab c-d, or https://doi.org/ 10.1000/q")))
    assert tuple(one.first()) == ("10.1/x", "see doi:10.1000/abc-d, or https://doi.org/10.1000/q")


def test_manuscript_checks(spark):
    text = "As Smith (1999) and Kövér et al., 2001 say, OECD (GDP) is 0.25 or 3.5.\n\nThe GDP and OECD.\n| a | 0.25 |\n"
    d = docs(spark, text, "", None)
    refs = spark.createDataFrame([(1, 1, 1, '["Smith, A.","B"]', "1999"), (1, 2, 2, "Ann Novák; X", "2003a"), (1, 3, 3, None, "2000")], "paper_id long, ref_id long, ref_index int, authors string, year string")
    got = {(r.surname, r.year): (r.cited, r.listed) for r in manuscript.citation_completeness(d, refs).collect()}
    assert got == {("smith", "1999"): (True, True), ("kover", "2001"): (True, False), ("novak", "2003"): (False, True)}
    own = spark.createDataFrame([(1, "Smith, Z.")], "paper_id long, authors string")
    assert tuple(manuscript.self_citations(refs, own).first()) == (1, 3, 1, 1 / 3)
    assert {tuple(r)[1:] for r in manuscript.acronyms(d).collect()} == {("OECD", 1, None, 2), ("GDP", 1, 1, 2)}
    assert {tuple(r)[1:] for r in manuscript.number_check(d).collect()} == {("0.25", 1, True), ("3.5", 1, False)}
    assert [tuple(r)[2:] for r in manuscript.reference_batches(refs, 2).orderBy("ref_id").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert [r.kind for r in manuscript.document_type(docs(spark, "w " * 60_001, "w " * 60_000)).orderBy("doc_id").collect()] == ["dissertation", "article"]


def test_findings_have_texts(spark):
    d = docs(spark, "x\nThe patients were screened.", "The patients\nwere screened.")
    r = {x.doc_id: x for x in manuscript.finding_gaps(lint.detailed(d, lint.findings(d))).collect()}
    assert r[1].complete and r[1].evidence == "The patients were screened." and r[1].location == "line 2"
    assert r[2].missing == "evidence,location" and not r[2].complete
    assert {r.rule_id for r in lint.RULES} | {lint.SPARSE[0], lint.NEAR[0]} == set(lint.TEXTS)


def test_bibliography_from_the_text(spark):
    text = "# T\n\nbody\n\n## References\n\nSmith, A. (1999). A long enough title of one. Journal. doi:10.1000/ab. World Bank (2001). Another long enough title of two. X.\n\n# Next\n\nJones, B. (2000). Not a reference at all here.\n"
    got = [(r.entry_no, r.year, r.doi, r.title) for r in bibliography.extract(docs(spark, text, "none", "")).orderBy("entry_no").collect()]
    assert got == [(1, "1999", "10.1000/ab", "A long enough title of one"), (2, "2001", "", "Another long enough title of two")]


def test_layouts(spark, tmp_path):
    span = {"text": "a", "size": 9.0, "flags": 16, "font": "f", "bbox": [0.0, 0.0, 1.0, 1.0]}
    pages = [{"blocks": [{"type": 0, "lines": [{"spans": [span, {**span, "text": "b"}]}]}, {"type": 1, "lines": None}], "tables": ["t"]}, {"blocks": [{"type": 0, "lines": [{"spans": [{**span, "text": "c"}]}]}], "tables": None}]
    (tmp_path / "l.json").write_text(json.dumps({"doc_id": 1, "pages": pages}) + "\n" + json.dumps({"doc_id": 2, "pages": []}))
    d = files.read_layouts(spark, str(tmp_path))
    assert [(r.ord, r.page, r.text) for r in files.spans(d).orderBy("ord").collect()] == [(1, 1, "a"), (2, 1, "b"), (3, 2, "c")]
    assert {r.doc_id: r.tables for r in files.table_count(d).collect()} == {1: 1, 2: 0}


def test_discovery_and_sinks(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    for n in ("a.pdf", "b.pdf", "c.txt", "venv/d.pdf"):
        (tmp_path / n).write_bytes(b"%PDF-1.4")
    found = files.discover_pdfs(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.candidates) for r in found] == [("a.pdf", 2), ("b.pdf", 2)]
    df = spark.createDataFrame([(1, "é")], "doc_id long, html string")
    files.write_pretty_json(df, str(tmp_path / "j"))
    body = spark.read.text(str(tmp_path / "j"), wholetext=True).first().value
    assert json.loads(body) == {"doc_id": 1, "html": "é"} and body.startswith("{\n  ")
    files.write_pages(df, str(tmp_path / "h"))
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "h")).collect()] == [("é", 1)]


def test_reviews_are_prepared(spark, tmp_path):
    text = "# A title\n\nThe patients were screened for many reasons in all of the years.\n\n## References\n\n[1] Smith, A. (1999). A long enough title. Journal of X.\n"
    d = docs(spark, text, "# Other\n\nno list")
    sources = d.withColumnRenamed("md", "source")
    answers = spark.createDataFrame([(1, 1_000_001, True, "c1", 1, "A long enough title", None, 1.0, "1999")], "match_id long, ref_id long, found boolean, source string, tier int, title string, doi string, similarity double, year string")
    out = review.prepare_reviews(d, sources, answers, "2024-05-31")
    assert set(out) == set(workspace.ARTIFACTS)
    assert out["verification/reference_report"].first().status == "verified"
    assert out["agent_outputs"].count() == 18 and {r.status for r in out["verification/original_verification"].collect()} == {"PASS"}
    assert "**Manuscript:** A title" in out["output/review_EN"].where("doc_id = 1").first().md
    workspace.write_artifacts(out, str(tmp_path), "r1")
    assert spark.read.parquet(str(tmp_path / "r1/NEXT_STEPS")).count() == 2
    with pytest.raises(ValueError, match="no artifacts"):
        workspace.write_artifacts({"x": d}, str(tmp_path), "r1")


def test_functions_for_sql(spark):
    from pyspark.sql import functions as F

    from foliolens.functions.text import day, percent, safe_float

    assert review.register(spark) == ["contains_roughly", "sanitized_html", "title_similarity"]
    assert tuple(spark.sql("SELECT title_similarity('abcd', 'abcx'), sanitized_html('<script>a</script><b>b</b>'), contains_roughly('one two three four', 'two three', 0.9D)").first()) == (0.75, "ab", True)
    one = spark.range(1).select(safe_float(F.lit(" 1.5 ")), safe_float(F.lit("x")), percent(F.lit(0.256)), percent(F.lit(None).cast("double")), day(F.to_timestamp(F.lit("2024-05-31 10:00:00"))))
    assert tuple(one.first()) == (1.5, None, "26%", "n/a", "2024-05-31")


def test_native_markdown(spark):
    p = spark.createDataFrame([(1, 2, None), (1, 1, " a ")], "doc_id long, page_no int, text string")
    assert workspace.native_markdown(p).first().md == "## Page 1\n\na\n\n## Page 2\n\n\n"


def test_pieces_are_cut_at_paragraphs(spark):
    d = docs(spark, "# H\na b c\nd e\n\nf g h i\n\n\nj k\n# I\nl", "", None)
    got = {(r.line_no, r.last_line, r.words) for r in structure.paragraph_words(d).collect()}
    assert got == {(1, 3, 6), (5, 5, 4), (8, 8, 2), (9, 10, 2)}
    p = structure.bounded_pieces(structure.chunk_map(d), structure.paragraph_words(d), 6, 2)
    assert {(r.chunk_id, r.piece, r.start_line, r.end_line) for r in p.collect()} == {("c1", 1, 1, 3), ("c1", 2, 1, 8), ("c2", 1, 9, 10)}
