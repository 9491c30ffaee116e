"""The core queries in DuckDB's SQL, written apart from the DataFrame code.

Patterns, word lists and seeds are shared values; everything else is stated anew.
"""

from __future__ import annotations

from foliolens.functions import text as t
from foliolens.operators import bibliography as b
from foliolens.operators import cleanup as c
from foliolens.operators import lint, structure
from foliolens.operators import manuscript as m
from foliolens.operators import workspace as w
from foliolens.plans.views import SEEDS


REF_WORD = r"(?i)\b(?:References|Bibliography|Works\s+Cited)\b"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), {q(t.OUTSIDE_CLASS)}, ' ', 'g'), '\\s+', ' ', 'g'))"


def loose(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def label(x: str) -> str:
    y = f"regexp_replace({trim(x)}, '^#{{1,6}}\\s*', '')"
    y = f"regexp_replace({y}, '\\*\\*|__|\\*|_', '', 'g')"
    y = f"regexp_replace({y}, '^\\d+(?:\\.\\d+)*\\.?\\s*', '')"
    y = f"regexp_replace({y}, '^\\(?[IVXLCDM]+\\)?\\.?\\s+', '')"
    return f"lower({trim(f'''regexp_replace({y}, '\\s+', ' ', 'g')''')})"


def any_of(x: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(k)})" for k in tokens) + ")"


def blank(x: str) -> str:
    return f"coalesce(trim({x}), '')"


def chunks_of(docs: str) -> str:
    return f"""SELECT doc_id, greatest(no, 1)::BIGINT AS chunk_no, 'c' || greatest(no, 1) AS chunk_id, CASE WHEN no = 0 THEN 'Document' ELSE title END AS heading, level,
 start_line, end_line, words, has_equations, has_tables, has_figures FROM (
 SELECT doc_id, no, arg_min(title, line_no) AS title, arg_min(len(mark), line_no) AS level, min(line_no) AS start_line, max(line_no) AS end_line,
  sum({count("text", t.WORDS_LETTER)})::BIGINT AS words, bool_or(contains(text, '$') OR contains(text, '\\(') OR contains(text, '\\[')) AS has_equations,
  bool_or(regexp_matches(text, '^\\s*\\|.+\\|\\s*$')) AS has_tables, bool_or(contains(text, '![') OR regexp_matches(text, '(?i)^\\s*figure\\s+\\d+')) AS has_figures
 FROM (SELECT *, sum(CASE WHEN mark <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS no, max(mark) OVER (PARTITION BY doc_id) <> '' AS headed
  FROM (SELECT *, regexp_extract({trim("text")}, '^(#{{1,3}})\\s+(.+?)\\s*$', 1) AS mark, regexp_extract({trim("text")}, '^(#{{1,3}})\\s+(.+?)\\s*$', 2) AS title FROM {docs}))
 WHERE no > 0 OR NOT headed GROUP BY doc_id, no)"""


def lines_of(docs: str) -> str:
    return f"SELECT doc_id, generate_subscripts(p, 1) AS line_no, unnest(p) AS text FROM (SELECT doc_id, string_split(regexp_replace(md, '\\n\\z', ''), chr(10)) AS p FROM {docs} WHERE md <> '')"


def _tables(name: str) -> str:
    return f"""SELECT doc_id, count(*) FILTER (WHERE f AND NOT coalesce(g, false)) AS blocks, count(*) FILTER (WHERE c) AS captions FROM (
 SELECT *, lag(f) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (SELECT doc_id, line_no, regexp_matches({trim("text")}, '^\\||.+\\|.+') AS f,
 regexp_matches(text, '(?i)^\\s*\\*{{0,2}}\\s*table\\s*\\d+[a-z]?(\\s|[:.-])') AS c FROM {name})) GROUP BY doc_id"""


def _sentences(docs: str, col: str) -> str:
    return f"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, {trim("unnest(p)")} AS sentence FROM (
 SELECT doc_id, string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {docs} WHERE {col} <> '')) WHERE {count("sentence", t.WORDS_CLASS)} >= 10"""


def _bounds(docs: str, col: str) -> str:
    good = lambda x: f"list_filter(list_transform(string_split_regex({x}, '\\n\\s*\\n'), lambda p: {trim('p')}), lambda p: length(p) > 20 AND {count('p', t.WORDS_CLASS)} >= 5)"
    body = f"string_split_regex({col}, '(?i)\\b(?:References|Bibliography|Works\\s+Cited)\\b')[1]"
    return f"SELECT doc_id, coalesce({good(col)}[1], '') AS first_paragraph, coalesce({good(body)}[-1], '') AS last_paragraph FROM {docs} WHERE {col} <> ''"


def seeded(*shifts: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {q(s)}" for k, s in enumerate(SEEDS))
    more = " || ".join(f"chr(10) || chr(10) || CASE (doc_id + {n}) % {len(SEEDS)} {cases} END" for n in shifts)
    return f"SELECT doc_id, md || {more} AS md FROM docs"


def lint_of(docs: str) -> str:
    """Findings of the documents of a CTE."""

    def holds(r):
        m = lambda p: f"regexp_matches(flat, {q('(?is)' + p)})"
        parts = [m(p) for p in r.all_of] + ["(" + " OR ".join(map(m, g)) + ")" for g in r.any_of] + [f"NOT {m(p)}" for p in r.none_of]
        return " AND ".join(parts)

    rows = [f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {r.confidence}::BIGINT AS confidence FROM f WHERE {holds(r)}" for r in lint.RULES]
    hits = [f"SELECT doc_id, '{r.rule_id}' AS rule_id, min(line_no) AS line FROM l WHERE regexp_matches(text, {q('(?i)' + r.line)}) GROUP BY doc_id" for r in lint.RULES]
    s, n = lint.SPARSE, lint.NEAR
    return f"""WITH f AS (SELECT doc_id, regexp_replace(md, '\\s+', ' ', 'g') AS flat FROM {docs}), l AS ({lines_of(docs)}),
 held AS ({" UNION ALL ".join(rows)}), hit AS ({" UNION ALL ".join(hits)})
 SELECT doc_id, rule_id, severity, confidence, line FROM held LEFT JOIN hit USING (doc_id, rule_id)
 UNION ALL SELECT doc_id, '{s[0]}', '{s[1]}', {s[2]}, min(line_no) FROM l WHERE regexp_matches(text, {q(s[3])}) AND contains(text, '|') GROUP BY doc_id
 UNION ALL SELECT doc_id, '{n[0]}', '{n[1]}', {n[2]}, y FROM (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(text, {q("(?i)" + n[3])})) AS x,
  min(line_no) FILTER (WHERE regexp_matches(text, {q("(?i)" + n[4])})) AS y FROM l GROUP BY doc_id) WHERE y - x BETWEEN 1 AND {n[5]}"""


CTES = {
    "docs": "SELECT DISTINCT paper_id AS doc_id, extracted_text AS md FROM original_converted WHERE extracted_text <> ''",
    "lines": lines_of("docs"),
    "chunks": chunks_of("lines"),
    "labels": "SELECT *, strip_accents(lower(heading)) AS label FROM chunks",
    "found_pairs": f"""SELECT DISTINCT doc_id, a, b FROM (
  SELECT i.doc_id, i.a, r.b FROM (SELECT doc_id, min(chunk_no) AS a FROM labels WHERE {any_of("label", structure.INTRODUCTION)} GROUP BY doc_id) i JOIN res r USING (doc_id)
  UNION SELECT i.doc_id, i.a, r.b FROM (SELECT doc_id, min(chunk_no) AS a FROM labels WHERE {any_of("label", structure.METHODS)} GROUP BY doc_id) i JOIN res r USING (doc_id)
  UNION SELECT i.doc_id, i.a, c.b FROM (SELECT doc_id, min(chunk_no) AS a FROM labels WHERE {any_of("label", structure.ABSTRACT)} GROUP BY doc_id) i
   JOIN (SELECT doc_id, max(chunk_no) AS b FROM labels WHERE {any_of("label", structure.CONCLUSION)} GROUP BY doc_id) c USING (doc_id)) WHERE a <> b""",
    "res": f"""SELECT doc_id, chunk_no AS b FROM (SELECT doc_id, chunk_no, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no DESC) AS r FROM labels
  WHERE {any_of("label", structure.RESULTS)}) WHERE r <= 2""",
    "section_pairs": """SELECT doc_id, 'c' || a AS first_id, 'c' || b AS second_id FROM (SELECT * FROM found_pairs UNION ALL
  SELECT doc_id, min(chunk_no), max(chunk_no) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM found_pairs) GROUP BY doc_id HAVING count(*) > 1)""",
    "groups": "SELECT doc_id, (n - 1) // 3 + 1 AS group_no, (n - 1) % 3 + 1 AS pos, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS n FROM chunks)",
    "pairs": """SELECT doc_id, md, CASE doc_id % 5 WHEN 1 THEN regexp_replace(md, '(?m)^#{1,6}[ ]+', '', 'g')
  WHEN 2 THEN md || chr(10) || repeat('Extra words that the conversion lost here. ', 30)
  WHEN 3 THEN md || replace('@@| a | b |@@more text@@| c | d |@@| e | f |@', '@', chr(10))
  WHEN 4 THEN 'Another opening paragraph, long enough to matter here.' || chr(10) || chr(10) || md ELSE md END AS source FROM docs""",
    "sources": "SELECT doc_id, source AS md FROM pairs",
    "source_lines": lines_of("sources"),
    "pages": """SELECT doc_id, page_no, CASE WHEN doc_id % 7 = 0 OR (doc_id % 3 = 0 AND page_no % 2 = 0) OR (doc_id % 11 = 1 AND page_no > 1) THEN '' ELSE text END AS text FROM (
  SELECT doc_id, (line_no - 1) // 40 + 1 AS page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)""",
    "refs": "SELECT DISTINCT ref_id, paper_id, ref_index, title, authors, year, doi, journal, raw_text FROM original_references",
    "biblio": """SELECT doc_id, ref_index::BIGINT * 1000 + i - 1 AS line_no, text FROM (SELECT paper_id AS doc_id, ref_index, generate_subscripts(p, 1) AS i, unnest(p) AS text
  FROM (SELECT *, string_split(raw_text, chr(10)) AS p FROM refs WHERE raw_text <> ''))""",
    "entries1": f"""SELECT doc_id, e1, string_agg(s, ' ' ORDER BY line_no) AS entry FROM (SELECT *, sum(CASE WHEN cue THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS e1 FROM (
  SELECT doc_id, line_no, {trim("text")} AS s, regexp_matches({trim("text")}, {q(b.NUMBERED)}) OR (NOT regexp_matches(text, '^[ \\t]') AND regexp_matches({trim("text")}[:120], {q(b.EARLY_YEAR)})
   AND (regexp_matches({trim("text")}, {q(b.AUTHOR_START)}) OR regexp_matches({trim("text")}, {q(b.NAME_YEAR)}))) AS cue FROM biblio) WHERE s <> '') GROUP BY doc_id, e1""",
    "entries": f"""SELECT doc_id, e2::BIGINT AS entry_no, string_agg(piece, ' ' ORDER BY e1, p) AS entry FROM (
  SELECT *, sum(CASE WHEN regexp_matches(piece, {q(b.AUTHOR_START)}) OR regexp_matches(piece, {q(b.INSTITUTION)}) OR regexp_matches(piece, {q(b.NUMBERED)}) THEN 1 ELSE 0 END)
   OVER (PARTITION BY doc_id ORDER BY e1, p) AS e2 FROM (SELECT doc_id, e1, generate_subscripts(a, 1) AS p, {trim("unnest(a)")} AS piece FROM (
    SELECT *, string_split(regexp_replace(entry, {q(b.INLINE)}, '.' || chr(1) || '\\1', 'g'), chr(1)) AS a FROM entries1)) WHERE piece <> '') GROUP BY doc_id, e2
  HAVING length(string_agg(piece, ' ' ORDER BY e1, p)) > 15""",
    "answers": """SELECT DISTINCT match_id, ref_id, coalesce(found, false) AS found, source, coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT), 9) AS tier, title, doi,
  CASE WHEN coalesce(similarity, 0) > 1 THEN similarity / 100 ELSE coalesce(similarity, 0) END AS similarity, year FROM match_results""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY (found AND similarity >= 0.85) DESC, CASE WHEN found AND similarity >= 0.85 THEN tier END NULLS FIRST,
  CASE WHEN found THEN similarity ELSE -1 END DESC, tier, match_id) AS r FROM answers) WHERE r = 1""",
    "verdicts": f"""SELECT ref_id, paper_id, CASE WHEN rs <> '' AND s0 <> 'suspicious' THEN 'suspicious' ELSE s0 END AS status,
  (CASE WHEN rs <> '' AND s0 = 'verified' THEN least(c0, 80) WHEN rs <> '' AND s0 = 'unverifiable' THEN greatest(c0, 40) ELSE c0 END)::BIGINT AS confidence, f, source, rs AS reasons FROM (
  SELECT *, CASE WHEN c0 IN (100, 90) THEN 'verified' WHEN c0 IN (60, 70, 75) THEN 'suspicious' ELSE 'unverifiable' END AS s0 FROM (
  SELECT *, CASE WHEN NOT f THEN 0 WHEN ex AND ti AND sim < 0.7 THEN 60 WHEN ex AND ti AND sim < 0.85 THEN 75 WHEN ex THEN 100 WHEN sim >= 0.85 THEN 90 WHEN sim >= 0.7 THEN 70 ELSE 0 END AS c0,
   concat_ws(',', CASE WHEN valid AND NOT f THEN 'R1' END, CASE WHEN n >= 4 AND NOT f THEN 'R2' END, CASE WHEN f AND sim < 0.85 THEN 'R3' END, CASE WHEN j <> '' AND NOT f THEN 'R4' END, CASE WHEN yy AND f THEN 'R5' END) AS rs FROM (
  SELECT r.ref_id, r.paper_id, b.source, coalesce(b.found, false) AS f, coalesce(b.similarity, 0) AS sim, {blank("r.title")} <> '' AND {blank("b.title")} <> '' AS ti,
   {blank("r.doi")} <> '' AND {blank("b.doi")} <> '' AND {loose(blank("r.doi"))} = {loose(blank("b.doi"))} AS ex, regexp_matches({blank("r.doi")}, '^10\\.\\d{{4,9}}/\\S+$') AS valid,
   {count(blank("r.title"), "[^ \t\n\r\f\v]+")} AS n, {blank("r.journal")} AS j, {blank("r.year")} <> '' AND {blank("b.year")} <> '' AND {blank("r.year")} <> {blank("b.year")} AS yy
  FROM refs r LEFT JOIN best b ON r.ref_id = b.ref_id)))""",
    "spots": f"""SELECT s.doc_id, count(*) AS checked, count(*) FILTER (WHERE contains({norm("p.md")}, {norm("s.sentence")})) AS hits FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || pos), pos) AS r FROM ({_sentences("pairs", "source")})) s JOIN pairs p USING (doc_id) WHERE r <= 20 GROUP BY s.doc_id""",
    "source_refs": f"""SELECT doc_id, CASE WHEN rest IS NULL THEN 0 WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 ELSE coalesce(list_position(list_transform(kept, lambda x: length(x) < 50 AND x = upper(x)
   AND len(regexp_split_to_array(x, '\\s+')) <= 5), true) - 1, len(kept)) END AS n FROM (
  SELECT doc_id, rest, {count("rest", "(?m)^\\s*\\[\\d+\\]")} AS n1, {count("rest", "(?:^|\\n)\\s*[A-Z][a-z]+[\\s,].*?\\(\\d{4}\\)")} AS n2, list_filter(list_transform(string_split(rest, chr(10)), lambda x: {trim("x")}), lambda x: x <> '') AS kept FROM (
  SELECT doc_id, CASE WHEN regexp_matches(source, {q(REF_WORD)}) THEN regexp_replace(source, {q("(?s)^.*?" + REF_WORD)}, '') END AS rest FROM pairs))""",
    "listed_refs": f"""SELECT doc_id, CASE WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 WHEN n3 >= 3 THEN n3 ELSE n4 END AS n FROM (
  SELECT doc_id, {count("rest", "(?m)^\\s*\\[?\\d+\\]?[.)]\\s")} AS n1, {count("rest", "(?m)^\\s*[-*]\\s+")} AS n2, {count("rest", "(?m)^\\s*[\\p{L}\\p{M}][^\\n,]{0,80},.*\\((?:19|20)\\d{2}[a-z]?\\)")} AS n3,
   len(list_filter(list_transform(string_split(rest, chr(10)), lambda x: {trim("x")}), lambda x: x <> '')) AS n4 FROM (
  SELECT doc_id, {trim("string_agg(text, chr(10) ORDER BY line_no)")} AS rest FROM (SELECT *, min(line_no) FILTER (WHERE ends AND line_no > start) OVER (PARTITION BY doc_id) AS stop FROM (
   SELECT *, max(line_no) FILTER (WHERE is_ref) OVER (PARTITION BY doc_id) AS start FROM (SELECT doc_id, line_no, text, {label("text")} IN ({", ".join(map(q, b.LABELS))}) AS is_ref,
    regexp_matches({trim("text")}, '^#{{1,3}}\\s+\\S') AND NOT regexp_matches({trim("text")}, {q(b.CONTINUATION)}) AS ends FROM lines))) WHERE line_no > start AND (stop IS NULL OR line_no < stop) GROUP BY doc_id))""",
    "conversion": f"""SELECT doc_id, CASE WHEN fs <> '' THEN 'FAIL' WHEN ws <> '' THEN 'WARN' ELSE 'PASS' END AS status, diff AS word_diff_pct, ws AS warnings, fs AS failures, checked AS spot_checked, hits AS spot_hits FROM (
  SELECT *, concat_ws(',', CASE WHEN sw = 0 THEN 'V0' END, CASE WHEN diff > 3 THEN 'V1' END, CASE WHEN st > 0 AND mt < st THEN 'V3' END, CASE WHEN checked - hits > 2 THEN 'V5' END,
   CASE WHEN NOT contains(hay, fp) OR NOT contains(hay, lp) THEN 'V6' END) AS fs,
   concat_ws(',', CASE WHEN abs(sh - mh) > 3 THEN 'V2' END, CASE WHEN NOT (st > 0 AND mt < st) AND abs(st - mt) > 1 THEN 'V3' END,
   CASE WHEN abs(sr - mr) > 2 THEN 'V4' END, CASE WHEN len(list_filter(caps, lambda c: NOT contains(hay, {norm("c[:100]")}))) > 0 THEN 'V7' END, CASE WHEN sf >= 15 AND abs(sf - mf) / greatest(sf, 1) * 100 > 10 THEN 'V8' END) AS ws FROM (
  SELECT p.doc_id, {count("source", t.WORDS_CLASS)} AS sw, abs({count("source", t.WORDS_CLASS)} - {count("md", t.WORDS_CLASS)}) / greatest({count("source", t.WORDS_CLASS)}, 1) * 100 AS diff,
   greatest(ts.blocks, ts.captions) AS st, greatest(tm.blocks, tm.captions) AS mt, coalesce(checked, 0) AS checked, coalesce(hits, 0) AS hits, {norm("md")} AS hay,
   {norm("first_paragraph[:200]")} AS fp, {norm("last_paragraph[:200]")} AS lp, hs.n AS sh, hm.n AS mh, hs.fn AS sf, hm.fn AS mf, sr.n AS sr, coalesce(mr.n, 0) AS mr,
   list_transform(regexp_extract_all(source, '(?i)(?:Figure|Fig\\.?)\\s*\\d+[.:]\\s*[^\\n]+'), lambda x: {trim("x")}) AS caps
  FROM pairs p LEFT JOIN source_refs sr USING (doc_id) LEFT JOIN listed_refs mr USING (doc_id) LEFT JOIN ({_tables("source_lines")}) ts USING (doc_id) LEFT JOIN ({_tables("lines")}) tm USING (doc_id) LEFT JOIN spots USING (doc_id) LEFT JOIN ({_bounds("pairs", "source")}) USING (doc_id)
   LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE {label("regexp_extract(text, '^#{1,3}\\s+(.+)$', 1)")} <> '' AND regexp_matches(text, '^#{{1,3}}\\s+.+$')) AS n,
     count(*) FILTER (WHERE regexp_matches(text, '^\\s*\\[\\^\\d+\\]:')) AS fn FROM source_lines GROUP BY doc_id) hs USING (doc_id)
   LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE {label("regexp_extract(text, '^#{1,3}\\s+(.+)$', 1)")} <> '' AND regexp_matches(text, '^#{{1,3}}\\s+.+$')) AS n,
     count(*) FILTER (WHERE regexp_matches(text, '^\\s*\\[\\^\\d+\\]:')) AS fn FROM lines GROUP BY doc_id) hm USING (doc_id)))""",
    "native": f"""SELECT doc_id, CASE WHEN words = 0 THEN 'FAIL' WHEN low OR sparse THEN 'WARN' ELSE 'PASS' END AS status, page_count, nonempty_pages, words, low::BIGINT + sparse::BIGINT AS warnings, (words = 0)::BIGINT AS failures FROM (
  SELECT *, words > 0 AND page_count >= 3 AND words < 150 AS low, nonempty_pages / page_count < 0.5 AS sparse FROM (SELECT doc_id, count(*) AS page_count,
   count(*) FILTER (WHERE {trim("text")} <> '') AS nonempty_pages, sum({count("text", t.WORDS_LETTER)})::BIGINT AS words FROM pages GROUP BY doc_id))""",
    "ref_counts": "SELECT paper_id AS doc_id, count(*) AS refs FROM refs GROUP BY paper_id",
    "modes": """SELECT *, CASE status WHEN 'PASS' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END * 100 + CASE WHEN spot_ratio IS NULL THEN -15.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, spot_ratio)) * 40 END
   + CASE WHEN word_diff IS NULL THEN -15.0::DOUBLE ELSE -greatest(0.0::DOUBLE, word_diff) * 2 END - warnings * 6 - failures * 20 + refs * 0.2::DOUBLE AS score FROM (
  SELECT c.doc_id, m.mode, m.o AS mode_ord, c.status, c.word_diff_pct AS word_diff, CASE WHEN m.o = 1 AND spot_checked > 0 THEN spot_hits / spot_checked END AS spot_ratio,
   len(list_filter(string_split(warnings, ','), lambda x: x <> '')) AS warnings, len(list_filter(string_split(failures, ','), lambda x: x <> '')) AS failures, coalesce(refs, 0) AS refs
  FROM conversion c CROSS JOIN (VALUES ('chunked', 1), ('no-chunk', 2)) m(mode, o) LEFT JOIN ref_counts USING (doc_id)
  UNION ALL SELECT n.doc_id, 'native', 3, n.status, NULL, NULL, n.warnings, n.failures, coalesce(refs, 0) FROM native n LEFT JOIN ref_counts USING (doc_id))""",
    "seed0": seeded(0),
    "lint0": lint_of("seed0"),
    "lint_modes": " UNION ALL ".join(f"SELECT 'm{k}' AS mode, * FROM ({lint_of(f'seedm{k}')})" for k in (1, 2, 3)),
    "seedm1": seeded(0, 1),
    "seedm2": seeded(1, 2),
    "seedm3": seeded(0, 2),
    "consensus": "SELECT doc_id, rule_id, arg_min(severity, mode) AS severity, max(confidence) AS max_confidence, string_agg(DISTINCT mode, ',' ORDER BY mode) AS present_in, count(DISTINCT mode) AS modes FROM lint_modes GROUP BY doc_id, rule_id HAVING count(DISTINCT mode) >= 2",
}
ORDER = ["docs", "lines", "chunks", "labels", "res", "found_pairs", "section_pairs", "groups", "pairs", "sources", "source_lines", "pages", "refs", "biblio", "entries1", "entries", "answers", "best", "verdicts", "spots", "source_refs", "listed_refs", "conversion", "native", "ref_counts", "modes", "seed0", "lint0", "seedm1", "seedm2", "seedm3", "lint_modes", "consensus"]


def sql(body: str) -> str:
    """body with the CTEs that it needs, directly or through others."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ORDER if n in need]
    return f"WITH {', '.join(parts)} {body}"


def fields_sql() -> str:
    year = q(b.YEAR)
    after = "regexp_replace(regexp_extract(c, '\\b(?:19|20)\\d{2}\\b(.*)$', 1), '^[ .)\\],;:]+', '')"
    head = f"regexp_replace(trim(string_split_regex(c, {year})[1]), '[(.,;]+$', '')"
    return sql(f"""SELECT ref_id, CASE WHEN year <> '' AND length({head}) BETWEEN 6 AND 499 THEN {head} WHEN instr(c, '.') - 1 BETWEEN 6 AND 299 THEN trim(c[:instr(c, '.') - 1]) ELSE '' END AS authors,
 CASE WHEN length(qd) > 10 THEN trim(qd) WHEN length(mk) > 10 THEN trim(mk) WHEN year <> '' AND instr({after}, '.') - 1 > 10 THEN trim(({after})[:instr({after}, '.') - 1]) ELSE '' END AS title, year,
 regexp_replace(regexp_replace(regexp_extract(t, {q(b.DOI)}, 1), '[<>{{}} ]', '', 'g'), '[.,;:)\\]}}''"]+$', '') AS doi,
 CASE WHEN len(sp) >= 2 THEN trim(sp[2]) WHEN len(sp) = 1 AND length(sp[1]) < 120 THEN trim(sp[1]) ELSE '' END AS journal FROM (
 SELECT *, regexp_extract(c, '["“](.+?)["”]', 1) AS qd, regexp_extract(c, '[*_](.+?)[*_]', 1) AS mk, regexp_extract_all(t, '[*_]([^*_]+)[*_]', 1) AS sp FROM (
 SELECT ref_id, t, regexp_replace(t, {q(b.NUMBERED)}, '') AS c, regexp_extract(t, {year}, 1) AS year FROM (SELECT ref_id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS t FROM refs) WHERE t <> ''))""")


def oracle_sql() -> dict[str, str]:
    dims = f"""SELECT doc_id, dimension, 1::BIGINT AS group_no, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY chunk_no) AS pos, chunk_id FROM (
  SELECT doc_id, chunk_no, chunk_id, 'math-logic' AS dimension FROM labels WHERE has_equations UNION ALL SELECT doc_id, chunk_no, chunk_id, 'empirical' FROM labels WHERE has_tables OR has_figures
  UNION ALL SELECT doc_id, chunk_no, chunk_id, 'literature' FROM labels WHERE {any_of("label", structure.LITERATURE)} UNION ALL SELECT doc_id, chunk_no, chunk_id, 'references' FROM labels WHERE {any_of("label", structure.REFERENCES)}
  UNION ALL SELECT doc_id, chunk_no, chunk_id, 'econometrics' FROM labels WHERE {any_of("label", structure.ECONOMETRICS)}
  UNION ALL SELECT doc_id, chunk_no, chunk_id, 'econometrics' FROM labels WHERE (has_tables OR has_figures) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE {any_of("label", structure.ECONOMETRICS)}))
 UNION ALL SELECT doc_id, d, group_no, pos, chunk_id FROM groups CROSS JOIN (VALUES ('notation'), ('exposition'), ('language')) x(d)
 UNION ALL SELECT doc_id, 'cross-section', n, k, CASE k WHEN 1 THEN first_id ELSE second_id END FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_id, second_id) AS n FROM section_pairs) CROSS JOIN (VALUES (1), (2)) y(k)"""
    heading = f"""SELECT doc_id, line_no, CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '^#{{1,6}}\\s+') THEN s
  WHEN free AND num <> '' AND regexp_matches(ttl, '\\p{{L}}') THEN repeat('#', least(4, len(string_split(num, '.')) + 1)::INT) || ' ' || num || '. ' || ttl
  WHEN free AND regexp_matches(s, {q(structure.PLAIN_TITLES)}) THEN '## ' || s ELSE regexp_replace(text, '[ \\t\\r]+$', '') END AS text FROM (
  SELECT *, length(s) <= 120 AND (coalesce(lag(s) OVER w, '') = '' OR coalesce(lead(s) OVER w, '') = '') AS free, regexp_extract(s, '^(\\d+(?:\\.\\d+)*)\\.\\s+(.+?)\\s*$', 1) AS num,
   regexp_extract(s, '^(\\d+(?:\\.\\d+)*)\\.\\s+(.+?)\\s*$', 2) AS ttl FROM (SELECT *, {trim("text")} AS s FROM lines) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
    section = f"""SELECT doc_id, start + 1 AS start_line, coalesce(min(line_no) FILTER (WHERE line_no > start AND ends AND NOT is_ref) - 1, max(line_no)) AS end_line FROM (
  SELECT *, max(line_no) FILTER (WHERE is_ref) OVER (PARTITION BY doc_id) AS start FROM (SELECT doc_id, line_no, {label("text")} IN ({", ".join(map(q, b.LABELS))}) AS is_ref,
   regexp_matches({trim("text")}, {q(b.NEXT_SECTION)}) AND NOT regexp_matches({trim("text")}, {q(b.CONTINUATION)}) AS ends FROM lines)) WHERE start IS NOT NULL GROUP BY doc_id, start"""
    captions = f"""SELECT doc_id, p AS pos, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {norm("caption")} ORDER BY p) AS r FROM (
  SELECT doc_id, generate_subscripts(a, 1) AS p, {trim("unnest(a)")} AS caption FROM (SELECT doc_id, list_concat(list_concat(regexp_extract_all(md, '!\\[([^\\]]+)\\]', 1),
   regexp_extract_all(md, '(?i)\\*\\*(?:Figure|Fig\\.?)\\s*\\d+[.:]\\*\\*[ \\t]*([^\\n]+)', 1)), regexp_extract_all(md, '(?im)^[ \\t]*(?:Figure|Fig\\.?)\\s*\\d+[.:][ \\t]*([^\\n]+)', 1)) AS a FROM docs)) WHERE caption <> '') WHERE r = 1"""
    one = "regexp_extract(authors, '^\\[?\\s*\"?([^\";\\]]*)', 1)"
    surname = f"strip_accents(lower(trim(CASE WHEN contains({one}, ',') THEN split_part({one}, ',', 1) ELSE regexp_extract(trim({one}), '([^ ]+)$', 1) END)))"
    paged = "SELECT doc_id, md || '  ' || repeat(chr(10), 6) || '--- end of page=7 ---' || chr(10) || chr(10) || '  --- end of page=8 ---  ' || repeat(chr(10), 4) || 'last line ' || chr(9) || chr(10) || chr(10) AS md FROM docs"
    valid = "regexp_matches(coalesce(trim(doi), ''), '^10\\.\\d{4,9}/\\S+$')"
    slug = "coalesce(nullif(replace(trim(regexp_replace(lower(slug), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), ''), 'paper')"
    pieces = """SELECT doc_id, chunk_id, piece, (SELECT min(y.line_no) FROM x y WHERE y.doc_id = o.doc_id AND y.chunk_id = o.chunk_id AND y.line_no <= o.first_line AND y.before + y.words > o.from_word - 30) AS start_line, end_line FROM o"""
    lone = "SELECT doc_id, mode, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mode ORDER BY rule_id) AS r FROM (SELECT DISTINCT doc_id, mode, rule_id FROM lint_modes ANTI JOIN consensus USING (doc_id, rule_id))) WHERE r <= 10"
    return {
        "lines": sql("SELECT * FROM lines"),
        "word_counts": sql(f"SELECT doc_id, {count('md', t.WORDS_BLANK)} AS blanks, {count('md', t.WORDS_LETTER)} AS letters, {count('md', t.WORDS_CLASS)} AS classes FROM docs"),
        "sentences": sql(_sentences("docs", "md")),
        "paragraph_bounds": sql(_bounds("docs", "md")),
        "chunk_map": sql(f"SELECT *, {any_of('label', structure.REFERENCES)} AS is_references, {any_of('label', structure.ABSTRACT)} AS is_abstract FROM labels").replace("SELECT *, (contains(label, 'references')", "SELECT * EXCLUDE (label), (contains(label, 'references')"),
        "single_chunks": sql(f"SELECT doc_id, 'c1' AS chunk_id, 'Document' AS heading, 0::BIGINT AS level, 1::BIGINT AS start_line, max(line_no) AS end_line, sum({count('text', t.WORDS_LETTER)})::BIGINT AS words FROM lines GROUP BY doc_id"),
        "page_chunks": sql(f"""SELECT doc_id, 'p' || page_no AS chunk_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim("x")}), lambda x: x <> '')[1][:120], 'Page ' || page_no) AS heading, 0::BIGINT AS level, 1::BIGINT AS start_line,
 greatest(1, len(string_split(text, chr(10)))) AS end_line, {count("text", t.WORDS_LETTER)} AS words, page_no AS page_start, page_no AS page_end FROM pages"""),
        "chunk_groups": sql("SELECT * FROM groups"),
        "section_pairs": sql("SELECT * FROM section_pairs"),
        "dimension_assignments": sql(dims),
        "heading_recovery": sql(heading),
        "bounded_pieces": sql(f"""SELECT * FROM (WITH x AS (SELECT c.doc_id, c.chunk_id, l.line_no, {count("l.text", t.WORDS_LETTER)} AS words, coalesce(sum({count("l.text", t.WORDS_LETTER)}) OVER (PARTITION BY c.doc_id, c.chunk_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
 FROM chunks c JOIN lines l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.start_line AND c.end_line), o AS (SELECT doc_id, chunk_id, before // 120 + 1 AS piece, min(line_no) AS first_line, max(line_no) AS end_line, min(before) AS from_word FROM x GROUP BY ALL) {pieces})"""),
        "paragraph_pieces": sql(f"""SELECT * FROM (WITH u AS (SELECT doc_id, run, min(line_no) AS line_no, max(line_no) AS last_line, sum(words)::BIGINT AS words FROM (SELECT *, sum(CASE WHEN s = '' OR regexp_matches(s, '^#{{1,3}}\\s+\\S') THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, {trim("text")} AS s, {count("text", t.WORDS_LETTER)} AS words FROM lines)) WHERE s <> '' GROUP BY doc_id, run), x AS (SELECT c.doc_id, c.chunk_id, u.line_no, u.last_line, u.words,
 coalesce(sum(u.words) OVER (PARTITION BY c.doc_id, c.chunk_id ORDER BY u.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM chunks c JOIN u ON u.doc_id = c.doc_id AND u.line_no BETWEEN c.start_line AND c.end_line),
 o AS (SELECT doc_id, chunk_id, before // 120 + 1 AS piece, min(line_no) AS first_line, max(last_line) AS end_line, min(before) AS from_word FROM x GROUP BY ALL) {pieces})"""),
        "reference_section": sql(section),
        "reference_entries": sql("SELECT * FROM entries"),
        "reference_fields": fields_sql(),
        "reference_raw": sql(f"""SELECT ref_id, CASE WHEN {blank("raw_text")} <> '' THEN raw_text ELSE concat_ws('. ', CASE WHEN {blank("authors")} <> '' THEN authors END, CASE WHEN {blank("year")} <> '' THEN '(' || year || ')' END,
 CASE WHEN {blank("title")} <> '' THEN title END, CASE WHEN {blank("journal")} <> '' THEN journal END, CASE WHEN {blank("doi")} <> '' THEN 'doi:' || doi END) END AS raw FROM refs"""),
        "doi_match": f"SELECT DISTINCT ref_id, record_id FROM (SELECT ref_id, {loose('doi')} AS d FROM original_references WHERE {valid}) JOIN (SELECT record_id, {loose('doi')} AS d FROM catalog_records WHERE {valid}) USING (d)",
        "reference_status": sql("SELECT ref_id, paper_id, status, confidence, CASE WHEN f AND confidence >= 70 THEN source END AS verified_by, reasons FROM verdicts"),
        "reference_summary": sql("SELECT paper_id, count(*) AS refs, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'suspicious') AS suspicious, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable FROM verdicts GROUP BY paper_id"),
        "lint_findings": sql("SELECT doc_id, rule_id, severity, confidence FROM lint0"),
        "lint_first_line": sql("SELECT doc_id, rule_id, coalesce(line, 0) AS line FROM lint0"),
        "lint_report": sql("SELECT doc_id, CASE WHEN count(rule_id) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(rule_id) AS finding_count, count(*) FILTER (WHERE severity = 'Major') AS major, coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS rules FROM seed0 LEFT JOIN lint0 USING (doc_id) GROUP BY doc_id"),
        "table_blocks": sql(_tables("lines")),
        "figure_captions": sql(captions),
        "conversion_report": sql("SELECT * FROM conversion"),
        "native_report": sql("SELECT * FROM native"),
        "spot_check": sql("SELECT * FROM spots"),
        "mode_scores": sql("SELECT doc_id, mode, status, score FROM modes"),
        "best_mode": sql("SELECT doc_id, mode, status, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (status = 'FAIL'), score DESC, mode_ord) AS r FROM modes) WHERE r = 1"),
        "consensus": sql("SELECT * FROM consensus"),
        "unique_findings": sql(lone),
        "confidence_gate": sql("SELECT CASE WHEN confidence < 50 THEN 'appendix' WHEN confidence < 80 THEN 'flag' ELSE 'keep' END AS gate, count(*) AS n FROM lint0 GROUP BY gate"),
        "precision_tiers": sql("SELECT CASE WHEN confidence >= 95 THEN 'A' WHEN confidence >= 90 THEN 'B' WHEN confidence >= 85 THEN 'B-flag' ELSE 'retry' END AS tier, count(*) AS n FROM lint0 GROUP BY tier"),
        "slugs": f"SELECT DISTINCT paper_id, {slug} AS slug FROM papers",
        "language_detect": sql("SELECT doc_id, CASE WHEN (contains(lower(md), 'javaslat')::INT + contains(lower(md), 'módszertan')::INT + contains(lower(md), 'hivatkozás')::INT + contains(lower(md), 'összefoglalás')::INT + contains(lower(md), 'értékelés')::INT + contains(lower(md), 'irodalomjegyzék')::INT + contains(lower(md), 'bírálói vélemény')::INT + contains(lower(md), 'főbb észrevételek')::INT + contains(lower(md), 'kisebb észrevételek')::INT) >= 2 THEN 'hu' ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md || ' Módszertan és Javaslat' ELSE md END AS md FROM docs)"),
        "title_extract": sql("SELECT doc_id, coalesce(nullif(trim(regexp_extract(md, '(?m)^#[ \\t]+([^\\n]+)$', 1)), ''), 'Untitled') AS title FROM docs"),
        "quote_exists": sql("SELECT doc_id, count(*) AS quotes, count(*) FILTER (WHERE contains(md, quote)) AS present FROM (SELECT doc_id, md, sentence || CASE WHEN pos % 4 = 0 THEN ' x' ELSE '' END AS quote FROM docs JOIN (SELECT * FROM (" + _sentences("docs", "md") + ")) USING (doc_id)) GROUP BY doc_id"),
        "citation_completeness": sql(f"""SELECT coalesce(c.paper_id, r.paper_id) AS paper_id, coalesce(c.surname, r.surname) AS surname, coalesce(c.year, r.year) AS year, c.year IS NOT NULL AS cited, r.year IS NOT NULL AS listed
 FROM (SELECT DISTINCT paper_id, strip_accents(lower(s)) AS surname, y AS year FROM (SELECT doc_id AS paper_id, unnest(regexp_extract_all(md, {q(m.CITED)}, 1)) AS s, unnest(regexp_extract_all(md, {q(m.CITED)}, 2)) AS y FROM docs)) c
 FULL JOIN (SELECT DISTINCT paper_id, surname, year FROM (SELECT paper_id, {surname} AS surname, regexp_extract(year, '((?:18|19|20)\\d{{2}})', 1) AS year FROM refs) WHERE surname <> '' AND year <> '') r
 ON c.paper_id = r.paper_id AND c.surname = r.surname AND c.year = r.year"""),
        "self_citations": sql(f"""SELECT paper_id, refs, own_refs, own_refs / refs AS share FROM (SELECT r.paper_id, count(*) AS refs, count(o.surname) AS own_refs FROM (SELECT DISTINCT paper_id, ref_id, {surname} AS surname FROM refs) r
 LEFT JOIN (SELECT paper_id, {surname} AS surname FROM (SELECT paper_id, arg_min_null(authors, ref_index) AS authors FROM refs GROUP BY paper_id)) o ON r.paper_id = o.paper_id AND r.surname = o.surname AND o.surname <> '' GROUP BY r.paper_id)"""),
        "acronym_inventory": sql(f"""SELECT doc_id, acronym, min(line_no) AS first_line, min(line_no) FILTER (WHERE w LIKE '(%)') AS defined_line, count(*) AS uses FROM (
 SELECT doc_id, line_no, w, regexp_replace(w, '[()]', '', 'g') AS acronym FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(text, '\\(?[\\p{{L}}\\p{{N}}_]+\\)?')) AS w FROM lines)) WHERE regexp_matches(acronym, {q(m.ACRONYM)}) GROUP BY doc_id, acronym"""),
        "number_check": sql(f"""SELECT doc_id, number, line_no, in_table FROM (SELECT doc_id, number, min(line_no) FILTER (WHERE NOT r) AS line_no, bool_or(r) AS in_table FROM (
 SELECT doc_id, line_no, regexp_matches({trim("text")}, '^\\|.*\\|$') AS r, unnest(regexp_extract_all(text, {q(m.NUMBER)})) AS number FROM lines) GROUP BY doc_id, number) WHERE line_no IS NOT NULL"""),
        "document_type": sql(f"SELECT doc_id, words, CASE WHEN words > 60000 THEN 'dissertation' ELSE 'article' END AS kind, words > 60000 AS by_chapter FROM (SELECT doc_id, {count('md', t.WORDS_LETTER)} AS words FROM docs)"),
        "reference_batches": sql("SELECT paper_id, ref_id, n // 20 + 1 AS batch_no, n % 20 + 1 AS pos FROM (SELECT paper_id, ref_id, row_number() OVER (PARTITION BY paper_id ORDER BY ref_index, ref_id) - 1 AS n FROM refs)"),
        "finding_gaps": sql(f"""SELECT f.doc_id, f.rule_id, trim(l.text) AS evidence, 'line ' || f.line AS location, concat_ws(',', CASE WHEN coalesce(trim(l.text), '') = '' THEN 'evidence' END, CASE WHEN f.line IS NULL THEN 'location' END) AS missing,
 coalesce(trim(l.text), '') <> '' AND f.line IS NOT NULL AS complete FROM lint0 f LEFT JOIN ({lines_of("seed0")}) l ON f.doc_id = l.doc_id AND f.line = l.line_no"""),
        "clean_text": sql(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, {q(c.SEPARATOR)}, '', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), {q(c.TRAILING)}, '', 'g'), '\\n\\z', '') || chr(10) AS md FROM ({paged})"),
        "document_stats": sql(f"SELECT doc_id, {count('md', c.SEPARATOR)} AS pages, {count('md', t.WORDS_BLANK)} AS words, {count('md', c.HEADING)} AS sections, {count('md', c.TABLE_RULE)} AS tables FROM ({paged})"),
        "year_values": sql("SELECT ref_id, nullif(regexp_extract(year, '(?:^|[^\\p{L}\\p{N}_])((?:18|19|20)\\d{2})(?:$|[^\\p{L}\\p{N}_])', 1), '') AS year, regexp_replace(trim(doi), '(?i)^https?://(?:dx\\.)?doi\\.org/', '') AS doi FROM refs"),
        "native_markdown": sql("SELECT doc_id, string_agg('## Page ' || page_no || chr(10) || chr(10) || trim(coalesce(text, '')) || chr(10), chr(10) ORDER BY page_no) AS md FROM pages GROUP BY doc_id"),
        "manifest": sql(f"""SELECT p.doc_id, '{{"paper":{{"slug":"' || p.slug || '"}},"chunking":{{"total_chunks":' || coalesce(c.n, 0) || '}},"references":{{"count":' || coalesce(r.refs, 0) || '}},"lint":{{"status":"'
 || CASE WHEN s.doc_id IS NULL THEN 'UNKNOWN' WHEN f.n > 0 THEN 'WARN' ELSE 'PASS' END || '","finding_count":' || coalesce(f.n, 0) || '}}}}' AS manifest FROM (SELECT DISTINCT paper_id AS doc_id, {slug} AS slug FROM papers) p
 LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id) LEFT JOIN ref_counts r USING (doc_id) LEFT JOIN seed0 s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM lint0 GROUP BY doc_id) f USING (doc_id)"""),
        "reference_counts": sql(f"""SELECT s.doc_id, s.n::BIGINT AS in_source, m.n::BIGINT AS in_md FROM ({CTES["source_refs"].replace("source", "md").replace("FROM pairs", "FROM docs")}) s LEFT JOIN listed_refs m USING (doc_id)"""),
        "stubs": sql(f"SELECT doc_id, dimension, '# ' || dimension || ' findings' || chr(10) || chr(10) || '_Nothing found yet._' || chr(10) AS body FROM docs CROSS JOIN (SELECT unnest([{', '.join(map(q, w.DIMENSIONS))}]) AS dimension)"),
        "text_footnotes": sql(f"SELECT doc_id, greatest({count('md', '(?:^|\\n)\\s*\\d{{1,3}}\\s+[A-Z]')}, {count('md', '(?:^|\\n)\\s*[*†‡§]\\s+\\S')}) AS footnotes FROM docs".replace("{{", "{").replace("}}", "}")),
        "symbol_inventory": sql("SELECT doc_id, symbol, min(line_no) AS first_line, count(*) AS uses FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(text, '\\\\[a-z]+')) AS symbol FROM lines) GROUP BY doc_id, symbol"),
    }
