"""Consistency rules over whole texts, compiled to one projection.

A rule holds where all of its `all_of` patterns match the text with blanks collapsed,
one pattern of every list in `any_of` does, and none of `none_of`. Rules are data:
pass your own list to extend them. Rules do not join with documents; each is a Column
of constant patterns, and all are evaluated in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.operators.structure import lines


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    confidence: int
    line: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = field(default=())
    none_of: tuple[str, ...] = ()


# The patterns, severities and confidences of the rules; all patterns ignore case.
RULES = [
    Rule("C01", "Major", 95, r"does not aim to provide cross-country comparisons", (r"does not aim to provide cross-country comparisons",), ((r"international context", r"reference group", r"across[- ]country", r"cross[- ]country"),)),
    Rule("C02", "Major", 90, r"do not simply track increases in GDP per capita", (r"development.?gender ratio paradox", r"changes\s+in\s+gender\s+composition\s+do\s+not\s+simply\s+track\s+increases\s+in\s+gdp\s+per\s+capita")),
    Rule("C03", "Major", 92, r"reject Hypothesis H\s*2", (r"reject Hypothesis H\s*2", r"trends in the share of female physicians.*closely aligned")),
    Rule("C04", "Minor", 80, r"United States and the United Kingdom", (r"United States and the United Kingdom.*approaching parity by 2023",)),
    Rule("C05", "Minor", 86, r"public-sector professions,\s*predominantly publicly financed health systems", (r"public-sector professions,\s*predominantly publicly financed health systems",)),
    Rule("C06", "Minor", 88, r"show the lowest, but still strong coefficients", (r"\(Hungary\s+and\s+Poland\s+show\s+the\s+lowest,\s+but\s+still\s+strong\s+coefficients\)",)),
    Rule("C07", "Major", 93, r"uniformly negative", (r"uniformly\s+negative", r"\bN/?A\b")),
    Rule("C10", "Minor", 85, r"gender-balanced labour markets", (r"gender-balanced labour markets", r"lower\s*[-–]\s*but\s+more\s+rapidly\s+increasing")),
    Rule("C11", "Minor", 82, r"only in isolated years", (r"only in isolated years",)),
    Rule("C12", "Major", 95, r"TITLE-ABS-KEY\s*\(effect\)\)", (r"TITLE-ABS-KEY\s*\(effect\)\)",)),
    Rule("C13", "Minor", 86, r"Poisson Pseudo Maximum Likelihood", (), ((r"third category is Poisson Pseudo Maximum Likelihood", r"structural gravity model with the PPML method"),)),
    Rule("C14", "Minor", 82, r"four stages:\s*early stages,\s*infancy,\s*development,\s*and maturity", (), ((r"four stages:\s*early stages,\s*infancy,\s*development,\s*and maturity", r"In the early days", r"In the early stages"),)),
    Rule("C15", "Minor", 84, r"Elsig\s*&\s*Klotz,\s*2022", (), ((r"Centralization.*Elsig\s*&\s*Klotz,\s*2022", r"Maturity.*Elsig\s*&\s*Klotz,\s*2022"),)),
    Rule("C16", "Major", 92, r"data-free flow clauses", (r"data-free flow clauses",)),
    Rule("C17", "Minor", 76, r"between the two countries", (r"between the two countries",)),
    Rule("C18", "Minor", 90, r"distribution of regular income", (r"distribution of regular income",)),
    Rule("C19", "Minor", 88, r"interactive items", (r"interactive items",)),
    Rule("C20", "Minor", 80, r"Report 2025 indicates", (r"Report 2025 indicates.*expected to increase.*to .*2024",)),
    Rule("C21", "Minor", 72, r"these mechanisms", (r"these mechanisms",)),
    Rule("C22", "Major", 99, r"The patients were screened", (r"The patients were screened",)),
    Rule("C23", "Minor", 85, r"financial development may play a regulatory role", (r"financial development may play a regulatory role",)),
    Rule("C24", "Minor", 83, r"On the one hand", (r"On the one hand", r"On the one hand.{0,240}However"), (), (r"On the other hand",)),
    Rule("C25", "Minor", 96, r"division of the GVC division of labor", (r"division of the GVC division of labor",)),
    Rule("C26", "Minor", 78, r"provides a reference for", (r"provides a reference for the .*Digital Partnership Agreement",)),
    Rule("C27", "Minor", 77, r"no longer limited to", (r"no longer limited to .* However, it has evolved",)),
    Rule("C28", "Major", 89, r"PRISMA", (r"\bPRISMA\b",), ((r"\bsignificant(?:ly)?\b", r"\bpromote(?:s|d)?\b", r"\benhance(?:s|d)?\b", r"\beffectively reduce\b", r"\bplayed a crucial role\b"),), (r"risk of bias", r"quality appraisal", r"quality assessment", r"evidence grading", r"identification strategy", r"endogeneity", r"study quality")),
    Rule("C29", "Major", 96, r"Research other than articles", (r"Research other than articles",), ((r"Handbook", r"\(pp\.\s*\d+\s*[-–]\s*\d+\)", r"Cambridge University Press", r"Springer", r"Research Paper", r"World Economy Brief", r"Heinrich-B[öo]ll"),)),
    Rule("C30", "Major", 84, r"Google Scholar returned\s*48", (r"Google Scholar returned\s*48",), ((r"global network", r"global governance", r"multi-?polar", r"global digital trade"),)),
    Rule("C31", "Major", 78, r"RQ1", (r"digital trade rules", r"\bRQ1\b", r"\bRQ2\b"), (), (r"digital trade rules.{0,160}\bdefined as\b",)),
    Rule("C32", "Major", 80, r"VOSviewer", (), ((r"VOSviewer", r"keyword co-occurrence"), (r"U\.S\.-centered", r"multi-centered", r"network pattern"))),
    Rule("C33", "Major", 87, r"coded the selected literature individually", (r"coded the selected literature individually",), (), (r"codebook", r"coding protocol", r"inter-rater", r"cross-check", r"double-cod")),
    Rule("C34", "Major", 90, r"anywhere in the article|TITLE-ABS-KEY|\(Topic\)", (), ((r"anywhere in the article", r"TITLE-ABS-KEY", r"\(Topic\)"),)),
    Rule("C35", "Minor", 84, r"narrowing the gap in information and communication technology", (r"constraints by narrowing the gap in information and communication technology",)),
    Rule("C36", "Minor", 79, r"has been stagnant", (r"has been stagnant.*Later, it gradually transitioned",)),
]
#: Sparse cells: a line with a pipe and a break before a single figure 0 to 2.
SPARSE = ("C08", "Major", 94, r"<br>\s*[0-2](?:\D|$)")
#: First hit of the second pattern at most so many lines after the first of the first pattern.
NEAR = ("C09", "Minor", 78, r"To interpret international differences", r"Regional specificities also include", 25)


#: What a rule says when it holds, and what to do about it.
TEXTS = {
    "C01": ("Cross-country claims contradict the stated scope", "Limit the claims to the stated scope, or widen the scope"),
    "C02": ("The paradox is named but growth is said not to explain it", "State what the paradox rests on"),
    "C03": ("A rejected hypothesis is described as aligned with the data", "Say which of the two holds"),
    "C04": ("Parity is claimed to be near without a source", "Give the figures of both countries"),
    "C05": ("Professions are equated with their financing", "Separate sector and financing"),
    "C06": ("The lowest coefficients are called strong in brackets", "Give the coefficients"),
    "C07": ("A sign is called uniform although cells are empty", "Name the empty cells"),
    "C08": ("Cells hold broken counts", "Check the table's cells"),
    "C09": ("An explanation is given twice within a few lines", "Join the two passages"),
    "C10": ("A market is called balanced and lower at once", "Name the measure of balance"),
    "C11": ("Isolated years carry a general claim", "List the years"),
    "C12": ("The search string has unbalanced brackets", "Correct the search string"),
    "C13": ("An estimator is classed inconsistently", "Use one name for the estimator"),
    "C14": ("Stages are listed and then told otherwise", "Use the stages as listed"),
    "C15": ("One source stands for two stages", "Give each stage its source"),
    "C16": ("A term reverses what is meant", "Write free data flow"),
    "C17": ("It is open which two countries are meant", "Name the countries"),
    "C18": ("A term of statistics is used loosely", "Name the distribution"),
    "C19": ("A coined term is not explained", "Write interaction terms"),
    "C20": ("A forecast lies before its source", "Check the years"),
    "C21": ("It is open which mechanisms are meant", "Name the mechanisms"),
    "C22": ("Patients are mentioned in a study without any", "Name what was screened"),
    "C23": ("A regulatory role is claimed without a test", "Write moderating role, and test it"),
    "C24": ("One hand has no other hand", "Give the second side, or drop the phrase"),
    "C25": ("A phrase repeats itself", "Drop the repetition"),
    "C26": ("A reference value is claimed for an agreement", "Say what it shows"),
    "C27": ("A sentence is cut where it should go on", "Join the two sentences"),
    "C28": ("Effects are claimed in a review without appraisal of its studies", "Appraise the risk of bias, or soften the claims"),
    "C29": ("Works other than articles are cited although excluded", "Change the criterion, or the list"),
    "C30": ("A single search carries global claims", "Search further databases, or limit the claims"),
    "C31": ("A construct of the questions is not defined", "Define it at first use"),
    "C32": ("A picture of a network carries claims of structure", "Give network measures"),
    "C33": ("Coding by one person has no protocol", "Describe the protocol and its checks"),
    "C34": ("Search fields are given in several notations", "State the fields searched in each database"),
    "C35": ("A gap is said to be both narrowed and a constraint", "State the direction"),
    "C36": ("Stagnation and transition follow each other without dates", "Give the dates"),
}


def lowered(pattern: str) -> str:
    """pattern in lower case, escapes aside; matching lower case text needs no flags then and is far faster."""
    return re.sub(r"\\.|[^\\]+", lambda m: m.group() if m.group()[0] == "\\" else m.group().lower(), pattern)


def anchor(pattern: str) -> str:
    """The longest plain text that every match of pattern holds, '' where alternatives leave none."""
    if "|" in re.sub(r"\\.|\[[^]]*\]|\((?:\?:)?[^()]*\)\??", "", pattern):
        return ""
    runs, run, i = [], "", 0
    while i < len(pattern):
        m = re.compile(r"\\(.)|\[[^]]*\]|\((?:\?:)?(?:[^()\\]|\\.)*\)|(.)", re.S).match(pattern, i)
        i = m.end()
        plain = m[1] if m[1] and not m[1].isalnum() else m[2] if m[2] and m[2] not in ".^$" else ""
        if i < len(pattern) and pattern[i] in "?*+{":
            plain = ""
            i = re.compile(r"[?*+]|\{[^}]*\}").match(pattern, i).end()
        if plain:
            run += plain
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def holds(text, pattern: str):
    """Whether lower case text matches; a plain search for the anchor goes first."""
    p = lowered(pattern)
    found = text.rlike(f"(?s){p}")
    a = anchor(p)
    return text.contains(a) & found if len(a) > 3 else found


def condition(rule: Rule, flat):
    """The Column that says whether a rule holds for a flat text in lower case."""
    out = F.lit(True)
    for p in rule.all_of:
        out = out & holds(flat, p)
    for group in rule.any_of:
        some = F.lit(False)
        for p in group:
            some = some | holds(flat, p)
        out = out & some
    for p in rule.none_of:
        out = out & ~holds(flat, p)
    return out


def findings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rule_id, severity, confidence, line): one row a document and rule that holds.

    line is the first line that matches the rule's own line pattern, null where the
    phrase runs over a line's end. Null and empty texts have no findings.
    """
    flat = F.lower(F.regexp_replace("md", r"\s+", " "))
    hits = F.array(
        *(F.when(condition(r, F.col("flat")), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"))) for r in rules)
    )
    held = (
        docs.where("md <> ''")
        .select("doc_id", flat.alias("flat"))
        .select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
        .select("doc_id", "h.*")
    )
    ls = lines(docs)
    text, low = F.col("text"), F.col("low")
    marks = F.array(
        *(F.when(holds(low, r.line), F.lit(r.rule_id)) for r in rules),
        F.when(text.contains("|") & text.rlike(SPARSE[3]), F.lit(SPARSE[0])),
        F.when(holds(low, NEAR[3]), F.lit("near-a")),
        F.when(holds(low, NEAR[4]), F.lit("near-b")),
    )
    first = (
        ls.withColumn("low", F.lower("text")).select("doc_id", "line_no", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("rule_id"))
        .groupBy("doc_id", "rule_id")
        .agg(F.min("line_no").alias("line"))
    )
    by_line = held.join(first, ["doc_id", "rule_id"], "left")
    one = lambda rid, sev, conf: (F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"))
    sparse = first.where(F.col("rule_id") == SPARSE[0]).select("doc_id", *one(*SPARSE[:3]), "line")
    a = F.max(F.when(F.col("rule_id") == "near-a", F.col("line")))
    b = F.max(F.when(F.col("rule_id") == "near-b", F.col("line")))
    near = (
        first.where("rule_id in ('near-a', 'near-b')").groupBy("doc_id").agg(a.alias("a"), b.alias("b"))
        .where(F.col("b") - F.col("a") > 0).where(F.col("b") - F.col("a") <= NEAR[5])
        .select("doc_id", *one(*NEAR[:3]), F.col("b").alias("line"))
    )
    cols = ["doc_id", "rule_id", "severity", "confidence", "line"]
    return by_line.select(cols).unionByName(sparse.select(cols)).unionByName(near.select(cols))


def detailed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with finding_text, evidence, location and correction: the rule's texts, the line as it stands, and its number.

    A finding without a line has null evidence and location; rules of your own have no texts.
    """
    texts = F.create_map(*(F.lit(x) for k, (a, b) in TEXTS.items() for x in (f"{k}t", a))), F.create_map(*(F.lit(x) for k, (a, b) in TEXTS.items() for x in (f"{k}c", b)))
    said = lines(docs).select("doc_id", F.col("line_no").alias("line"), F.trim("text").alias("evidence"))
    j = found.join(said, ["doc_id", "line"], "left")
    return j.select(
        *found.columns,
        F.try_element_at(texts[0], F.concat("rule_id", F.lit("t"))).alias("finding_text"),
        "evidence",
        F.concat(F.lit("line "), F.col("line").cast("string")).alias("location"),
        F.try_element_at(texts[1], F.concat("rule_id", F.lit("c"))).alias("correction"),
    )


def report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, status, finding_count, major, rules): WARN where a document has findings, else PASS."""
    per = found.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "Major").alias("m"), F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("rules")
    )
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("status"),
        F.coalesce("n", F.lit(0)).alias("finding_count"),
        F.coalesce("m", F.lit(0)).alias("major"),
        F.coalesce("rules", F.lit("")).alias("rules"),
    )


def consensus(found: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, max_confidence, present_in, modes): findings in two modes or more. found: with a column mode."""
    return (
        found.groupBy("doc_id", "rule_id")
        .agg(F.min_by("severity", "mode").alias("severity"), F.max("confidence").alias("max_confidence"), F.array_sort(F.collect_set("mode")).alias("m"))
        .where(F.size("m") >= 2)
        .select("doc_id", "rule_id", "severity", "max_confidence", F.array_join("m", ",").alias("present_in"), F.size("m").alias("modes"))
    )


def unique_findings(found: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, mode, rule_id): findings that only one mode has, the first ten of each document and mode."""
    both = consensus(found).select("doc_id", "rule_id")
    lone = found.select("doc_id", "mode", "rule_id").distinct().join(both, ["doc_id", "rule_id"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("doc_id", "mode").orderBy("rule_id"))
    return lone.withColumn("rn", rn).where(F.col("rn") <= most).select("doc_id", "mode", "rule_id")
