"""Verification of references: doi join, tiered lookup, decision table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import loose
from foliolens.session import ship, written

# Thresholds of title similarity, pattern of a doi.
VERIFIED, REVIEW = 0.85, 0.70
VALID_DOI = r"^10\.\d{4,9}/\S+$"
#: Rare words of a wanted and of a listed title, rare trigrams of titles of fewer words than SHORT, characters
#: of a title up to which common subsequences are measured.
RARE_WORDS, LISTED_WORDS, RARE_GRAMS, SHORT, LONG = 5, 16, 8, 7, 256


def _valid(col):
    return F.coalesce(F.trim(col), F.lit("")).rlike(VALID_DOI)


def doi_matches(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(ref_id, record_id): equal dois, punctuation and case aside; only valid ones count."""
    a = refs.where(_valid(F.col("doi"))).select("ref_id", loose(F.col("doi")).alias("d")).distinct()
    b = records.where(_valid(F.col("doi"))).select("record_id", loose(F.col("doi")).alias("d")).distinct()
    return a.join(b, "d").select("ref_id", "record_id")


def year_of(col):
    """The year of a value: the first of 1800 to 2099 that stands as a number of its own, else null."""
    return F.nullif(F.regexp_extract(col.cast("string"), r"(?<![\p{L}\p{N}_])((?:18|19|20)\d{2})(?![\p{L}\p{N}_])", 1), F.lit(""))


def first_year(issued, printed, online, created):
    """A record's year: that of its issue, else of print, of online publication, of creation."""
    return F.coalesce(*(year_of(c) for c in (issued, printed, online, created)))


def bare_doi(col):
    """A doi without the resolver's address."""
    return F.regexp_replace(F.trim(col), r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def query_text(title, authors, tier: int):
    """What a catalog is asked for: the title, in the first tier with the first two of an array of authors."""
    words = F.trim(F.coalesce(title, F.lit("")))
    return F.trim(F.concat_ws(" ", words, F.array_join(F.slice(F.coalesce(authors, F.array().cast("array<string>")), 1, 2), " "))) if tier == 1 else words


def similarity(a, b):
    """Ratcliff-Obershelp ratio of two columns of loose titles, the first one leading; an Arrow UDF."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(x, y, strict=True):
            if (r := known.get(key)) is None:
                r = known[key] = 1.0 if key[0] == key[1] else SequenceMatcher(None, *key).ratio()
            out.append(r)
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def common_length(titles: list[str], others: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs of titles, bit-parallel over all of them at once."""
    x_at, x = pd.factorize(np.array(titles, dtype=object))
    y_at, y = pd.factorize(np.array(others, dtype=object))

    def points(texts):
        """The code points of texts, one row each, 0 behind the end."""
        sizes = np.array([len(s) for s in texts])
        out = np.zeros((len(texts), max(1, sizes.max(initial=0))), np.uint32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return out

    px, py = points(x), points(y)
    alphabet = np.unique(np.concatenate([[0], px.ravel()]))
    rank = lambda p: np.where(alphabet[k := np.minimum(np.searchsorted(alphabet, p), len(alphabet) - 1)] == p, k, 0)
    words = -(-px.shape[1] // 64)
    masks = np.zeros((len(x), len(alphabet), words), np.uint64)
    row, col = np.nonzero(px)
    np.bitwise_or.at(masks, (row, rank(px)[row, col], col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    v = np.full((words, len(x_at)), ~np.uint64(0))
    for letters in rank(py).T:
        m = masks[x_at, letters[y_at]]
        carry = None
        for w in range(words):
            old = v[w]
            hit = old & m[:, w]
            new = old + hit
            over = new < old
            if carry is not None:
                new += carry
                over |= new < carry
            carry = over.astype(np.uint64)
            v[w] = new | (old - hit)
    # what is in common is cleared, what lies behind the end of a title stays set
    return np.bitwise_count(~v).sum(0, dtype=np.int64)


def highest(a, b):
    """The most that the ratio of two columns of titles can be: of what both have in order, or of the letters both have
    where a title is longer than LONG; an Arrow UDF."""

    @F.pandas_udf("double")
    def most(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = np.ones(len(x))
        sizes, others = x.str.len().to_numpy(), y.str.len().to_numpy()
        brief = np.flatnonzero((sizes <= LONG) & (others <= LONG))
        brief = brief[np.argsort(sizes[brief], kind="stable")]
        for k in np.flatnonzero((sizes > LONG) | (others > LONG)):
            out[k] = SequenceMatcher(None, x.iloc[k], y.iloc[k]).quick_ratio()
        for part in np.array_split(brief, -(-len(brief) // 2000)) if len(brief) else ():
            out[part] = 2 * common_length(x.iloc[part].tolist(), y.iloc[part].tolist()) / (sizes[part] + others[part])
        return pd.Series(out)

    return most(a, b)


def _pairs(s, pair):
    """pair(a, b, s) of all positions a < b of the sorted array s of tokens."""
    to = lambda n: F.sequence(F.lit(1), n)
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(s)), lambda b: F.transform(to(b - 1), lambda a: pair(a, b, s))))


def _key(a, b, s):
    return F.xxhash64(F.element_at(s, a), F.element_at(s, b))


def _key_and_before(a, b, s):
    """The key of a pair, and the tokens that would make an earlier one."""
    return F.struct(_key(a, b, s).alias("key"), F.filter(F.slice(s, 1, b - 1), lambda w: w != F.element_at(s, a)).alias("before"))


def _rarest(titles: DataFrame, tokens, counts: DataFrame, most: int) -> DataFrame:
    """(t, rare): the at most `most` rarest tokens of each title, of those that counts (w, n) knows, at least two, sorted."""
    each = titles.select("t", F.explode(tokens).alias("w")).join(counts, "w")
    few = each.groupBy("t").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "w"))), 1, most)["w"].alias("rare"))
    return few.where("size(rare) > 1").select("t", F.array_sort("rare").alias("rare"))


def _words(col):
    return F.array_distinct(F.split(col, " "))


def _grams(col):
    """The trigrams of a title; of an empty one none."""
    at = F.sequence(F.lit(1), F.greatest(F.length(col) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda k: F.substring(col, k, F.lit(3))))


def _near(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(t, tier, u, record_id, most): listed titles that share two rare tokens with a wanted one and may reach the
    ratio of 0.70; most bounds it from above."""
    spread = max(1, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # few bytes make many pairs of tokens, and those many pairs of titles, so both are dealt out to all partitions
    wanted = wanted.repartition(spread, "t")
    titles = listed.select(F.col("u").alias("t")).distinct().repartition(spread, "t")
    few = F.size(_words(F.col("t"))) < SHORT
    parts = []
    for tokens, ours, theirs, mine, its in ((_words, wanted, titles, RARE_WORDS, LISTED_WORDS), (_grams, wanted.where(few), titles.where(few), RARE_GRAMS, RARE_GRAMS)):
        counts = theirs.select(F.explode(tokens(F.col("t"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        x = _rarest(ours, tokens(F.col("t")), counts, mine).select("t", F.inline(_pairs(F.col("rare"), _key_and_before)))
        y = _rarest(theirs, tokens(F.col("t")), counts, its).select(F.col("t").alias("u"), "rare", F.explode(_pairs(F.col("rare"), _key)).alias("key"))
        bound = F.floor((F.length("t") + F.length("u")) * (1 - REVIEW) + 1e-6)
        near = x.repartition(spread, "key").join(y.repartition(spread, "key"), "key").where(F.abs(F.length("t") - F.length("u")) <= bound)
        # two titles that meet in several pairs are judged at the first one
        near = near.where(~F.arrays_overlap("before", "rare"))
        parts.append(near.select("t", "u", highest(F.col("t"), F.col("u")).alias("most")).where(F.col("most") >= REVIEW - 1e-9))
    return parts[0].union(parts[1]).distinct().join(listed, "u")


def lookup(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(ref_id, tier, record_id, similarity): the best record of each catalog tier for each reference.

    A record of the same valid doi wins at once, with the similarity of the titles, or 1
    where one is missing. Else, as a catalog's search does, records are found by the words of
    the title: an equal title, or two of the title's RARE_WORDS rarest words among those that
    the catalogs know at all; titles of fewer than SHORT words, as those of scripts without
    blanks, by two of their rarest trigrams. The record of the highest ratio from 0.70 on is
    taken, the lowest record_id on ties. Every title found is judged: what two titles have in order
    bounds their ratio, the one of the best bound is measured first, then only those whose bound is
    not below that. A null or empty title finds nothing, nor is it found.
    """
    ship(refs.sparkSession)
    r = refs.select("ref_id", loose(F.coalesce("title", F.lit(""))).alias("t")).distinct()
    c = records.select("record_id", "tier", loose(F.coalesce("title", F.lit(""))).alias("u")).distinct()
    by_doi = doi_matches(refs, records).join(r, "ref_id").join(c, "record_id").select("ref_id", "record_id", "tier", "t", "u")
    missing = (F.col("t") == "") | (F.col("u") == "")
    by_doi = by_doi.select("ref_id", "tier", "record_id", F.when(missing, 1.0).otherwise(similarity("t", "u")).alias("similarity"), F.lit(1).alias("exact"))
    listed = c.where("u <> ''").groupBy("tier", "u").agg(F.min("record_id").alias("record_id"))
    titles = r.where("t <> ''").select("t").distinct()
    equal = titles.join(listed.withColumnRenamed("u", "t"), "t").select("t", "tier", "record_id", F.lit(1.0).alias("similarity"))
    near = written(_near(titles, listed).join(equal.select("t", "tier"), ["t", "tier"], "left_anti"))
    best_first = F.struct(F.col("most"), -F.col("record_id"))
    first = near.groupBy("t", "tier").agg(F.max_by(F.struct("u", "record_id"), best_first).alias("x")).select("t", "tier", "x.*")
    first = written(first.withColumn("similarity", similarity("t", "u")))
    others = near.join(first.select("t", "tier", F.col("record_id").alias("at"), F.col("similarity").alias("least")), ["t", "tier"])
    # the bound is rounded outwards
    others = others.where((F.col("record_id") != F.col("at")) & (F.col("most") >= F.col("least") - 1e-9)).withColumn("similarity", similarity("t", "u"))
    cols = ("t", "tier", "record_id", "similarity")
    found = equal.unionByName(first.select(*cols)).unionByName(others.select(*cols)).where(F.col("similarity") >= REVIEW)
    top = found.groupBy("t", "tier").agg(F.max(F.struct("similarity", (-F.col("record_id")).alias("last"))).alias("b"))
    top = top.select("t", "tier", (-F.col("b.last")).alias("record_id"), "b.similarity")
    by_title = r.join(top, "t").select("ref_id", "tier", "record_id", "similarity", F.lit(0).alias("exact"))
    best = Window.partitionBy("ref_id", "tier").orderBy(F.desc("exact"), F.desc("similarity"), "record_id")
    return by_doi.unionByName(by_title).withColumn("r", F.row_number().over(best)).where("r = 1").select("ref_id", "tier", "record_id", "similarity")


def cascade(answers: DataFrame) -> DataFrame:
    """One answer a reference: the first tier from 0.85 on, else the highest similarity, the earlier tier on ties.

    answers: ref_id, found, tier, similarity, and any other columns, which are kept.
    """
    good = F.col("found") & (F.col("similarity") >= VERIFIED)
    order = Window.partitionBy("ref_id").orderBy(
        F.desc(good), F.when(good, F.col("tier")), F.desc(F.when(F.col("found"), F.col("similarity")).otherwise(F.lit(-1.0))), "tier", "match_id"
    )
    return answers.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def verdicts(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """(ref_id, status, confidence, verified_by, reasons): what the best answer says of each reference.

    answers: match_id, ref_id, found, source, tier, title, doi, similarity, year; references
    without an answer count as not found. reasons are R1 to R5, joined by commas.
    """
    best = cascade(answers).select("ref_id", "found", "source", F.col("title").alias("m_title"), F.col("doi").alias("m_doi"), "similarity", F.col("year").alias("m_year"))
    j = refs.join(best, "ref_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    sim = F.coalesce("similarity", F.lit(0.0))
    titled = (blank("title") != "") & (blank("m_title") != "")
    exact = (blank("doi") != "") & (blank("m_doi") != "") & (loose(blank("doi")) == loose(blank("m_doi")))
    f = F.col("found")
    confidence = (
        F.when(~f, 0)
        .when(exact & titled & (sim < REVIEW), 60)
        .when(exact & titled & (sim < VERIFIED), 75)
        .when(exact, 100)
        .when(sim >= VERIFIED, 90)
        .when(sim >= REVIEW, 70)
        .otherwise(0)
    )
    words = F.size(F.filter(F.split(blank("title"), r"\s+"), lambda w: w != ""))
    years = (blank("year") != "") & (blank("m_year") != "") & (blank("year") != blank("m_year"))
    reasons = F.array(
        F.when(_valid(F.col("doi")) & ~f, "R1"),
        F.when((words >= 4) & ~f, "R2"),
        F.when(f & (sim < VERIFIED), "R3"),
        F.when((blank("journal") != "") & ~f, "R4"),
        F.when(years & f, "R5"),
    )
    out = j.withColumn("c0", confidence).withColumn("reasons", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ","))
    base = F.when(F.col("c0").isin(100, 90), "verified").when(F.col("c0").isin(60, 70, 75), "suspicious").otherwise("unverifiable")
    some = F.col("reasons") != ""
    out = out.withColumn("s0", base)
    status = F.when(some & (F.col("s0") != "suspicious"), "suspicious").otherwise(F.col("s0"))
    conf = F.when(some & (F.col("s0") == "verified"), F.least("c0", F.lit(80))).when(some & (F.col("s0") == "unverifiable"), F.greatest("c0", F.lit(40))).otherwise(F.col("c0"))
    out = out.withColumn("status", status).withColumn("confidence", conf)
    return out.select("ref_id", "paper_id", "status", "confidence", F.when(f & (F.col("confidence") >= 70), F.col("source")).alias("verified_by"), "reasons")


def summary(v: DataFrame) -> DataFrame:
    """(paper_id, refs, verified, suspicious, unverifiable)."""
    return v.groupBy("paper_id").agg(
        F.count("*").alias("refs"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "suspicious", "unverifiable"))
    )


def raw_fallback(refs: DataFrame) -> DataFrame:
    """(ref_id, raw): raw_text, or authors, (year), title, journal and doi joined by '. '."""
    some = lambda c, x: F.when(F.coalesce(F.trim(c), F.lit("")) != "", x)
    built = F.concat_ws(
        ". ", some("authors", F.col("authors")), some("year", F.concat(F.lit("("), "year", F.lit(")"))), some("title", F.col("title")),
        some("journal", F.col("journal")), some("doi", F.concat(F.lit("doi:"), "doi")),
    )
    return refs.select("ref_id", F.coalesce(some("raw_text", F.col("raw_text")), built).alias("raw"))
