"""Problem 2: map values typed freely to the entries of a list.

A set-similarity join with prefix filter: a value and every rendering of an entry
(its name, its abbreviation, its words cut short) become sets of letter trigrams,
ordered by how rare a trigram is in all of them. Two sets of Jaccard similarity t
must share one of their rarest 1 - t; only those prefixes are joined, with the
length and the positional filter in the join, and the similarity of what is left
is computed exactly. Of the survivors, those whose words agree one by one, up to
typing errors and cuts, count, and the best is kept; a value without any has no
entry. Trigrams are over a fixed alphabet, so their ranks are at most 28^3 rows.
Initials share no trigram with a name: a value in capitals that no words explain is
joined with the initials of the entries, where they are those of one entry only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.lookalike import normalised, skeleton
from foliolens.session import ship, table, written

THRESHOLD = 0.4
# Words that titles of journals have or lack at will.
STOP = set("the of and for in on der die das fur fuer de la le les du des et und a an y und az".split())
_NOISE = re.compile(
    r"^\W*(?:in\s*:\s*)?|[*_\"“”]+|[,;]?\s*\bvol\.?\s*\d.*$|[,;]?\s*\bpp?\.\s*\d.*$|[,;]?\s*\d+\s*\(\s*\d*\s*\)\s*(?:[:,]\s*[\d–-]+)?\s*$|[,;]\s*\d+\s*$|\s*\(\s*(?:19|20)\d\d\s*\)\s*$",
    re.I,
)
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def folded(text: str) -> str:
    """Lower case letters without accents."""
    t = unicodedata.normalize("NFKD", skeleton(normalised(text)).lower().translate(_SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c))


def key_of(value: str) -> str:
    """A value's words that matter, folded; a final ~ marks that its end is cut off."""
    t = _NOISE.sub("", normalised(value)).strip()
    cut = t.endswith(("…", "."))
    t = folded(t.replace("&", " and "))
    t = re.sub(r"[-‐‑–'’]", "", t)
    words = [w for w in re.findall(r"[^\W\d_]+", t)]
    words = [w for k, w in enumerate(words) if w not in STOP or (cut and k == len(words) - 1 and k > 1)]
    return " ".join(words) + (" ~" if cut and words else "")


def renderings(name: str, abbrev: str | None) -> list[str]:
    """The ways an entry may be written, as keys."""
    full = key_of(name).replace(" ~", "")
    words = full.split()
    out = [full, *(" ".join(w[:n] for w in words) for n in (3, 4, 5))]
    if words and words[0] == "international":
        out.append(" ".join(["int", "j", *words[2:]]))
    if "journal" in words:
        out += [" ".join("j" if w == "journal" else w[:n] for w in words) for n in (3, 4, 5, 99)]
    if abbrev and abbrev.strip():
        out.append(key_of(abbrev).replace(" ~", ""))
    return list(dict.fromkeys(x for x in out if x))


_CAPITALS = re.compile(r"(?:[^\W\d_]\s*\.?\s*){2,}")


def initials_of(value: str) -> str | None:
    """The letters of a value that may be initials: two or more capitals, with or without dots and blanks."""
    t = _NOISE.sub("", normalised(value)).strip()
    if not _CAPITALS.fullmatch(t) or t != t.upper():
        return None
    return re.sub(r"[\W\d_]+", "", folded(t)) or None


def initials(name: str) -> list[str]:
    """The initials of a name's words that matter, and of all its words."""
    every = re.findall(r"[^\W\d_]+", re.sub(r"[-‐‑–'’]", "", folded(normalised(name).replace("&", " and "))))
    lists = (key_of(name).replace(" ~", "").split(), every)
    return list(dict.fromkeys("".join(w[0] for w in ws) for ws in lists if len(ws) > 1))


def grams(key: str) -> list[str]:
    """The set of letter trigrams of a key's words; other letters than a to z are one."""
    out = set()
    for w in key.replace(" ~", "").split():
        w = "^" + "".join(c if "a" <= c <= "z" else "?" for c in w)
        out.update(w[i : i + 3] for i in range(max(1, len(w) - 2)))
    return sorted(out)


@lru_cache(maxsize=100_000)
def _distance(a: str, b: str) -> int:
    """Edits between two words, swapped neighbours count once."""
    if a == b:
        return 0
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return rows[-1][-1]


def _word(a: str, b: str, last_cut: bool) -> float:
    """How well the word a of a value stands for the word b of an entry; 0 for not at all."""
    if a == b:
        return 1.0
    if b.startswith(a):
        return 0.95 if len(a) >= 3 or last_cut else 0.9
    if abs(len(a) - len(b)) <= 2:
        d = _distance(a, b)
        most = 0 if len(b) < 4 else 1 if len(b) < 6 else 2
        if d <= most and (d < 2 or a[0] == b[0] or a[:1] in b[:2]):
            return 0.9 - 0.1 * d
    if 3 <= len(a) < len(b):
        # an abbreviation with a typing error
        d = min(_distance(a, b[:n]) for n in (len(a) - 1, len(a), len(a) + 1))
        if d <= 1 and (len(a) >= 4 or a[0] == b[0]):
            return 0.75 if a[0] == b[0] else 0.7
    return 0.0


@lru_cache(maxsize=100_000)
def _small_word(w: str) -> bool:
    """Whether w may be a stop word with a typing error, or cut short."""
    return len(w) <= 5 and any(_distance(w, s) <= 1 or (len(w) > 1 and s.startswith(w)) for s in STOP if len(s) > 1)


def agreement(key: str, entry: str) -> float:
    """How well a value's key and an entry's full key agree word by word, 0 to 1."""
    cut = key.endswith(" ~")
    a, b = key.replace(" ~", "").split(), entry.split()
    if not a or not b:
        return 0.0
    for k in range(len(a) - 1, -1, -1):
        if len(a) <= len(b) and not cut:
            break
        if _small_word(a[k]) and not any(w.startswith(a[k]) for w in b):
            del a[k]
    if not a:
        return 0.0
    if len(a) == len(b) or (cut and len(a) < len(b)):
        score = 1.0
        for k, (x, y) in enumerate(zip(a, b)):
            s = _word(x, y, cut and k == len(a) - 1)
            if not s:
                break
            score += s - 1
        else:
            missing = len(b) - len(a)
            return max(0.05, score - 0.05 * missing) if not missing or len(a) >= 2 else 0.0
    joined, whole = "".join(a), "".join(b)
    if not cut and abs(len(joined) - len(whole)) <= 2 and len(whole) >= 8 and abs(len(a) - len(b)) <= 1:
        d = _distance(joined, whole)
        if d <= 2:
            return 0.9 - 0.1 * d
    return 0.0


def similarity_join(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, rid, similarity) of all keys and renderings with Jaccard >= threshold.

    values: key; entries: rid, key; keys distinct within values. Empty keys match nothing.
    """
    spark = values.sparkSession
    ship(spark)

    def count(batches):
        from collections import Counter

        for b in batches:
            total: Counter = Counter()
            for k in b["key"]:
                total.update(grams(k))
            yield pd.DataFrame({"g": list(total), "n": list(total.values())}, columns=["g", "n"])

    both = values.select("key").union(entries.select("key"))
    # at most 28^3 rows, whatever the tables
    found = both.mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    rank = {r.g: k for k, r in enumerate(sorted(found, key=lambda r: (r.n, r.g)))}

    @F.pandas_udf("array<int>")
    def ranked(s: pd.Series) -> pd.Series:
        return s.map(lambda k: sorted(rank[g] for g in grams(k)))

    def sets(df, *cols):
        return df.withColumn("set", ranked("key")).where("size(set) > 0").select(*cols, "set", F.size("set").alias("n"))

    def prefixes(df, *cols):
        keep = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
        return df.select(*cols, "n", F.posexplode(F.slice("set", 1, keep)).alias("pos", "gram"))

    # read back as a few small files, so dealt out evenly again before the sets multiply
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v_sets = written(sets(values.select("key"), "key")).repartition(parts, "key")
    e_sets = sets(entries.select("rid", "key"), "rid")
    v = prefixes(v_sets, "key").withColumnsRenamed({"n": "v_n", "pos": "v_pos"})
    e = prefixes(e_sets, "rid").withColumnsRenamed({"n": "e_n", "pos": "e_pos"})
    need = F.ceil(threshold / (1 + threshold) * (F.col("v_n") + F.col("e_n")))
    close = (
        (F.col("v_n") >= threshold * F.col("e_n"))
        & (F.col("e_n") >= threshold * F.col("v_n"))
        # the shared grams from here on can still be enough
        & (F.lit(1) + F.least(F.col("v_n") - F.col("v_pos"), F.col("e_n") - F.col("e_pos")) - 1 >= need - F.least("v_pos", "e_pos"))
    )
    small = e.select("gram", "rid", "e_n", "e_pos")
    pairs = v.select("gram", "key", "v_n", "v_pos").join(small, "gram").where(close).select("key", "rid").distinct()
    sets_v = v_sets.select("key", F.col("set").alias("v_set"), F.col("n").alias("v_n"))
    sets_e = e_sets.select("rid", F.col("set").alias("e_set"), F.col("n").alias("e_n"))
    shared = F.size(F.array_intersect("v_set", "e_set"))
    return (
        pairs.join(sets_v, "key")
        .join(sets_e, "rid")
        .withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.col("v_n") + F.col("e_n") - F.col("shared")))
        .where(F.col("similarity") >= threshold)
        .select("key", "rid", "similarity")
    )


def mapped(values: DataFrame, column: str, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (value, entry) of the distinct values of column; entry is 0 for values that mean none.

    entries: entry int, name, abbrev. Null and blank values are left out; equal scores
    go to the smaller entry.
    """
    ship(values.sparkSession)

    @F.pandas_udf("string")
    def keyed(s: pd.Series) -> pd.Series:
        return s.map(key_of)

    @F.pandas_udf("array<string>")
    def rendered(name: pd.Series, abbrev: pd.Series) -> pd.Series:
        return pd.Series([renderings(n, a) for n, a in zip(name, abbrev, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def short(s: pd.Series) -> pd.Series:
        return pd.Series([initials_of(v) for v in s], dtype=object)

    @F.pandas_udf("array<string>")
    def shortened(s: pd.Series) -> pd.Series:
        return pd.Series([initials(n) for n in s], dtype=object)

    @F.pandas_udf("double")
    def agrees(key: pd.Series, full: pd.Series) -> pd.Series:
        return pd.Series([agreement(k, f) for k, f in zip(key, full, strict=True)], dtype="float64")

    named = values.select(F.col(column).alias("value")).where(F.col("value").rlike(r"(?U)\S")).distinct()
    distinct = written(named.withColumn("key", keyed("value")).withColumn("short", short("value")))
    keys = distinct.select("key").where("key <> ''").distinct()
    listed = (
        entries.where("name is not null")
        .withColumn("full", keyed("name"))
        .withColumn("key", F.explode(rendered("name", "abbrev")))
        .select("entry", "full", "key", F.concat_ws("|", F.col("entry").cast("string"), "key").alias("rid"))
    )
    near = similarity_join(keys, listed.select("rid", "key"), threshold)
    best = (
        near.join(listed.select("rid", "entry", "full"), "rid")
        .groupBy("key", "entry", "full")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("agrees", agrees("key", "full"))
        .where("agrees > 0")
        .groupBy("key")
        .agg(F.max_by("entry", F.struct("agrees", "similarity", (-F.col("entry")).alias("first"))).alias("entry"))
    )
    one = (
        entries.where("name is not null")
        .select("entry", F.explode(shortened("name")).alias("short"))
        .groupBy("short")
        .agg(F.min("entry").alias("only"), F.max("entry").alias("last"))
        .where("only = last")
    )
    out = distinct.join(best, "key", "left").join(one.select("short", "only"), "short", "left")
    return out.select("value", F.coalesce("entry", "only", F.lit(0)).alias("entry"))


def _entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "journals").select(F.col("journal_id").alias("entry"), "name", "abbrev")


def p2_found(spark, sf_dir) -> DataFrame:
    """Rows (ref_id, journal_id) of the references whose journal is given in words of its own.

    journal_id is 0 where the list has none. Null and blank journals and exact names are left
    out; copies of a row count once.
    """
    refs = table(spark, sf_dir, "original_references").select("ref_id", "journal").where(F.col("journal").rlike(r"(?U)\S"))
    entries = _entries(spark, sf_dir)
    refs = refs.join(entries.select(F.col("name").alias("journal")), "journal", "left_anti").distinct()
    found = mapped(refs, "journal", entries)
    return refs.join(found, refs.journal == found.value).select("ref_id", F.col("entry").cast("int").alias("journal_id"))


def p2_unmatched(spark, sf_dir) -> DataFrame:
    """Rows (journal, n_refs) of the values that mean no entry of the list."""
    refs = table(spark, sf_dir, "original_references").select("ref_id", "journal").where(F.col("journal").rlike(r"(?U)\S")).distinct()
    counts = refs.groupBy("journal").agg(F.count("*").alias("n_refs"))
    found = mapped(refs, "journal", _entries(spark, sf_dir)).where("entry = 0")
    return counts.join(found, counts.journal == found.value).select("journal", "n_refs")
