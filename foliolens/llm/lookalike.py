"""Problem 7: bring text that looks the same to one form.

A text is normalised for compatibility (width, ligatures, composed accents),
characters that show nothing are dropped, every kind of blank becomes a space.
Each token then spans a lattice: at every position the characters that look like
the one written there. Viterbi picks the reading with the best character bigram
score, where a change of script inside a token costs extra. Letters that look the same in
every typeface (of Latin, Greek and Cyrillic) are free to choose from; those that do so in
many (I, l, 1 and O, 0) are read otherwise than they are written only where the letters
beside them outweigh the cost. So the search decides whether `lnternational` is
`International` while `Ill` and `lll` stay two.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.session import ship

# Letters of Greek and Cyrillic, each beside the Latin letter it looks like.
GREEK = "Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ ν ο ι ρ"
GREEK_AS = "A B E Z H I K M N O P T Y X v o i p"
CYRILLIC = "А В Е К М Н О Р С Т Х Ѕ І Ј а е о р с у х ѕ і ј ԁ һ ԛ ԝ Ү ү"
CYRILLIC_AS = "A B E K M H O P C T X S I J a e o p c y x s i j d h q w Y y"
# Hyphens that look like hyphen-minus.
HYPHENS = "‐‑­"
# Blanks that compatibility normalisation leaves alone.
BLANKS = "\t\n\x0b\x0c\r\x85   "

# Characters that many typefaces show alike.
NEAR = ("Il1", "O0")
CHANGE = -5.0  # log score of reading one of NEAR for another
SWITCH = -6.0  # log score of changing the script inside a token
EDGE = "\u0000"
OTHER = "\u0001"

_AS_LATIN = dict(zip((GREEK + " " + CYRILLIC).split(), (GREEK_AS + " " + CYRILLIC_AS).split(), strict=True))
_READINGS: dict[str, list[str]] = {}
for _c, _latin in _AS_LATIN.items():
    _READINGS.setdefault(_latin, [_latin]).append(_c)
_LETTERS = {*_AS_LATIN, *(chr(c) for c in range(97, 123)), *(chr(c) for c in range(65, 91)), *"0123456789"}
_NEAR = {c: [x for x in group if x != c] for group in NEAR for c in group}
_ROUGH = str.maketrans({c: group[0] for group in NEAR for c in group})
_SKELETON = str.maketrans(_AS_LATIN)
_PLAIN = re.compile(r"[\x20-\x7e]*\Z")


@lru_cache(maxsize=65536)
def _shown(ch: str) -> str:
    """ch as it shows: nothing for ignorable characters, a space for any blank, the plain width."""
    if ch in BLANKS or unicodedata.category(ch) == "Zs":
        return " "
    if ch in HYPHENS and ch != "­":
        return "-"
    if unicodedata.category(ch) in ("Cf", "Cc") or ch in "͏ᅟᅠㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return ""
    return ch


def normalised(text: str) -> str:
    """Compatibility form of text without what does not show; blanks at the ends go."""
    if _PLAIN.match(text):
        return text.strip(" ")
    text = "".join(map(_shown, text))
    return "".join(map(_shown, unicodedata.normalize("NFKC", text))).strip(" ")


def skeleton(text: str) -> str:
    """Every look-alike letter replaced by its class; equal skeletons mean equal lattices.

    An accent on a look-alike letter is composed with its class.
    """
    t = text.translate(_SKELETON)
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def rough(text: str) -> str:
    """The skeleton with the characters of NEAR made one: texts whose forms are equal have it in common."""
    return skeleton(text).translate(_ROUGH)


def _script(ch: str) -> str:
    o = ord(ch)
    return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "latin"


class LookalikeModel:
    """Viterbi over look-alike lattices with bigram log scores. counts: {(a, b): n}."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = counts
        self.first: dict[str, int] = {}
        for (a, _), n in counts.items():
            self.first[a] = self.first.get(a, 0) + n
        self.size = len(_LETTERS) + 2
        self.memo: dict[str, str] = {}

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.__init__(state["counts"])

    def _score(self, a: str, b: str) -> float:
        x, y = (c if c in _LETTERS or c == EDGE else OTHER for c in (a, b))
        s = math.log((self.counts.get((x, y), 0) + 0.1) / (self.first.get(x, 0) + 0.1 * self.size))
        if a != EDGE and b != EDGE and a.isalpha() and b.isalpha() and _script(a) != _script(b):
            s += SWITCH
        return s

    def token(self, token: str) -> str:
        """The best reading of a normalised token."""
        key = skeleton(token)
        if (known := self.memo.get(key)) is not None:
            return known
        best = {EDGE: (0.0, "")}
        for ch in key:
            new = {}
            for c in _READINGS.get(ch, [ch]):
                new[c] = max((s + self._score(p, c), path + c) for p, (s, path) in best.items())
            for c in _NEAR.get(ch, ()):
                new[c] = max((s + self._score(p, c) + CHANGE, path + c) for p, (s, path) in best.items())
            best = new
        out = max((s + self._score(c, EDGE), path) for c, (s, path) in best.items())[1]
        if len(self.memo) >= 200_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def form(self, text: str) -> str:
        return " ".join(map(self.token, normalised(text).split(" ")))


def bigram_counts(texts: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Bigram counts of all texts. Their letters come from a fixed alphabet, so that at most
    a few thousand rows reach the driver, whatever the number of texts."""
    ship(texts.sparkSession)

    def count(batches):
        from collections import Counter

        total: Counter = Counter()
        for batch in batches:
            joined = " ".join(normalised(t) for t in batch["t"] if t)
            s = "".join(c if c in _LETTERS else EDGE if c == " " else OTHER for c in f" {joined} ")
            total.update(map(str.__add__, s, s[1:]))
        if total:
            yield pd.DataFrame({"g": [f"{ord(k[0])},{ord(k[1])}" for k in total], "n": list(total.values())})

    rows = (
        texts.select(F.col(column).alias("t"))
        .where("t is not null and t <> ''")
        .mapInPandas(count, "g string, n long")
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = {}
    for r in rows:
        a, b = (chr(int(x)) for x in r.g.split(","))
        out[a, b] = r.n
    return out


def one_form(df: DataFrame, column: str, model: LookalikeModel, out: str = "form") -> DataFrame:
    """df with the column `out`: the one form of `column`; null stays null, empty stays empty."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else model.form(t))

    return df.withColumn(out, form(F.col(column)))


def same_looks(pairs: DataFrame, left: str, right: str, model: LookalikeModel) -> DataFrame:
    """The rows of pairs whose texts differ but have one form. Null and empty texts never match."""
    ship(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = normalised(x), normalised(y)
            # cheap to compare first; the search decides
            out.append(bool(x) and (x == y or (rough(x) == rough(y) and model.form(x) == model.form(y))))
        return pd.Series(out, dtype="bool")

    l, r = F.col(left), F.col(right)
    return pairs.where((l != "") & (r != "") & (l != r)).where(same(l, r))


def p7_model(refs: DataFrame, matches: DataFrame) -> LookalikeModel:
    return LookalikeModel(bigram_counts(refs.select("title").union(matches.select("title")), "title"))


def p7_found(spark, sf_dir) -> DataFrame:
    """Rows (ref_id, match_id) of match_results whose title differs from its reference's but looks the same.

    Copies of a row count once; null and empty titles never match; a match without its
    reference is no case; several equal titles of one reference are one row each.
    """
    from foliolens.session import table

    refs = table(spark, sf_dir, "original_references").select("ref_id", "title")
    matches = table(spark, sf_dir, "match_results").select("match_id", "ref_id", "title")
    model = p7_model(refs, matches)
    pairs = (
        matches.withColumnRenamed("title", "m_title")
        .join(refs, "ref_id")
        .where(F.col("m_title") != F.col("title"))
        # cheap bounds on the way: one side holds something beyond plain ASCII, or they differ in blanks at the ends or in NEAR only
        .where(
            F.col("m_title").rlike(r"[^\x20-\x7e]") | F.col("title").rlike(r"[^\x20-\x7e]")
            | (F.translate(F.trim("m_title"), "l10", "IIO") == F.translate(F.trim("title"), "l10", "IIO"))
        )
    )
    return same_looks(pairs, "m_title", "title", model).select("ref_id", "match_id").distinct()


def p7_forms(spark, sf_dir) -> DataFrame:
    """Rows (src, row_id, form): every title of references and match_results in its one form."""
    from foliolens.session import table

    refs = table(spark, sf_dir, "original_references").select(F.lit("references").alias("src"), F.col("ref_id").alias("row_id"), "title")
    matches = table(spark, sf_dir, "match_results").select(F.lit("match_results").alias("src"), F.col("match_id").alias("row_id"), "title")
    both = refs.union(matches).distinct()
    model = p7_model(refs, matches)
    return one_form(both, "title", model).select("src", "row_id", "form")


def p7_oracle() -> str:
    """The same cases in SQL: width, blanks and ignorables by rule, look-alikes by translate()."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    blanks = "              　"
    src = wide + blanks + "‐‑" + "".join(_AS_LATIN) + "K"
    dst = "".join(chr(c - 0xFEE0) for c in map(ord, wide)) + " " * len(blanks) + "--" + "".join(_AS_LATIN.values()) + "K"
    q = lambda s: s.replace("'", "''")

    def look(c: str) -> str:
        x = f"regexp_replace({c}, '[­͏​-‏⁠-⁤﻿]', '', 'g')"
        for lig, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("…", "...")):
            x = f"replace({x}, '{lig}', '{plain}')"
        return f"trim(nfc_normalize(translate(nfc_normalize({x}), '{q(src)}', '{q(dst)}')))"

    return (
        "SELECT DISTINCT m.ref_id, m.match_id FROM match_results m JOIN original_references r USING (ref_id) "
        f"WHERE m.title <> r.title AND m.title <> '' AND r.title <> '' AND {look('m.title')} = {look('r.title')} AND {look('m.title')} <> ''"
    )
