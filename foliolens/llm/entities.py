"""Problem 1: match entities of two sources without keys.

References and catalog records are described by title, authors, year, doi and
journal, each of which may be missing, misspelt or wrong. Blocking: MinHash values
of the title's words and trigrams and its first words, each joined with a rare token of
one of the first two authors, or several of them with the year; the title and the doi
as they are. A pair that meets in a block is kept if the b-bit MinHash
sketches of the titles' trigrams, which travel with the keys, show enough likeness, or
the titles begin alike. What
remains gets exact features of each attribute, from which a logistic classifier
computes the probability of a match. It is trained without the doi on weak labels
that the doi gives, and its scores are calibrated on labels held out.

Copies of a row are one class; pairs are formed between classes only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.canonical import STOP, _distance
from foliolens.llm.lookalike import normalised, skeleton
from foliolens.session import ship, table, written

#: Labelled pairs that the classifier is fitted on at most, drawn by hash.
SAMPLE = 40_000
#: An author token is common, and no blocking key, if it stands in this share of the rows.
COMMON_SHARE = 0.002
#: Of 16 sketch values, unrelated titles share about 3, titles of one make 8, titles with two slips 12. The same
#: beginning counts as 4 more, the same first author 3, the same year 2, a missing author or year 2 and 1; so many must be reached.
LEAST_LIKENESS = 12
ACCEPT = 0.5
# Words before the title of another work that a work is about.
ABOUT = r"^(?:corrigendum|erratum|errata|correction|comment|comments|reply|rejoinder|response|retraction|review|addendum)\b(?: (?:to|on|of))*"

_ABOUT = re.compile(ABOUT)
_ABOUT_WORDS = re.search(r"\^\(\?:([a-z|]+)\)", ABOUT)[1].split("|")
_PART = re.compile(r"\b(?:part|teil|partie|resz|vol|no)? ?(ii|iii|iv|v|vi|vii|\d{1,2})\s*$")
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "&": " and "})
_LONG = re.compile(r"[^\W_]{4,}")
_DOI = re.compile(r"10\.\d{4,9}/[^\s\"<>]+")
_YEAR = re.compile(r"(?:18|19|20)\d\d")
_SHORT = re.compile(r"[^\W_]{2,}")
_INNER = re.compile(r"(?<=\w)[-'’](?=\w)")
_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(1, 1 << 62, 48, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(1, 1 << 62, 48, dtype=np.uint64)


def _table() -> dict[int, str | None]:
    """One pass over a text: ignorable characters go, blanks, widths and look-alikes become plain."""
    out: dict[int, str | None] = {}
    for c in (*range(0x80, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFF00, 0xFFEF), 0xFEFF):
        ch = chr(c)
        plain = skeleton(normalised(f"x{ch}x")[1:-1])
        plain = plain.lower().translate(_SPECIAL)
        if plain != ch:
            out[c] = plain or None
    out |= {ord(ch): ch.lower() for ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord("&"): " and "}
    return out


_TABLE = _table()
_MARKS = re.compile("[\u0300-\u036f]+")
_BEYOND = re.compile("[^\x00-\x7f]+")
_RUNS = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    """Lower case without accents; only what is beyond ASCII goes through the table."""
    t = text.replace("&", " and ") if "&" in text else text
    if not t.isascii():
        t = _BEYOND.sub(lambda m: m[0].translate(_TABLE), t)
        if not t.isascii():
            t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    return t.lower()


def folded(text: str) -> str:
    """Lower case letters and figures without accents, single blanks."""
    return " ".join(_RUNS.findall(_plain(text)))


def title_of(title: str | None) -> tuple[str, str]:
    """(folded title, mark): the mark says that it is a part, or about another work."""
    if not title or not title.strip():
        return "", ""
    cut = title.rstrip().endswith(("…", "..."))
    t = folded(title)
    mark = ""
    while True:
        head = t.split(" ", 2)
        if m := _ABOUT.match(t):
            word, rest = m.group().split()[0], t[m.end() :].strip()
        elif len(head) == 3 and head[1] in ("on", "to") and len(head[0]) > 3:
            # the word before it may be misspelt
            word, rest = next(((w, head[2]) for w in _ABOUT_WORDS if abs(len(w) - len(head[0])) <= 2 and _distance(head[0], w) <= 2), ("", ""))
        else:
            break
        if not rest:
            break
        mark += word[:4] + " "
        t = rest
    if not cut and (m := _PART.search(t)) and m.start() > 8:
        mark += m.group(1)
        t = t[: m.start()].strip()
    return t + (" ~" if cut else ""), mark.strip()


def author_names(authors: str | None) -> list[list[str]]:
    """The folded tokens of each name of a list, at least four letters long, or two in a name without such; the mark et al. is none."""
    if not authors:
        return []
    if "\\u" in authors:
        authors = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), authors)
    if "-" in authors or "'" in authors or "’" in authors:
        authors = _INNER.sub("", authors)
    t = _plain(authors)
    return [_LONG.findall(x) or [w for w in _SHORT.findall(x) if w not in ("et", "al")] for x in t.split('", "' if t.startswith("[") else ";")]


def author_tokens(authors: str | None) -> list[str]:
    return sorted({w for name in author_names(authors) for w in name})


def doi_of(doi: str | None) -> str:
    """The doi's folded form, '' if it is none."""
    if not doi:
        return ""
    m = _DOI.search("".join(doi.lower().split()))
    return m.group().rstrip(".,;:)]}'") if m else ""


def year_of(year: str | None) -> int:
    m = _YEAR.search(year or "")
    return int(m.group()) if m else 0


def venue_of(venue: str | None) -> str:
    """The first letters of a venue's words."""
    if not venue:
        return ""
    t = re.sub(r"^\W*in\s*:|\bvol\b.*|,?\s*\d+\s*\(.*|[*_]", " ", venue.lower())
    return " ".join(w[:3] for w in folded(re.sub(r"(?<=\w)[-'’](?=\w)", "", t)).split() if w not in STOP)


def _minima(values: np.ndarray, starts: np.ndarray, k: range) -> np.ndarray:
    """The minimum of each group of values under the k-th hash functions; groups are not empty."""
    out = np.empty((len(k), len(starts)), dtype=np.uint64)
    for row, i in enumerate(k):
        h = values * _MUL[i] + _ADD[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[row] = np.minimum.reduceat(h, starts)
    return out


def sketches(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit word a title, 4 bits of each of 16 MinHash values of its trigrams, and the first
    9 of the values. Titles are not empty."""
    padded = [f"  {t} " for t in titles]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), dtype=np.int64)
    grams = codes.copy()
    grams[:-2] = codes[:-2] * np.uint64(1_000_003) + codes[1:-1] * np.uint64(8191) + codes[2:]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # grams that run into the next title count for none
    keep = np.ones(len(grams), dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False
    grams, starts = grams[keep], starts - 2 * np.arange(len(starts))
    minima = _minima(grams, starts, range(16))
    nibbles = (minima >> np.uint64(40)) & np.uint64(15)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))[:, None]
    return np.bitwise_or.reduce(nibbles << shifts, axis=0).view(np.int64), minima[:9]


def word_minima(titles: list[str]) -> np.ndarray:
    """A MinHash value of each title's words; titles are not empty."""
    lists = [[w for w in t.split() if len(w) > 3 and w not in STOP] or t.split()[:1] for t in titles]
    flat = np.fromiter((_crc(w) for ws in lists for w in ws), dtype=np.uint64)
    lengths = np.fromiter(map(len, lists), dtype=np.int64)
    return _minima(flat, np.cumsum(lengths) - lengths, range(16, 17))[0]


@lru_cache(maxsize=1 << 17)
def _crc(text: str) -> int:
    return zlib.crc32(text.encode())


def blocking_keys(titles, heads, minima, words, first, usual, second, usual2, years, venues, dois, probes) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the blocking keys of described rows, in the rows' order.

    first, second: the rare tokens of the first two authors of each row; usual, usual2: the common ones.
    """
    n = len(titles)
    u = lambda values: np.array(values, dtype=np.uint64)
    titled = np.fromiter((bool(t) for t in titles), dtype=bool, count=n)
    head, year = u(heads), u(years)
    rows, keys = [], []

    def add(row, key):
        rows.append(row)
        keys.append(key)

    def tokens(lists):
        row = np.repeat(np.arange(n), np.array([len(x) for x in lists], dtype=np.int64))
        crc = u([_crc(a) for x in lists for a in x]) * np.uint64(0x9E3779B97F4A7C15)
        return row, crc

    begin = head * np.uint64(0x9FB21C651E98DF25)
    row, crc = tokens(first)
    t = titled[row]
    r, c = row[t], crc[t]
    for k, value in enumerate((minima[0][r], minima[1][r], words[r], begin[r])):
        add(r, c ^ value ^ np.uint64(k))
    # a common token, such as a given name or a hot author's surname, counts together with the year
    row, crc = tokens(usual)
    t = titled[row] & (year[row] > 0)
    r, c = row[t], crc[t] ^ (year[row[t]] * np.uint64(0xD6E8FEB86659FD93))
    for k in (0, 1):
        add(r, c ^ minima[k][r] ^ np.uint64(6 + k))
    # and with more of the title, which needs no year; an author with a rare token as well has less need of it
    for lists, rare, salt, more in ((usual, first, 8, (True, True)), (usual2, second, 11, (False, False))):
        row, crc = tokens(lists)
        lone = np.fromiter((not x for x in rare), dtype=bool, count=n)[row]
        t = titled[row]
        parts = (begin, minima[0] ^ (minima[1] >> np.uint64(7)), minima[2] ^ (minima[3] >> np.uint64(7)))
        for k, (value, always) in enumerate(zip(parts, (False, *more), strict=True)):
            s = t if always else t & lone
            add(row[s], crc[s] ^ value[row[s]] ^ np.uint64(salt + k))
    row, crc = tokens(first)
    if not (probes and titled.all()):
        # references without a title are looked for by author and year
        t = (year[row] > 0) & (~titled[row] if probes else True)
        add(row[t], crc[t] ^ (year[row[t]] * np.uint64(0x27D4EB2F165667C5)))
        # common tokens count together with the year and how the venue begins, as one venue may be the other's beginning
        row, crc = tokens(usual)
        venue = u([_crc(v[:3]) if v else 0 for v in venues])
        t = (year[row] > 0) & (venue[row] > 0) & (~titled[row] if probes else True)
        add(row[t], crc[t] ^ (year[row[t]] * np.uint64(0xA0761D6478BD642F)) ^ (venue[row[t]] * np.uint64(0xE7037ED1A0B428DB)))
    row, crc = tokens(second)
    t = titled[row]
    add(row[t], crc[t] ^ minima[2][row[t]] ^ np.uint64(4))
    add(row[t], crc[t] ^ begin[row[t]] ^ np.uint64(3))
    t = np.flatnonzero(titled & (year > 0))
    c = year[t] * np.uint64(0xC2B2AE3D27D4EB4F)
    add(t, c ^ minima[3][t] ^ (minima[4][t] >> np.uint64(5)) ^ (minima[5][t] >> np.uint64(9)))
    add(t, c ^ begin[t])
    t = np.flatnonzero(titled)
    add(t, u([_crc(titles[k]) for k in t]) * np.uint64(0x85EBCA77C2B2AE63))
    t = np.array([k for k, d in enumerate(dois) if d], dtype=np.int64)
    add(t, u([_crc(dois[k]) for k in t]) * np.uint64(0x165667B19E3779F9))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order].view(np.int64)


def describe(batch: pa.RecordBatch, common: frozenset[str], probes: bool) -> pa.RecordBatch:
    """The rows' normal forms, sketches and blocking keys. probes: the rows are the references."""
    column = lambda c: batch.column(c).to_pylist()

    def each(f, values):
        known = {x: f(x) for x in set(values)}
        return [known[x] for x in values]

    forms = each(title_of, column("title"))
    n = len(forms)
    bare = [t.replace(" ~", "").strip() for t, _ in forms]
    names = each(author_names, column("authors"))
    years = each(year_of, column("year"))
    dois = [doi_of(d) for d in column("doi")]
    have = [k for k, t in enumerate(bare) if t]
    sk = np.zeros(n, dtype=np.int64)
    minima = np.zeros((9, n), dtype=np.uint64)
    words = np.zeros(n, dtype=np.uint64)
    if have:
        sk[have], minima[:, have] = sketches([bare[k] for k in have])
        words[have] = word_minima([bare[k] for k in have])
    heads = [_crc(" ".join([w for w in t.split() if len(w) > 3][:3])) if t else 0 for t in bare]
    first = [[a for a in x[0] if a not in common] if x else [] for x in names]
    second = [[a for a in x[1] if a not in common] if len(x) > 1 else [] for x in names]
    usual = [[a for a in x[0] if a in common] if x else [] for x in names]
    usual2 = [[a for a in x[1] if a in common] if len(x) > 1 else [] for x in names]
    venues = each(venue_of, column("venue"))
    row, key = blocking_keys(bare, heads, minima, words, first, usual, second, usual2, years, venues, dois, probes)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    people = [sorted({w for name in x for w in name}) for x in names]
    brief = [
        _bits(h, 14) << 50 | (_bits(min(map(_crc, f)), 12) << 38 if f else 0) | (y % 255 + 1 if y else 0) << 30 | min(len(ws), 15) << 26 | _initials(ws)
        for h, f, y, ws in zip(heads, first, years, people, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("n"),
            batch.column("h"),
            batch.column("g"),
            pa.array([t for t, _ in forms], pa.string()),
            pa.array([m for _, m in forms], pa.string()),
            pa.array([" ".join(ws) for ws in people], pa.string()),
            pa.array(years, pa.int32()),
            pa.array([_crc(d) << 32 | _crc(d[::-1]) >> 1 if d else 0 for d in dois], pa.uint64()).view(pa.int64()),
            pa.array(venues, pa.string()),
            pa.array(sk),
            pa.array(brief, pa.uint64()).view(pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(key)),
        ],
        names=["n", "h", "g", "t", "mark", "a", "y", "d", "v", "s", "brief", "keys"],
    )


def _bits(crc: int, n: int) -> int:
    """n bits of a checksum, 0 only for 0."""
    return crc and crc % ((1 << n) - 1) + 1


def _initials(words: list[str]) -> int:
    """The set of first letters of words, a bit each."""
    out = 0
    for w in words:
        out |= 1 << (ord(w[0]) - 97) % 26
    return out


DESCRIBED = "n long, h long, g long, t string, mark string, a string, y int, d long, v string, s long, brief long, keys array<long>"


_letters = lru_cache(maxsize=1 << 16)(frozenset)


def _near(a: str, b: str, most: int) -> bool:
    """Whether two words lie within so many edits; an edit changes the set of letters by two at most."""
    return len(_letters(a) ^ _letters(b)) <= 2 * most and _distance(a, b) <= most


def word_differences(a: str, b: str) -> tuple[int, int, int]:
    """(words of a without a counterpart in b, words of b without one in a, counterparts with slips).

    A title that is cut off, marked by a final ~, leaves its last word and what follows open.
    """
    if a == b:
        return 0, 0, 0
    cut_a, cut_b = a.endswith(" ~"), b.endswith(" ~")
    wa, wb = a.replace(" ~", "").split(), b.replace(" ~", "").split()
    if cut_a and len(wb) > len(wa) - 1:
        wb = wb[: len(wa)]
        if wa and wb and len(wa) == len(wb) and wb[-1].startswith(wa[-1]):
            wa, wb = wa[:-1], wb[:-1]
    if cut_b and len(wa) > len(wb) - 1:
        wa = wa[: len(wb)]
        if wa and wb and len(wa) == len(wb) and wa[-1].startswith(wb[-1]):
            wa, wb = wa[:-1], wb[:-1]
    right, left = list(wb), []
    for w in wa:
        if w in right:
            right.remove(w)
        else:
            left.append(w)
    slips = 0
    for w in list(left) if right else ():
        size = len(w)
        for k, x in enumerate(right):
            if abs(len(x) - size) <= 2 and _near(w, x, 1 if min(size, len(x)) < 5 else 2):
                del right[k]
                left.remove(w)
                slips += 1
                break
    small = lambda ws: sum(len(w) > 3 for w in ws)
    return small(left), small(right), slips


def tail_only(a: str, b: str) -> bool:
    """Whether the longer title begins with the shorter one, slips aside."""
    wa, wb = a.replace(" ~", "").split(), b.replace(" ~", "").split()
    n = min(len(wa), len(wb))
    return n >= 3 and all(x == y or _near(x, y, 2) for x, y in zip(wa[:n], wb[:n]))


def author_agreement(a: str, b: str) -> tuple[int, int]:
    """(tokens of the shorter of two strings of tokens that the other one has, slips allowed; size of the shorter list)."""
    if a == b:
        n = len(a.split())
        return n, n
    a, b = sorted((a.split(), b.split()), key=len)
    other = set(b)
    n = 0
    for w in a:
        if w in other:
            n += 1
            continue
        first, size = w[0], len(w)
        for x in b:
            if x[0] == first and abs(len(x) - size) <= 2 and (size > 4 or x[:2] == w[:2]) and (x.startswith(w) or _near(w, x, 2)):
                n += 1
                break
    return n, len(a)


#: The two hashes of the class of either side.
CLASS = ("x_h", "x_g", "y_h", "y_g")
FEATURES = ("missing_a", "missing_b", "slips", "tail", "authors", "authors_none", "no_authors", "year_same", "year_near", "year_two", "year_far", "venue_same", "venue_differs", "mark_differs")


def features(p: pd.DataFrame) -> pd.DataFrame:
    """The features of pairs of described rows (columns x_..., y_...)."""
    n = len(p)
    words = np.zeros((n, 4), dtype=np.int8)
    people = np.zeros((n, 3))
    venue = np.zeros((n, 2), dtype=bool)
    for k, (xt, yt, xa, ya, xv, yv) in enumerate(zip(*(p[c].tolist() for c in ("x_t", "y_t", "x_a", "y_a", "x_v", "y_v")), strict=True)):
        if xt and yt and xt != yt:
            ma, mb, slips = word_differences(xt, yt)
            tail = (ma == 0) != (mb == 0) and tail_only(xt, yt)
            words[k] = (0, 0, min(slips, 4), 1) if tail else (min(ma, 4), min(mb, 4), min(slips, 4), 0)
        hit, of = author_agreement(xa, ya)
        people[k] = (hit / of, not hit, 0) if of else (0, 0, 1)
        if xv and yv:
            same = xv == yv or xv.startswith(yv) or yv.startswith(xv)
            venue[k] = same, not same
    x, y = p["x_y"].to_numpy(), p["y_y"].to_numpy()
    gap = np.where((x > 0) & (y > 0), np.abs(x - y), -1)
    out = dict(zip(("missing_a", "missing_b", "slips", "tail"), words.T)) | {"authors": people[:, 0], "authors_none": people[:, 1], "no_authors": people[:, 2]}
    out |= {"year_same": gap == 0, "year_near": gap == 1, "year_two": gap == 2, "year_far": gap > 2}
    out |= {"venue_same": venue[:, 0], "venue_differs": venue[:, 1], "mark_differs": p["x_mark"].to_numpy() != p["y_mark"].to_numpy()}
    return pd.DataFrame(out)[list(FEATURES)].astype({c: "int8" for c in FEATURES if c != "authors"})


class Logistic:
    """Logistic regression by iteratively reweighted least squares, then calibrated on held-out scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        half = np.arange(len(y)) % 2 == 0
        self.weights = self._fit(x[half], y[half], ridge)
        score = self._score(x[~half])
        a = self._fit(score[:, None], y[~half], 1e-3)
        self.slope, self.shift = float(a[1]), float(a[0])

    @staticmethod
    def _fit(x, y, ridge):
        x = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(x.shape[1])
        pen = ridge * np.eye(x.shape[1])
        pen[0, 0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (y - p) - pen @ w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, g)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def _score(self, x):
        return self.weights[0] + x @ self.weights[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * self._score(x), -30, 30)))


def _classes(df: DataFrame, id_col: str, venue: str) -> tuple[DataFrame, DataFrame]:
    """(id, several, h, g) of the distinct rows, and one row a class of equal attributes; a null counts as blank.

    h and g are two hashes of the attributes, 128 bits together; n numbers the classes. several: the id stands in several classes.
    """
    cols = ["title", "authors", "year", "doi", venue]
    wide = df.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols))
    wide = wide.withColumns({"h": F.xxhash64(*cols), "g": F.xxhash64(F.lit(1), *cols)}).withColumnRenamed(venue, "venue")
    of = wide.groupBy("id").agg(F.collect_set(F.struct("h", "g")).alias("of"))
    ids = of.select("id", (F.size("of") > 1).alias("several"), F.inline("of"))
    return ids, wide.drop("id").distinct().withColumn("n", F.monotonically_increasing_id())


def common_authors(*described: DataFrame) -> frozenset[str]:
    """Author tokens in at least COMMON_SHARE of the rows; a few thousand at most, whatever the tables."""

    both = described[0].select("authors")
    for d in described[1:]:
        both = both.union(d.select("authors"))
    total = both.count()
    least = max(20, int(COMMON_SHARE * total))
    token = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("authors", r"(?U)(?<=\w)[-'’](?=\w)", "")), r"(?U)\W+")))
    rows = both.where("authors <> ''").select(token.alias("token")).where("length(token) >= 2").groupBy("token").count().where(F.col("count") >= least // 4).collect()
    counts: dict[str, int] = {}
    for r in rows:
        counts[folded(r.token)] = counts.get(folded(r.token), 0) + r["count"]
    return frozenset(t for t, n in counts.items() if n >= least)


def candidate_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows (x_n, y_n) of the described rows that share a blocking key and whose titles' sketches agree enough."""
    # sent with the key: the class, the sketch, and in brief how the title begins, the first author, the year, and how
    # many author tokens there are and their first letters
    a = x.select(F.explode("keys").alias("key"), F.col("n").alias("x_n"), F.col("s").alias("x_s"), F.col("brief").alias("x_b"))
    b = y.select(F.explode("keys").alias("key"), F.col("n").alias("y_n"), F.col("s").alias("y_s"), F.col("brief").alias("y_b"))
    d = F.col("x_s").bitwiseXOR(F.col("y_s"))
    any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
    equal = F.lit(16) - F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    def part(side, shift, bits):
        return F.shiftrightunsigned(F.col(side), shift).bitwiseAND(F.lit((1 << bits) - 1))

    def agreement(shift, bits, same, missing):
        p, q = part("x_b", shift, bits), part("y_b", shift, bits)
        return F.when((p == 0) | (q == 0), missing).when(p == q, same).otherwise(0)

    likeness = equal + agreement(50, 14, 4, 0) + agreement(38, 12, 3, 2) + agreement(30, 8, 2, 1)
    blank = (F.col("x_s") == 0) | (F.col("y_s") == 0)
    # half of the tokens of the shorter list of authors must agree, which takes the same first letters; those that share
    # a letter with another token count once
    x_of, y_of, x_in, y_in = part("x_b", 26, 4), part("y_b", 26, 4), part("x_b", 0, 26), part("y_b", 0, 26)
    of = F.least(x_of, y_of)
    least = F.when(of < 15, F.ceil(of / 2) - of + F.bit_count(F.when(x_of <= y_of, x_in).otherwise(y_in))).otherwise(1)
    people = (of == 0) | (F.bit_count(x_in.bitwiseAND(y_in)) >= F.greatest(least, F.lit(1)))
    return a.join(b, "key").where(people & (blank | (likeness >= LEAST_LIKENESS))).select("x_n", "y_n").distinct()


def matches(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (ref_id, record_id, confidence) of the pairs that describe the same work.

    Every attribute may be null or blank; a reference without title needs its authors, year
    and venue or doi to agree. Rows without any attribute match nothing. Of two
    empty tables, or one, the result is empty.
    """
    scored, ref_ids, rec_ids = class_matches(refs, records)
    return scored.join(ref_ids, ["x_h", "x_g"]).join(rec_ids, ["y_h", "y_g"]).select("ref_id", "record_id", "confidence")


def matched(refs: DataFrame, records: DataFrame) -> DataFrame:
    """The distinct rows (ref_id, record_id) of matches.

    A pair of classes comes once, so a pair of ids that stand in one class each does as well. Only the others are
    compared, as the pairs of ids grow with the square of the copies of a work.
    """
    scored, ref_ids, rec_ids = class_matches(refs, records)
    scored = written(scored.drop("confidence"))
    one, more = F.col("x_several"), F.col("y_several")
    by_ref = lambda df, which: df.join(ref_ids.where(which), ["x_h", "x_g"])
    by_record = lambda df, which: df.join(rec_ids.where(which), ["y_h", "y_g"])
    repeated = by_ref(scored, one)
    parts = [by_record(by_ref(scored, ~one), ~more), by_record(repeated, ~more), by_record(repeated, more), by_ref(by_record(scored, more), ~one)]
    once, *rest = (p.select("ref_id", "record_id") for p in parts)
    return once.unionByName(rest[0].unionByName(rest[1]).unionByName(rest[2]).distinct())


def class_matches(refs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x_h, x_g, y_h, y_g, confidence) of the pairs of classes that match, each once, and the ids of the classes of
    either side: (ref_id, x_several, x_h, x_g) and (record_id, y_several, y_h, y_g)."""
    ship(refs.sparkSession)
    ref_ids, ref_rows = _classes(refs, "ref_id", "journal")
    rec_ids, rec_rows = _classes(records, "record_id", "venue")
    common = common_authors(refs, records)

    def described(df, probes):
        def run(batches):
            for b in batches:
                yield describe(b, common, probes)

        return written(df.mapInArrow(run, DESCRIBED))

    x, y = described(ref_rows, True), described(rec_rows, False)
    pairs = written(candidate_pairs(x, y))
    cols = ("n", "h", "g", "t", "mark", "a", "y", "d", "v")
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in cols))
    # the records, of which there are fewer, are met first, so that a pair carries one text through one shuffle only
    wide = pairs.join(side(y, "y"), "y_n").join(side(x, "x"), "x_n")

    def measure(batches):
        for b in batches:
            f = features(b)
            same = (b["x_d"] == b["y_d"]) & (b["x_d"] != 0)
            other = (b["x_d"] != 0) & (b["y_d"] != 0) & ~same
            f["doi"] = np.where(same, 1, np.where(other, -1, 0))
            f["titled"] = (b["x_t"] != "") & (b["y_t"] != "")
            yield f.astype({"doi": "int8", "titled": "int8"}).assign(**{c: b[c].to_numpy() for c in CLASS})

    names = [*FEATURES, "doi", "titled"]
    measured = written(wide.mapInPandas(measure, ", ".join([*(f"{n} {'double' if n == 'authors' else 'tinyint'}" for n in names), *(f"{c} long" for c in CLASS)])))
    labelled = measured.where("doi <> 0 and titled = 1")
    agreed = (F.col("authors") > 0.99) & (F.col("authors_none") == 0) & (F.col("no_authors") == 0) & (F.col("year_same") == 1) & (F.col("venue_same") == 1)
    equal_doi = (F.col("titled") == 1) & (F.col("doi") == 1)
    s = measured.agg(
        F.count_if((F.col("titled") == 1) & (F.col("doi") != 0)).alias("n"),
        F.count_if((F.col("titled") == 0) & agreed & (F.col("doi") == 1)).alias("hit"),
        F.count_if((F.col("titled") == 0) & agreed & (F.col("doi") == -1)).alias("miss"),
        F.count_if(equal_doi & (F.col("missing_a") + F.col("missing_b") == 0)).alias("doi_hit"),
        F.count_if(equal_doi).alias("doi_all"),
    ).first()
    n = s["n"]
    # of pairs without a title: how often agreement of all else comes with the same doi, and the same doi with the same title
    by_rest, by_doi = (s["hit"] + 1) / (s["hit"] + s["miss"] + 1.5), (s["doi_hit"] + 1) / (s["doi_all"] + 1.5)
    model = None
    if n:
        share = min(1.0, 1.2 * SAMPLE / n)
        draw = F.pmod(F.xxhash64(*CLASS), F.lit(1_000_000))
        drawn = labelled.where(draw < int(share * 1_000_000)).orderBy(draw, *CLASS).limit(SAMPLE).toPandas()
        drawn = drawn.sort_values(list(CLASS))
        label = (drawn["doi"] > 0).to_numpy(dtype="float64")
        if 0 < label.sum() < len(label):
            model = Logistic(drawn[list(FEATURES)].to_numpy(), label)

    def judge(batches):
        for b in batches:
            p = model.probability(b[list(FEATURES)].to_numpy()) if model is not None else np.zeros(len(b))
            agree = (b["authors"] > 0.99) & (b["authors_none"] == 0) & (b["no_authors"] == 0) & (b["year_same"] == 1)
            rest = np.where(agree & (b["venue_same"] == 1), by_rest, 0.0)
            untitled = np.maximum(rest, np.where((b["doi"] == 1) & (b["authors"] > 0.5), by_doi, 0.0))
            p = np.where(b["titled"] == 1, p, untitled)
            yield b[list(CLASS)].assign(confidence=p, exact=exact(b))

    scored = measured.mapInPandas(judge, ", ".join(f"{c} long" for c in CLASS) + ", confidence double, exact boolean").where((F.col("confidence") >= ACCEPT) & F.col("exact"))
    named = lambda ids, s, name: ids.withColumnsRenamed({"h": f"{s}_h", "g": f"{s}_g", "several": f"{s}_several", "id": name})
    return scored.drop("exact"), named(ref_ids, "x", "ref_id"), named(rec_ids, "y", "record_id")


def exact(b: pd.DataFrame) -> np.ndarray:
    """What no probability may outweigh: parts and works about a work are others, so are works whose
    titles differ in a word (one that is left out aside), and works of the same title by other people or of a far year by unknown ones."""
    titled = b["titled"] == 1
    near = b["year_far"] + b["year_two"] == 0
    lost = (b["missing_a"] + b["missing_b"] == 1) & near & ((b["authors"] >= 0.5) | (b["doi"] == 1))
    same_title = ((b["missing_a"] + b["missing_b"] == 0) | lost) & (b["mark_differs"] == 0)
    people = (b["authors"] >= 0.5) | ((b["no_authors"] == 1) & near)
    return (~titled | (same_title & people)).to_numpy()


def _inputs(spark, sf_dir):
    refs = table(spark, sf_dir, "original_references").select("ref_id", "title", "authors", "year", "doi", "journal")
    records = table(spark, sf_dir, "catalog_records").select("record_id", "title", "authors", "year", "doi", "venue")
    return refs, records


def p1_links(spark, sf_dir) -> DataFrame:
    """Rows (ref_id, record_id, confidence) of all references and the records of the same work."""
    return matches(*_inputs(spark, sf_dir))


def p1_found(spark, sf_dir) -> DataFrame:
    """Rows (ref_id, record_id): one for each reference and catalog record of the same work."""
    return matched(*_inputs(spark, sf_dir))
