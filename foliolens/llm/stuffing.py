"""Problem 10: pages of repeated keywords, link lists and shop tags.

The posts' own lines, without quotations, logs and signature, are cut into units at
the ends of sentences. Every unit is reduced to a shape: how many words, capitals,
separators, links and figures it has, and of which kind it is: a sentence, or loose
words, a link list, a list of tags, an offer with price and number, a phrase that is
short for a sentence and holds what the page repeats, or words that repeat each other.
Shapes are grouped within the page. A page whose words lie mostly in few shapes that are
no sentences is flagged, if these repeat their words, are links or offers, or if the page
is nothing but tags. A post that is a quotation and nothing else is judged as its own.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.session import ship, table

LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"<[^<>\n]{0,200}>|\[/?(?:b|i|u|url|img|color|size|list|\*)(?:=[^\]\n]*)?\]", re.I)
_ANCHOR = re.compile(r"\[url=([^\]\n]+)\](.*?)\[/url\]|<a\s[^<>]*?href=[\"']?([^\"'<>\s]+)[^<>]*>(.*?)</a>", re.I | re.S)
_IMAGE = re.compile(r"\[img\].*?\[/img\]|<img[^<>]*>", re.I | re.S)
_SOURCES = re.compile(r"\W*[^\W\d_]+\s*:\s*(?:(?:https?://|www\.)\S+[\s,;]*)+\Z", re.I)
_BREAK = re.compile(r"<\s*(?:br|/?p|/?div|/?li|/?ul|/?ol)\b[^<>\n]{0,200}>", re.I)
_QUOTE = re.compile(r"\[quote[^\]]*\](?:(?!\[quote|\[/quote\]).)*\[/quote\]", re.I | re.S)
_CODE = re.compile(r"\[code\].*?(?:\[/code\]|\Z)|```.*?(?:```|\Z)", re.I | re.S)
_SIGNATURE = re.compile(r"\n(?:--|_{4,}|-{4,})[ \t]*\n(?:[^\n]*\n?){0,4}\Z")
#: A word of letters only.
_PROPER = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
_WROTE = re.compile(r"\bwrote:\s*$")
_END = re.compile(r"[.!?…。！？।؟](?:[\"'”’»)\]\s]|[:;]-?[)(DP]|[^\w\s.,;:/|~#-])*\Z")
#: Where a unit ends within a line: behind a terminator, but not that of a number.
_UNIT = re.compile(r"(?<=[^\W\d][.!?…])(?=\s)|(?<=[^\W\d][.!?…][\"'”’»)])(?=\s)|(?<=[。！？])(?=[^\"'”’»)）」』])|(?<=[!?…)][.!?])(?=\s)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LISTED = re.compile(r"\s*(?:[,;/~|•·»>#*+=–—]|\s-\s)\s*|、|，|；")
_FIGURE = re.compile(r"\d+")
_PRICE = re.compile(r"(?<!\d)\d+[.,]\d\d\s*(?:[$€£¥₽₹]|[A-Z][A-Za-z]{1,2}\b)|[$€£¥₽₹]\s*\d")
_ITEM = re.compile(r"(?<![\d.,])\d{4,}(?![\d.,])|[★☆]")
_CENTS = re.compile(r"[.,]\d\d|[$€£¥₽₹]")
_SPACED = re.compile(r"(?:(?<!\S)\S\s+){4}")
_MASKED = re.compile(r"[^\W\d_][0-9@$!]|[0-9@$!][^\W\d_]")
_FIGURE_LETTER = re.compile(r"[0-9@$!](?=[^\W\d_])|(?<=[^\W\d_])[0-9@$]")
_NUMBER = re.compile(r"\d{2}")
_MEASURE = re.compile(r"\d+[^\W\d_]{1,3}[.,]?")
_LEET = str.maketrans("013457@$!", "oieastasi")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: Characters that show nothing.
_HIDDEN = re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf") + "]+")
#: Fewest loose words that judge a page, fewest links, offers, short phrases and different tags; most words of a tag.
LEAST_WORDS, LEAST_LINKS, LEAST_OFFERS, LEAST_PHRASES, LEAST_TAGS, TAG_WORDS = 8, 4, 3, 5, 4, 2
#: A link counts as so many words; so many shapes are few; a phrase has fewer words than so many.
LINK_WEIGHT, SHAPES, PHRASE = 3, 4, 7
#: Least shares in loose units, in the few shapes, inside repeated pairs, in tags; most figures to a word.
LOOSE, TOP, COVER, TAGGED, FIGURES = 0.6, 0.45, 0.3, 0.9, 0.13


def plain(text: str) -> str:
    """The post's own lines in plain characters: no markup, quotations, logs or signature."""
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", t))
    if "<" in t or "[" in t:
        t = _IMAGE.sub(" ", t)
        t = _ANCHOR.sub(lambda m: f"{m[2] or m[4]} {m[1] or m[3]} ", t)
        t = _BREAK.sub("\n", t)
        while (u := _QUOTE.sub("\n", t)) != t:
            t = u
    if "[" in t or "`" in t:
        t = _CODE.sub("\n", t)
    if "<" in t or "[" in t:
        t = _TAG.sub(" ", t)
    if ">" in t or "wrote:" in t:
        lines, quoted = [], []
        wrote = False
        for line in t.split("\n"):
            s = line.strip()
            if s.startswith(">"):
                quoted.append(s.lstrip("> "))
                continue
            if _WROTE.search(s):
                wrote = True
                continue
            if wrote and s.startswith("|"):
                continue
            wrote = wrote and not s
            lines.append(line)
        t = "\n".join(lines if any(map(_PROPER.search, lines)) else [*quoted, *lines])
    return _SIGNATURE.sub("", t) if "--" in t or "____" in t else t


def unmasked(line: str) -> str:
    """line with spaced-out letters closed up and figures that stand for letters replaced."""
    tokens = line.split()
    if len(tokens) >= 8 and sum(len(x) == 1 for x in tokens) > 0.7 * len(tokens):
        line = " ".join("".join(w.split()) for w in re.split(r"\s{2,}", line.strip()))
    if not _MASKED.search(line):
        return line
    out = []
    for w in line.split(" "):
        if _MASKED.search(w) and not LINK.match(w) and _FIGURE_LETTER.search(w) and not _NUMBER.search(w.strip("0134570")) and not _MEASURE.fullmatch(w):
            w = w.translate(_LEET)
        out.append(w)
    return " ".join(out)


def words_of(line: str) -> list[str]:
    """The words of line in lower case; of scripts without blanks the pairs of characters."""
    words = _WORD.findall(line.lower())
    if line.isascii() or not _CJK.search(line):
        return words
    out = []
    for w in words:
        if len(w) > 2 and _CJK.search(w):
            out += [w[k : k + 2] for k in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def repeated(words: list[str]) -> float:
    """The share of words that came before."""
    return 1 - len(set(words)) / max(1, len(words))


def repeat_bound(words: float) -> float:
    """The least share of repeated words; longer texts of any kind repeat more of theirs."""
    return 0.55 + 0.04 * math.log2(max(1.0, words / 32))


class Unit:
    """A part of a line up to the end of a sentence, its measures and its kind.

    kind: s sentence, n loose words, l links, o offer, t tags, r words that repeat each
    other, k short phrase that holds what the page repeats (see `own_units`).
    """

    __slots__ = ("words", "links", "sources", "seps", "figures", "caps", "ended", "kind")

    def __init__(self, part: str):
        links = len(LINK.findall(part)) if "://" in part or "www." in part.lower() else 0
        rest = (LINK.sub(" ", part) if links else part).strip(" \t:-–—|•*>,;")
        self.words = words_of(rest)
        self.links = links
        self.sources = bool(links and _SOURCES.match(part))
        n = len(self.words)
        parts = [p for p in _LISTED.split(rest) if p and p.strip()]
        self.seps = len(parts) - 1 if len(parts) >= 4 else 0
        self.figures = len(_FIGURE.findall(rest))
        self.caps = sum(w[:1].isupper() for w in rest.split())
        # a list may end in a period, as may words that only repeat each other
        self.ended = self.seps < 6 and bool(_END.search(rest))
        if self.figures and _PRICE.search(rest) and _ITEM.search(rest):
            self.kind = "o"
        elif n >= LEAST_WORDS and repeated(self.words) >= repeat_bound(n):
            self.kind = "r"
        elif self.ended and n >= 3:
            self.kind = "s"
        elif links:
            self.kind = "l" if LINK_WEIGHT * links > n else "n"
        else:
            self.kind = "t" if n <= TAG_WORDS * (self.seps + 1) and not self.figures and not self.ended and ":" not in part else "n"

    @property
    def weight(self) -> int:
        return len(self.words) + LINK_WEIGHT * self.links

    @property
    def shape(self) -> str:
        n, seps = len(self.words), self.seps
        bucket = lambda n: n if n < 3 else 3 if n < 8 else 8 if n < 20 else 20
        return f"w{bucket(n)}c{min(self.caps, 2)}p{bucket(seps)}l{min(self.links, 2)}f{min(self.figures, 2)}{self.kind}"


def pairs_of(words: list[str]):
    return zip(words, words[1:])


def own_units(body: str) -> list[Unit]:
    """The units of a post's plain text that count.

    A list of sources below sentences is not counted. Sentences shorter than PHRASE words that
    hold one of the page's three most frequent pairs of words, or a word that stands in a quarter of the
    units, are phrases (k), if there are LEAST_PHRASES of them and they hold most of the page's words; so are
    somewhat longer ones that stand there as often word for word.
    """
    units = [Unit(u) for x in body.split("\n") if x.strip() for u in _UNIT.split(unmasked(x)) if u and u.strip()]
    if any(u.kind == "s" for u in units):
        units = [u for u in units if not u.sources]
    again = Counter(tuple(u.words) for u in units if u.kind == "s")
    for u in units:
        if u.kind == "s" and len(u.words) < PHRASE + 3 and again[tuple(u.words)] >= LEAST_PHRASES:
            u.kind = "k"
    short = [u for u in units if u.ended and u.kind in "stnk" and len(u.words) < PHRASE]
    if len(short) >= LEAST_PHRASES:
        pairs = Counter(p for u in units for p in pairs_of(u.words))
        marked = {p for p, n in pairs.most_common(3) if n >= 3}
        often = Counter(w for u in units for w in set(u.words) if len(w) > 2)
        common = {w for w, n in often.items() if n >= max(LEAST_PHRASES, len(units) / 4)}
        hits = [u for u in short if not common.isdisjoint(u.words) or not marked.isdisjoint(pairs_of(u.words))]
        if len(hits) >= LEAST_PHRASES and 2 * sum(len(u.words) for u in hits) > sum(len(u.words) for u in units):
            for u in hits:
                u.kind = "k"
    return units


def possible(body: str) -> bool:
    """Whether a page of this plain text can be flagged at all: it has the fewest links, offers, tags or repetitions.

    No flagged page is lost: its loose words are most of its words, repeated pairs within units are ones of
    the text, and each tag has a separator or a line end behind it.
    """
    low = body.lower()
    if low.count("://") + low.count("www.") >= LEAST_LINKS or _SPACED.search(body):
        return True
    if _MASKED.search(low):
        low = "\n".join(map(unmasked, body.split("\n"))).lower()
    if _CENTS.search(low) and len(_PRICE.findall(body)) >= LEAST_OFFERS:
        return True
    words = words_of(low)
    n = len(words)
    if n < LEAST_TAGS:
        return False
    if n < LEAST_WORDS * 4 or "\n" in low or "/" in low or not low.isascii():
        if TAG_WORDS * (1 + low.count("\n") + len(_LISTED.findall(low))) >= TAGGED * n:
            return True
    elif TAG_WORDS * (1 + sum(map(low.count, ",;~|*+#>=-"))) >= TAGGED * n:
        return True
    if n < LEAST_WORDS:
        return False
    if repeated(words) >= LOOSE * 0.5 or max(Counter(pairs_of(words)).values()) >= 3:
        return True
    ends = sum(map(low.count, ".!?…。！？।؟"))
    return ends >= max(LEAST_PHRASES, LOOSE * n / PHRASE) and max(Counter(words).values()) >= LEAST_PHRASES


def measures(text: str | None) -> dict[str, float]:
    """What the flag of a post is made of; of a page that cannot be flagged they are those of an empty one.

    loose: the share of words and links in units that are no sentences; top: the share
    in the few most frequent of those shapes; cover: the share of the loose words inside
    the three most frequent pairs of neighbours; repeat: the share of loose words that
    came before; figures: figures to a loose word; links: links beside source lists;
    offers, offered: units with a price and a number, their share; tags, tagged:
    different words in lists of tags, their share; phrased: the share of phrases
    and of words that repeat each other.
    """
    body = plain(text) if text else ""
    units = own_units(body) if possible(body) else []
    loose = [x for x in units if x.kind != "s"]
    weight = sum(x.weight for x in units)
    shapes: Counter = Counter()
    for x in loose:
        shapes[x.shape] += x.weight
    words = [w for x in loose for w in x.words]
    pairs = Counter(p for x in loose for p in pairs_of(x.words))
    marked = {p for p, n in pairs.most_common(3) if n >= 3}
    hit = 0
    if marked:
        for x in loose:
            on = bytearray(len(x.words))
            for k, p in enumerate(pairs_of(x.words)):
                if p in marked:
                    on[k] = on[k + 1] = 1
            hit += sum(on)
    n = max(1, len(words))
    return {
        "words": len(words),
        "links": sum(x.links for x in loose),
        "offers": sum(x.kind == "o" for x in loose),
        "tags": len({w for x in loose if x.kind == "t" for w in x.words}),
        "loose": sum(shapes.values()) / max(1, weight),
        "top": sum(v for _, v in shapes.most_common(SHAPES)) / max(1, weight),
        "offered": sum(x.weight for x in loose if x.kind == "o") / max(1, weight),
        "tagged": sum(x.weight for x in loose if x.kind == "t") / max(1, weight),
        "phrased": sum(x.weight for x in loose if x.kind in "kr") / max(1, weight),
        "cover": hit / n,
        "repeat": repeated(words),
        "figures": sum(min(x.figures, 3) for x in loose if not x.links) / n,
        "kinds": float(sum(len(w) > 2 or bool(_CJK.match(w)) for w in set(words))),
    }


def stuffed(m: dict[str, float]) -> bool:
    """Whether a post with these measures is keyword or link spam."""
    if m["loose"] < LOOSE or m["top"] < TOP:
        return False
    if m["tagged"] >= TAGGED and m["tags"] >= LEAST_TAGS and m["kinds"] >= LEAST_TAGS:
        return True
    if m["links"] >= LEAST_LINKS or m["offers"] >= LEAST_OFFERS and m["offered"] >= TOP:
        return True
    return (
        m["words"] >= LEAST_WORDS
        and m["kinds"] >= 2
        and m["figures"] < FIGURES
        and (m["phrased"] >= LOOSE or m["cover"] >= COVER or m["repeat"] >= repeat_bound(m["words"]))
    )


def stuffed_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, measures..., stuffed) of all documents; null and empty texts are not stuffed."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    names = list(measures(None))

    def run(batches):
        for b in batches:
            rows = [(m := measures(t)) | {"stuffed": stuffed(m)} for t in b["t"]]
            yield pd.DataFrame(rows, columns=[*names, "stuffed"]).assign(k=b["k"].to_numpy()).astype(dict.fromkeys(names, "float64"))

    schema = ", ".join([*(f"{n} double" for n in names), "stuffed boolean", f"k {kind}"])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema).withColumnRenamed("k", key)


def page_shapes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (shape, pages, units, words): the shapes of units over the whole corpus."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            total: dict[str, list[int]] = {}
            for t in b["t"]:
                seen = Counter()
                words = Counter()
                for x in own_units(plain(t)):
                    seen[x.shape] += 1
                    words[x.shape] += len(x.words)
                for shape, n in seen.items():
                    s = total.setdefault(shape, [0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += words[shape]
            yield pd.DataFrame([(k, *v) for k, v in total.items()], columns=["shape", "pages", "units", "words"])

    rows = docs.select(F.col(text).alias("t")).where("t <> ''").mapInPandas(run, "shape string, pages long, units long, words long")
    return rows.groupBy("shape").agg(*(F.sum(c).alias(c) for c in ("pages", "units", "words")))


def p10_found(spark, sf_dir) -> DataFrame:
    """Rows (doc_id) of the posts of documents that are keyword or link spam."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stuffed_pages(docs, "doc_id", "text").where("stuffed").select("doc_id")


def p10_shapes(spark, sf_dir) -> DataFrame:
    """Rows (shape, pages, units, words) of the shapes of units of all documents."""
    return page_shapes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
