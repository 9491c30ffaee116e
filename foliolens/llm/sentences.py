"""Problem 3: sentence units of documents in any language and script.

Boundaries are disambiguated around the document: whether a token with a period is
an abbreviation, and whether a capitalised token is a proper name, is read from
its unambiguous occurrences elsewhere in the same document (followed by a lower
case word or a number, without the period, in lower case, at a paragraph's start),
and where the document says nothing, from the counts of the whole corpus.
Scripts have rules of their own: danda, ideographic stop, Arabic and Greek
question mark, Thai blanks.

One pass reads every document and writes the counts of its tokens, summed over the
partition, and those of its own ambiguous tokens; these are joined with the sums of the
corpus; the second pass splits. No table of the corpus is broadcast or collected.
Tokens longer than LONGEST characters, such as sentences of scripts without blanks,
have no counts. A worker holds the rows of a few documents at once, however many a batch has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.session import ship, table, written

# Brackets and quotes, and what may close what they open.
PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»", "“": "”", "„": "“”", "‹": "›", '"': '"'}
OPENERS = "".join(PAIRS)
CLOSERS = ")]）」』》】»”›\"“’"
# German words before an ordinal number.
ORDINAL_BEFORE = set(
    "der die das dem den des am im vom zum zur beim ein eine einem einen einer eines jede jeder jedes jedem jeden "
    "seit bis ab dieser diese diesem diesen ihr ihre ihrem ihren sein seine seinem seinen unser unsere".split()
)
# Verbs that attribute a quotation in Chinese, particles that go on after one in Japanese.
ZH_SAYS = "说問问道写寫称答喊說"
JA_GOES_ON = "とはがをにのもでなとへや、，"

STOPS = ".!?…。！？।॥؟۔;;"
CJK_STOPS = "。！？।॥؟۔"
_TERMINATOR = re.compile(rf"[{re.escape(STOPS)}]+|(?<=[฀-๿])\s+(?=\S)|[{re.escape(OPENERS)}]")
_BLANKS = re.compile(r"\s*")
_BEFORE = re.compile(r"[^\s\"“”«»()\[\]（）「」『』„‚‘,;:!?…]*\Z")
_WORD = re.compile(r"[^\W_]+(?:[-'’.][^\W_]+)*")
_HEADING = re.compile(r"\s{0,3}#{1,6}(\s|$)|\s*\*\*[^*]+\*\*\s*$")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_IMAGE = re.compile(r"\s*!\[[^\]]*\]\([^)]*\)\s*$")
_CAPTION = re.compile(r"\s*(\*\*)?(Figure|Table)\s+\d+", re.I)
_RULE = re.compile(r"\s*(-{3,}|={3,}|\*{3,}|_{3,})\s*$")
CORE = OPENERS + CLOSERS + ",;:!?…،؛"
LONGEST = 60
#: Rows that a worker hands on at once, and documents that it reads at once.
ROWS, DOCS = 20_000, 256
#: Tokens whose sums a worker holds before it hands them on.
HELD = 200_000
_PAIRED = re.compile(f"[{re.escape(OPENERS + CLOSERS)}]")
_INNER_STOP = re.compile(rf"[^\W\d_]{{2,}}(?=\.[^\W\d_])|(?<=[{re.escape(STOPS)}{re.escape(OPENERS + CLOSERS)}])[^\W_]+(?:[-'’.][^\W_]+)*")
_ENDS = frozenset(STOPS + CLOSERS)
STATS = ("per", "inner", "noper", "common", "other", "lower", "start", "mid")


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def blocks(text: str):
    """(start, end, whole) of the text's blocks: a special line is whole, other lines up to a
    blank or special one are a paragraph."""
    out = []
    at, para, formula = 0, None, None
    before_blank = True
    lines = text.split("\n")
    last_formula = max((k for k, line in enumerate(lines) if "$$" in line), default=-1) if "$$" in text else -1
    for k, line in enumerate(lines):
        end = at + len(line)
        special = False
        if formula is not None:
            if "$$" in line:
                out.append((formula, end, True))
                formula = None
            at = end + 1
            before_blank = False
            continue
        stripped = line.strip()
        if not stripped:
            special = None
        elif stripped.startswith("$$"):
            special = True
            if stripped.count("$$") < 2 and last_formula > k:
                formula = at
        elif _HEADING.match(line) or _ROW.match(line) or _IMAGE.match(line) or _RULE.match(line):
            special = True
        elif _CAPTION.match(line) and before_blank:
            special = True
        if special is None or special:
            if para is not None:
                out.append((*para, False))
                para = None
            if special and formula is None:
                out.append((at, end, True))
        else:
            para = (para[0] if para else at, end)
        before_blank = special is None or bool(special)
        at = end + 1
    if formula is not None:
        out.append((formula, len(text), True))
    if para is not None:
        out.append((*para, False))
    return out


def evidence(text: str) -> dict[str, list[int]]:
    """Counts by token of one document, in the order of STATS."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0] * len(STATS))
    follow: list[tuple[str, str]] = []
    for start, end, whole in blocks(text):
        if whole:
            continue
        words = text[start:end].split()
        closed = True  # the word stands where a sentence surely begins
        sure = False  # the word surely stands inside a sentence
        for k, raw in enumerate(words):
            core = raw.strip(CORE)
            period = core.endswith(".") and not core.endswith("..")
            a = core.rstrip(".")
            if a and a[0].isalpha():
                s = seen[a]
                if closed:
                    s[6] += 1
                elif a[0].isupper():
                    s[7] += sure
                elif sure:
                    s[5] += 1
                if not period:
                    s[2] += 1
            if period and a:
                s = seen[a]
                s[0] += 1
                nxt = words[k + 1] if k + 1 < len(words) else ""
                inside = raw.rstrip(CLOSERS + ",;:،") != core or not raw.endswith(".")
                t = nxt.lstrip(OPENERS)[:1]
                if (inside and raw[-1:] in ",;:،") or (nxt and (t.islower() or t.isdigit() or t in "–-,;:")):
                    s[1] += 1
                elif t.isupper():
                    follow.append((a, nxt.strip(CORE).rstrip(".")))
            tail = raw.rstrip(CLOSERS)[-1:]
            closed = tail in "?!。！？।॥؟" and bool(tail)
            sure = bool(tail) and tail not in STOPS + ":" and raw[-1:] not in CLOSERS
    for a, t in follow:
        common = seen[t.lower()][5] > 0 if t.lower() in seen else False
        if not common and t in seen:
            common = seen[t][6] > 0 and seen[t][7] == 0
        seen[a][3 if common else 4] += 1
    return seen


class Splitter:
    """Splits one document. own: its counts by token; corpus: those of all documents."""

    def __init__(self, own, corpus):
        self.own, self.corpus = own, corpus

    def _stat(self, token: str, k: int, corpus: bool = True) -> int:
        s = self.own.get(token)
        n = s[k] if s else 0
        if corpus and (s := self.corpus.get(token)):
            n = max(n, s[k])
        return n

    def abbreviation(self, a: str) -> bool:
        if len(a) == 1:
            return a.isalpha()
        if "." in a:
            return not a[0].isdigit() and max(map(len, a.split("."))) <= 4
        if len(a) > 7:
            return False
        for corpus in (False, True):  # the document first
            per, inner, noper = (self._stat(a, k, corpus) for k in (0, 1, 2))
            if inner > 0.25 * per and inner >= 1 and (corpus or inner > 1 or noper == 0) and inner > 0.2 * noper:
                return True
            if noper > per and noper > 3 * inner:
                return False
        if len(a) == 4 and a[0].islower() and not self._stat(a, 1):
            return False  # a short word of which nothing else is known
        return len(a) <= 4 and noper <= 0.3 * per

    def ends_sentences(self, a: str) -> bool:
        """Whether the abbreviation is mostly followed by common words in capitals."""
        if len(a) == 1:
            return False
        common, other = self._stat(a, 3), self._stat(a, 4)
        return common > other or (common == other and "." in a)

    def starter(self, t: str) -> bool:
        """Whether t, as written, is a word that begins sentences rather than a name."""
        if t[:1].islower():
            # lower case words that stand at sure beginnings only
            start, lower = self._stat(t, 6), self._stat(t, 5)
            return start > lower and start > 0
        return self._stat(t.lower(), 5) > 0 or (self._stat(t, 6) > 0 and self._stat(t, 7) == 0)

    def _next(self, p: str, i: int, hi: int):
        """(blanks before, first letter or digit, token) that follow i."""
        j = _BLANKS.match(p, i, hi).end()
        gap = j > i
        while j < hi and p[j] in OPENERS:
            j = _BLANKS.match(p, j + 1, hi).end()
        if j >= hi:
            return gap, "", ""
        w = _WORD.match(p, j, hi)
        return gap, p[j], w.group() if w else p[j]

    def _boundary(self, p: str, lo: int, i: int, e: int, hi: int) -> bool:
        """Whether the terminators p[i:e] of the sentence that began at lo end it."""
        gap, c, t = self._next(p, e, hi)
        if not c:
            return True
        stop = p[i:e]
        before = p[i - 1] if i > lo else ""
        if ";" in stop or ";" in stop:
            greek = any("Ͱ" <= x <= "Ͽ" or "ἀ" <= x <= "῿" for x in p[max(lo, i - 6) : i])
            if stop.strip(";;") == "" and not (greek and gap and (c.isupper() or _caseless(c))):
                return False
        if any(x in CJK_STOPS for x in stop):
            return True
        if "…" in stop or "..." in stop:
            if before.isspace() or not before:
                return False
            if _cjk(before):
                return _cjk(c) or c.isupper() or c.isdigit() or c in OPENERS
            if not gap:
                return False
            if _caseless(c):
                return not _caseless(before) and not _cjk(before)
            return c.isupper() or (c.isdigit() and "..." in stop) or self.starter(t)
        if "!" in stop or "?" in stop:
            if c.islower():
                return gap and self.starter(t)
            if not gap:
                return c.isupper() or _caseless(c)
            return c.isalnum() or p[_BLANKS.match(p, e, hi).end()] in OPENERS
        if stop.strip(".") == "" or ";" in stop:
            if ";" in stop:
                return True
            a = _BEFORE.search(p, max(lo, i - 40), i).group()
            if not gap:
                # the blank is missing: only a word or number that surely ends, before a sure beginning
                number = re.fullmatch(r"\d+([.,]\d+)*", a) is not None
                if c.isdigit() and not _cjk(c):
                    return before.isalpha() and len(a) >= 3 and "." not in a and bool(re.match(r"\d{4}(?!\d)", p[e : e + 5]))
                if _cjk(c) or _thai(c):
                    return not _cjk(before)
                if not c.isupper() or not p[_BLANKS.match(p, e, hi).end() :][:2].strip(OPENERS):
                    return False
                if not a:
                    return True
                return number or (before.islower() and len(a) >= 3 and "." not in a)
            if not a:
                return True  # after a closing bracket or quote
            if a.isdigit() or re.fullmatch(r"\d+([.,]\d+)*", a):
                head = p[lo : i - len(a)]
                if not head.strip():
                    return False  # an enumerator
                prior = head.split()[-1]
                short = a.isdigit() and len(a) <= 2
                if c.islower():
                    return self.starter(t) and not short
                if short and c.isdigit():
                    return not (re.fullmatch(r"\d{1,2}\.", prior) or prior.lower() in ORDINAL_BEFORE)
                return not (short and prior.lower() in ORDINAL_BEFORE)
            last = next((x for x in reversed(a) if x.isalpha()), a[-1])
            if _caseless(last):
                if "ऀ" <= last <= "෿" or _thai(last):
                    return False  # these scripts end sentences otherwise
                plain = [x for x in re.split(r"[.\s]", a) if x]
                return not (plain and len(plain[-1]) <= 2)
            if not self.abbreviation(a):
                return True
            if c.islower():
                # a lower case word that only begins sentences, after an abbreviation that may end one
                return self.starter(t) and self.ends_sentences(a)
            if c.isdigit() or not (c.isalnum() or c in OPENERS):
                return self.ends_sentences(a) and c.isdigit() and self._stat(a, 1) < self._stat(a, 3)
            if _caseless(c):
                return True
            return self.ends_sentences(a)
        return True

    def _pairs(self, p: str) -> dict[int, int]:
        out: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in _PAIRED.finditer(p):
            i, c = m.start(), m.group()
            if c == '"':
                if any(o == '"' for o, _ in stack):
                    while stack[-1][0] != '"':
                        stack.pop()
                    out[stack.pop()[1]] = i
                else:
                    stack.append((c, i))
            elif any(c in PAIRS[o] for o, _ in stack[-3:]) and c != '"':
                while c not in PAIRS[stack[-1][0]]:
                    stack.pop()
                out[stack.pop()[1]] = i
            elif c in PAIRS:
                stack.append((c, i))
        return out

    def _alone(self, p: str, o: int, c: int, hi: int) -> bool:
        """Whether what opens at a sentence's start and closes at c is a unit of its own."""
        inner = p[o + 1 : c].rstrip()
        if not inner or inner[-1] not in STOPS + CLOSERS or inner.rstrip(CLOSERS)[-1:] not in STOPS:
            return _BLANKS.match(p, c + 1, hi).end() >= hi
        j = _BLANKS.match(p, c + 1, hi).end()
        if j >= hi:
            return True
        x = p[j]
        if x in OPENERS:
            return True
        if not x.isalnum():
            return False
        if x.islower():
            return self.starter(self._next(p, c + 1, hi)[2])
        if _caseless(x):
            if p[o] in "([（":
                return not _cjk(x) or p[o] == "（" or j > c + 1 or p[o] == "("
            if _cjk(x):
                if any("぀" <= y <= "ヿ" for y in inner):
                    return x not in JA_GOES_ON
                rest = re.split(r"[。！？!?]", p[j:hi], maxsplit=1)[0]
                return not (len(rest) <= 8 and any(y in ZH_SAYS for y in rest))
            return inner[-1] in ".।॥。…" or j > c + 1 and inner[-1] == "!"
        return True

    def paragraph(self, p: str, lo: int = 0, hi: int | None = None, pairs=None) -> list[int]:
        """The ends (exclusive) of the units of p[lo:hi]."""
        hi = len(p) if hi is None else hi
        pairs = self._pairs(p) if pairs is None else pairs
        ends: list[int] = []
        s = i = _BLANKS.match(p, lo, hi).end()
        while i < hi:
            if i == s and p[i] in OPENERS and pairs.get(i, hi) < hi:
                c = pairs[i]
                if self._alone(p, i, c, hi):
                    inside = self.paragraph(p, i + 1, c, pairs)
                    e = c + 1
                    ends += [*inside[:-1], e]
                    s = i = _BLANKS.match(p, e, hi).end()
                else:
                    i = c + 1
                continue
            m = _TERMINATOR.search(p, i, hi)
            if not m:
                break
            i, e = m.span()
            if p[i] in OPENERS:
                c = pairs.get(i, -1)
                if c < 0 or c >= hi:
                    i = e
                    continue
                inner = p[i + 1 : c].rstrip()
                i = c + 1
                if inner[-1:] in STOPS and inner and c + 1 < hi:
                    gap, x, t = self._next(p, i, hi)
                    quoted = p[c] not in ")]）"
                    if x and gap and quoted and x.isupper() and (self.starter(t) or inner[-1] == "."):
                        ends.append(i)
                        s = i = _BLANKS.match(p, i, hi).end()
                continue
            if m.group().isspace():
                nxt = p[e]
                if _thai(nxt) or nxt.isupper() or nxt in OPENERS:
                    ends.append(i)
                    s = i = e
                else:
                    i = e
                continue
            if self._boundary(p, s, i, e, hi):
                while e < hi and p[e] in CLOSERS and p[e] not in OPENERS:
                    e += 1
                ends.append(e)
                s = i = _BLANKS.match(p, e, hi).end()
            else:
                i = e
        if s < hi and p[s:hi].strip():
            ends.append(lo + len(p[lo:hi].rstrip()))
        return ends

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end), end exclusive, of the text's units."""
        out: list[tuple[int, int]] = []
        for start, end, whole in blocks(text):
            p = text[start:end]
            ends = [len(p.rstrip())] if whole else self.paragraph(p)
            s = 0
            for e in ends:
                s = _BLANKS.match(p, s, e).end()
                out.append((start + s, start + e))
                s = e
        return out


_COUNTS = ", ".join(f"{s} long" for s in STATS)


def ambiguous(text: str) -> set[str]:
    """The tokens of a text whose counts its split may need."""
    out = set()
    for start, end, whole in blocks(text):
        if whole:
            continue
        words = text[start:end].split()
        for k, raw in enumerate(words):
            if raw[-1] in _ENDS:
                tail = raw.rstrip(CLOSERS)[-1:]
                if tail and tail in STOPS:
                    if a := raw.strip(CORE).rstrip("."):
                        out.add(a)
                    if k + 1 < len(words) and (w := _WORD.search(words[k + 1])):
                        out |= {w.group(), w.group().lower()}
            if not raw.isalnum() and not raw[:-1].isalnum():
                for part in _INNER_STOP.findall(raw):
                    out |= {part, part.lower()}
    return out


_ROWS = ", ".join(["token string", *(f"{s} int" for s in STATS)])


def readings(docs: DataFrame, key: str, text: str, wanted=None) -> DataFrame:
    """Rows (k, token, counts...): of each document those of its ambiguous tokens, and with k null sums over all tokens of
    several documents. wanted: a condition on the documents that are to be split; the others count in the sums only."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def frame(keys, rows):
        return pd.DataFrame(rows, columns=["token", *STATS]).assign(k=pd.Series(keys, dtype=object))[["k", "token", *STATS]]

    def sums(total):
        items = iter(total.items())
        while rows := [(x, *v) for x, v in islice(items, ROWS)]:
            yield frame([None] * len(rows), rows)

    def read(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            keys, rows = [], []
            for key, t, split in zip(batch["k"].tolist(), batch["t"], batch["wanted"], strict=True):
                seen = evidence(t)
                for token in ambiguous(t) if split else ():
                    if len(token) <= LONGEST:
                        keys.append(key)
                        rows.append((token, *(seen.get(token) or (0,) * len(STATS))))
                for token, s in seen.items():
                    if len(token) > LONGEST:
                        continue
                    if (have := total.get(token)) is None:
                        total[token] = s
                    else:
                        for n, x in enumerate(s):
                            if x:
                                have[n] += x
                if len(rows) >= ROWS:
                    yield frame(keys, rows)
                    keys, rows = [], []
                if len(total) > HELD:
                    yield from sums(total)
                    total = {}
            yield frame(keys, rows)
        yield from sums(total)

    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), wanted.alias("wanted")).where("t <> ''")
    return rows.mapInPandas(read, f"k {kind}, {_ROWS}")


def sentence_units(docs: DataFrame, key: str, text: str, read: DataFrame) -> DataFrame:
    """Rows (key, unit, start_pos, end_pos, sentence), positions from 1, for every document.

    read: the readings of the corpus, of which docs are those wanted. Null, empty and blank texts
    have no units. Copies of a document must be removed before.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''")
    counts = read.where("k is null").groupBy("token").agg(F.array(*(F.sum(s) for s in STATS)).alias("all"))
    own = read.where("k is not null").select("k", "token", F.array(*STATS).alias("own"))
    known = own.join(counts, "token").groupBy("k").agg(F.collect_list(F.struct("token", "own", "all")).alias("stats"))

    def split(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                stats = batch.column("stats")
                each = stats.flatten()
                tokens = each.field("token").to_pylist()
                own, corpus = (each.field(c).flatten().to_numpy().reshape(-1, len(STATS)).tolist() for c in ("own", "all"))
                ends = np.cumsum(stats.value_lengths().fill_null(0).to_numpy())
                lengths, n, starts, stops, sentences = [], [], [], [], []
                lo = 0
                for t, hi in zip(batch.column("t").to_pylist(), ends.tolist(), strict=True):
                    units = Splitter(dict(zip(tokens[lo:hi], own[lo:hi])), dict(zip(tokens[lo:hi], corpus[lo:hi]))).units(t)
                    lo = hi
                    lengths.append(len(units))
                    n += range(1, len(units) + 1)
                    starts += [s + 1 for s, _ in units]
                    stops += [e for _, e in units]
                    sentences += [t[s:e] for s, e in units]
                keys = batch.column("k").take(pa.array(np.repeat(np.arange(batch.num_rows), lengths)))
                numbers = (pa.array(x, pa.int32()) for x in (n, starts, stops))
                yield pa.RecordBatch.from_arrays([keys, *numbers, pa.array(sentences, pa.string())], names=["k", "unit", "start_pos", "end_pos", "sentence"])

    kind = dict(docs.dtypes)[key]
    return (
        base.join(known, "k", "left")
        .mapInArrow(split, f"k {kind}, unit int, start_pos int, end_pos int, sentence string")
        .withColumnRenamed("k", key)
    )


def p3_sentences(spark, sf_dir) -> DataFrame:
    """The units of every original_converted text; copies of a row count once."""
    docs = table(spark, sf_dir, "original_converted").select("paper_id", "method", F.col("extracted_text").alias("text")).distinct()
    return sentence_units(docs, "paper_id", "text", written(readings(docs, "paper_id", "text")))


def p3_found(spark, sf_dir) -> DataFrame:
    """Rows (paper_id, end_pos) of the units of the papers with method markdown."""
    docs = table(spark, sf_dir, "original_converted").select("paper_id", "method", F.col("extracted_text").alias("text")).distinct()
    clean = F.col("method") == "markdown"
    read = written(readings(docs, "paper_id", "text", clean))
    return sentence_units(docs.where(clean), "paper_id", "text", read).select("paper_id", "end_pos")
