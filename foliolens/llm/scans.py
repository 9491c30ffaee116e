"""Problem 4: repair text from scanned pages.

Page furniture (running headers, footers, page numbers) is told from text by its
shape and by what it repeats; words broken at a line's end are joined across it.
Words that the clean texts of the corpus don't hold are looked up in a trie of
those that they do: a generalised Levenshtein automaton whose cheap edits are the
misreadings of characters finds every word within its bound. Candidates are ranked
by cost, then by the word before, then by frequency. A reference's raw text is
looked up in the words of its own fields.

The lookup is sharded by the three letters that words begin with: a query goes to every
shard that one of its readings within the bound begins with, so no word is missed. Where
any edit may count, a word keeps its beginning or its ending, so those are shards too.
A shard is a part of the vocabulary, never a group of rows: each distinct word
counts once there. Nothing is broadcast or collected. A worker hands its rows on after
each ROWS of them, however many texts a batch has.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.lookalike import normalised, skeleton
from foliolens.llm.trie import Trie, weighted
from foliolens.session import ship, table, written

# What a scan shows, and what may stand on the page.
MISREAD = {
    "f": ["t"], "c": ["e", "o"], "5": ["s"], "0": ["o"], "1": ["l", "i"], "i": ["l", "í"], "!": ["i", "l"], "|": ["l", "i"],
    "l": ["i"], "9": ["g"], "6": ["é", "ó", "ö", "b"], "@": ["a"], "b": ["h", "ß"], "h": ["li", "b"], "ü": ["ti"], "8": ["b"], "$": ["s"],
    "vv": ["w"], "rn": ["m"], "ri": ["n"], "ii": ["u", "n", "ü"], "cl": ["d"], "li": ["h"], "m": ["rn"], "u": ["ii"], "d": ["cl"],
    "w": ["vv"], "n": ["ri", "u"], "e": ["c"], "t": ["f"], "o": ["c"], "q": ["g"], "y": ["v"], "tn": ["m"], "nn": ["m"], "in": ["m"],
}
# Signs that stand for i and l.
SIGNS = {"i": "!1|l", "l": "1|!i"}


def _composed() -> dict[str, list[str]]:
    """MISREAD, and its pairs with the signs in place of their i and l: what is misread may be misread again."""
    out = {k: list(v) for k, v in MISREAD.items()}
    for pair, true in MISREAD.items():
        if len(pair) == 2:
            for x in pair[0] + SIGNS.get(pair[0], ""):
                for y in pair[1] + SIGNS.get(pair[1], ""):
                    have = out.setdefault(x + y, [])
                    have += [c for c in true if c not in have and c != x + y]
    out["rri"] = ["m"]
    return out


CONFUSIONS = _composed()
_ENDWARD = {k[::-1]: [c[::-1] for c in v] for k, v in CONFUSIONS.items()}
#: The cost of an edit that is no known misreading, in a word that shows a sign no writer puts into one, and in a word of
#: letters only: there it lies beyond every bound, as it would as well be the writer's slip.
EDIT, SLIP = 2, 4
_SIGNED = re.compile(r"(?=.*[^\W\d_])(?:.*[@!|$]|.*[^\W\d_]\d[^\W\d_])")


def edit_of(word: str) -> int:
    """What an edit of word costs that no confusion explains."""
    return EDIT if _SIGNED.match(word) else SLIP


#: Rows, or pairs of words, that a worker holds at most besides those of one text.
ROWS = 20_000
HYPHENS = "-‐\xad¬"
_END_HYPHEN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*$")
_NUM = r"[0-9lIO!|]*[0-9][0-9lIO!|]*"
_PAGE = re.compile(rf"[-–—]\s*{_NUM}\s*[-–—]|\[\s*{_NUM}\s*[\]lI1|]?|{_NUM}\s*/\s*{_NUM}|(?:p|pp|S|o)[.,]\s*{_NUM}|[PSo][\w@!]{{2,4}}[ec]?\s{_NUM}|{_NUM}")
_WORD_NUM = re.compile(rf"([^\W\d_][\w@!|$]{{2,6}}?)\s*{_NUM}")
# Words before the number of a page.
_PAGE_WORDS = Trie(["page", "seite", "oldal"])
_ET_AL = re.compile(r"[A-ZÀ-ÞŐŰ0-9'’!|-]{3,} et a[l1I!|]\.?")
_NUM_NAME = re.compile(rf"({_NUM})(\s+)([A-ZÀ-ÞŐŰ][\w'’!@-]+(?: [A-ZÀ-Þ][\w'’!@-]+)?)")
_TEXT_NUM = re.compile(rf"(.*\S)\s{{2,}}({_NUM})")
_SECTION_NUM = re.compile(rf"[A-Z][\w!@|]+(?: [\w!@|]+){{0,2}} {_NUM}")
#: Stripped from a word's ends; signs that may be misread letters stay.
PUNCTUATION = ".,;:?!\"'“”„‚‘’«»‹›()[]{}*_…–—/\\<>|~`^=+&#%"
_MULTI = (("vv", "w"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ti", "ü"))
_SINGLE = str.maketrans("f501l!|9@be8$6ó", "tsoiiiigahchsée", "")


@lru_cache(maxsize=20_000)
def folded(word: str) -> str:
    """word with characters that are misread for each other made one."""
    w = word.lower()
    for a, b in _MULTI:
        w = w.replace(a, b)
    return w.translate(_SINGLE).replace("é", "c")


def _beginnings(word: str, confusions: dict[str, list[str]], size: int, bound: int) -> set[str]:
    """The first `size` letters of all that word may be read as with at most `bound` confusions."""
    out: set[str] = set()
    stack = [(0, "", 0)]
    seen = set()
    while stack:
        i, head, cost = stack.pop()
        if len(head) >= size or i == len(word):
            out.add(head[:size])
            continue
        if (i, head, cost) in seen:
            continue
        seen.add((i, head, cost))
        stack.append((i + 1, head + word[i], cost))
        if cost < bound:
            for k in (1, 2, 3):
                if i + k <= len(word):
                    stack += [(i + k, head + true, cost + 1) for true in confusions.get(word[i : i + k], ())]
    return out


def shard_keys(word: str, query: bool) -> list[str]:
    """The shards where a word is kept, or looked up; every word within the bound of a query is in one of its shards.

    Confusions alone change the beginning in known ways. An edit beside them, which costs EDIT, leaves the first or the
    last three letters alone, in words of five letters or fewer the first or last two.
    """
    if not query:
        out = [f"p{word[:3]}", f"s{word[-3:]}"]
        return out + [f"P{word[:2]}", f"S{word[-2:]}"] if len(word) <= 5 else out
    bound = bound_of(word)
    keys = {f"p{x}" for x in _beginnings(word, CONFUSIONS, 3, bound)}
    rest = bound - edit_of(word)
    if rest >= 0:
        keys |= {f"s{x[::-1]}" for x in _beginnings(word[::-1], _ENDWARD, 3, rest)}
        if len(word) <= 8:
            keys |= {f"P{x}" for x in _beginnings(word, CONFUSIONS, 2, rest)} | {f"S{x[::-1]}" for x in _beginnings(word[::-1], _ENDWARD, 2, rest)}
    return sorted(keys)


def bound_of(word: str) -> int:
    """The cost that a word of this length may have."""
    return 1 if len(word) < 4 else 2 if len(word) < 7 else 3


def stripped(token: str) -> str:
    """A token without punctuation, quotes and brackets at its ends."""
    core = token.strip(PUNCTUATION)
    # a leading "!" before a letter is a misread letter, not punctuation
    at = token.find(core) if core else -1
    if at > 0 and token[at - 1] in "!|" and (at == 1 or token[at - 2] in "\"“„«(["):
        core = token[at - 1] + core
    return core


def maybe_misread(core: str) -> bool:
    """Whether a token may be a word at all: letters, and no date, number or file name."""
    return any(c.isalpha() for c in core) and not re.match(r"\d{2,}", core) and "." not in core[1:]


def shouted(token: str, core: str) -> str:
    """core with the "!" that follows it, which may be a misread letter; else core."""
    return core + "!" if f"{core}!" in token else core


@lru_cache(maxsize=20_000)
def page_word(s: str) -> bool:
    """Whether s is a word for page, misread or not, and a number."""
    m = _WORD_NUM.fullmatch(s)
    return bool(m and weighted(_PAGE_WORDS, m[1].lower(), CONFUSIONS, 2, edit_of(m[1])))


def running_lines(lines: list[str]) -> set[int]:
    """The indices of the lines of a page text that are headers, footers or page numbers."""
    out: set[int] = set()
    named: dict[str, list[int]] = {}
    tail: dict[str, list[int]] = {}
    for i, raw in enumerate(lines):
        s = raw.strip()
        if not s:
            continue
        if len(s) <= 14 and (page_word(s) or (_PAGE.fullmatch(s) and not re.match(r"[PSo]\w+\s", s))):
            out.add(i)
        elif _ET_AL.fullmatch(s):
            out.add(i)
        elif m := _NUM_NAME.fullmatch(s):
            named.setdefault(folded(m[3]), []).append(i)
            if len(m[2]) > 1 or len(m[1]) > 1:
                out.add(i)
        elif (m := _TEXT_NUM.fullmatch(s)) and not re.search(r"\d[.,]\d+\s*$", m[1]):
            tail.setdefault(folded(re.sub(r"\W+", " ", m[1])), []).append(i)
    for group in named.values():
        if len(group) > 1:
            out |= set(group)
        # a numbered heading stands between blank lines, a header may cut a paragraph
        out |= {i for i in group if i and _END_HYPHEN.search(lines[i - 1]) or 0 < i < len(lines) - 1 and lines[i - 1].strip() and lines[i + 1].strip()}
    title = next((i for i, s in enumerate(lines) if s.strip() and i not in out), None)
    heads: set[str] = set()
    if title is not None:
        # a first line that the next one repeats at greater length is a header itself
        flat = lambda s: folded(re.sub(r"\W+", " ", s).strip())
        own = lines[title].strip()
        if m := _TEXT_NUM.fullmatch(own):
            own = m[1]
        nxt = next((i for i in range(title + 1, len(lines)) if lines[i].strip() and i not in out), None)
        if nxt is not None and flat(lines[nxt]).startswith(flat(own)) and len(own.split()) >= 3:
            out.add(title)
            title = nxt
        full = lines[title].strip()
        if m := re.fullmatch(r"\d+\s+(.*)", full):
            full = m[1]
        heads = {flat(full), flat(re.split(r":", full)[0])}
        heads = {h for h in heads if len(h) > 8}
        for i, raw in enumerate(lines):
            s = raw.strip()
            if i != title and s and flat(s) in heads:
                out.add(i)
    for text, group in tail.items():
        text = text.strip()
        if text in heads or len(group) > 1 and len(text) > 12 and " " in text:
            out |= {i for i in group if i != title or text in heads and len(group) > 1}
    return out


def running_in_reference(lines: list[str]) -> set[int]:
    """The furniture among the lines of a reference: short lines inside it that the next word would still fit."""
    out: set[int] = set()
    width = max(map(len, lines), default=0)
    for i in range(1, len(lines) - 1):
        s = lines[i].strip()
        nxt = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
        word = nxt.split(" ", 1)[0]
        if not s or len(s) + 1 + len(word) > width:
            continue
        if len(s) <= 14 and (page_word(s) or _PAGE.fullmatch(s)) or len(s) < 45 and (_SECTION_NUM.fullmatch(s) or _NUM_NAME.fullmatch(s) or _ET_AL.fullmatch(s)):
            out.add(i)
    return out


def words_of(lines: list[str], running: set[int]):
    """(line index, token, rest, break) of the text's words in order, without furniture.

    rest is the part of a broken word that stands in a later line, else ''; break is
    the index of that line.
    """
    kept = [i for i in range(len(lines)) if i not in running and lines[i].strip()]
    taken = False
    for k, i in enumerate(kept):
        tokens = lines[i].split()
        start = 1 if taken else 0
        taken = False
        for n in range(start, len(tokens)):
            token = tokens[n]
            if n == len(tokens) - 1 and k + 1 < len(kept) and _END_HYPHEN.search(token) and len(token) > 1:
                rest = lines[kept[k + 1]].split()[0]
                if rest[0].isalnum() or rest[0] in "!@|":
                    taken = True
                    yield i, token, rest, kept[k + 1]
                    continue
            yield i, token, "", i


def with_case(seen: str, word: str, form: str, begins: bool) -> str:
    """word (lower case) in the case in which it stands as `seen`."""
    letters = [c for c in seen if c.isalpha() and c not in "IOilo"]
    if len(letters) >= 2 and all(c.isupper() for c in letters):
        return word.upper()
    first = next((c for c in seen if c.isalnum() or c in "!@|$"), "")
    if first.isalpha() and first != "I":
        return word[:1].upper() + word[1:] if first.isupper() else form if form[:1].islower() else word
    if form[:1].isupper() or begins:
        return form[:1].upper() + form[1:]
    return form


class OwnWords:
    """The words of a reference's own fields, in a trie of lower case forms."""

    def __init__(self, fields):
        self.forms: dict[str, str] = {}
        for f in fields:
            if f:
                if f[:1] == "[":
                    f = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), f)
                for token in skeleton(normalised(f)).replace("[", " ").replace("]", " ").split():
                    if core := stripped(token):
                        self.forms.setdefault(core, core)
        self.trie = None

    def has(self, core: str) -> bool:
        return core in self.forms

    def nearest(self, core: str) -> str | None:
        """The only best word within the bound of core."""
        if self.trie is None:
            self.trie = Trie()
            for f in self.forms:
                self.trie.add(f.lower(), f)
        found = weighted(self.trie, core.lower(), CONFUSIONS, bound_of(core), edit_of(core))
        if not found:
            return None
        least = min(found.values())
        best = [w for w, c in found.items() if c == least]
        same = [w for w in best if w.lower() == core.lower()]
        if same:
            # the case alone differs: "I" for "l" folds away only where the letters allow it
            return next((w for w in same if skeleton(w).replace("l", "I") == skeleton(core).replace("l", "I")), None)
        return min(best, key=lambda w: (abs(len(w) - len(core)), w))


_PLAIN_WORDS = {"anon", "in", "press", "n.d", "doi", "vol", "pp", "et", "al", "al.", "forthcoming", "n", "d"}


_BITS = re.compile(r"[^\s.,;:\"“”()\[\]{}*_…?/]+")


def surely_clean(raw: str, fields) -> bool:
    """Whether a raw text of one line holds no words but those of its fields, numbers and the usual marks."""
    if "\n" in raw:
        return False
    own = {w for f in fields if f for w in _BITS.findall(f)}
    return all(w in own or w.isdigit() or w.lower() in _PLAIN_WORDS or not any(map(str.isalpha, w)) for w in _BITS.findall(raw))


def repair_reference(raw: str, fields) -> tuple[list[tuple[int, str, str]], str]:
    """([(line number, kind, word)], continuous text) of one raw reference."""
    lines = raw.split("\n")
    running = running_in_reference(lines) if len(lines) > 2 else set()
    found = [(i + 1, "running", "") for i in sorted(running)]
    own = OwnWords(fields)
    text = []
    for i, token, rest, later in words_of(lines, running):
        if rest:
            head = _END_HYPHEN.sub("", token)
            joined, dashed = head + rest, f"{head}-{rest}"
            a, b = stripped(joined), stripped(dashed)
            word = a if own.has(a) else b if own.has(b) else None
            if word is None:
                x, y = own.nearest(a), own.nearest(b)
                word = x or y
                if word is not None:
                    cut = len(stripped(head))
                    same = word[:cut].lower() == stripped(head).lower()
                    found.append(((later if same else i) + 1, "misread", word))
                else:
                    word = a
            found.append((i + 1, "hyphen", word))
            base = a if word in (a, None) else b if word == b else a
            text.append((joined if base == a else dashed).replace(base, word))
            continue
        core = stripped(token)
        if core and not own.has(core) and core.lower() not in _PLAIN_WORDS and maybe_misread(core):
            word = None
            if (loud := shouted(token, core)) != core and (word := own.nearest(loud)) is not None:
                core = loud
            if word is not None or (word := own.nearest(core)) is not None:
                found.append((i + 1, "misread", word))
                token = token.replace(core, word)
        text.append(token)
    return found, " ".join(text)


FOUND = "src string, row_id long, line_no int, kind string, word string"


def repaired_references(refs: DataFrame) -> DataFrame:
    """Rows of FOUND for the raw texts of references, each read with its own fields."""
    ship(refs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for rid, raw, *fields in zip(b["ref_id"], b["raw_text"], b["title"], b["authors"], b["journal"], b["year"], b["doi"], strict=True):
                if not surely_clean(raw, fields):
                    rows += [("references", rid, *x) for x in repair_reference(raw, fields)[0]]
            yield pd.DataFrame(rows, columns=["src", "row_id", "line_no", "kind", "word"])

    cols = ["ref_id", "raw_text", "title", "authors", "journal", "year", "doi"]
    return refs.select(*cols).where("raw_text <> ''").mapInPandas(run, FOUND).distinct()


def page_words(docs: DataFrame) -> DataFrame:
    """Rows (row_id, line_no, kind, a, b, head, later, prev, begins) of the words of page texts.

    docs: row_id, text. kind running: a line of furniture; plain: a word a; broken: a word
    that goes on in line `later`, a without and b with its hyphen, head its first part. b of
    a plain word is the word with a "!" that follows it, if one does.
    """
    ship(docs.sparkSession)
    schema = "row_id long, line_no int, kind string, a string, b string, head string, later int, prev string, begins boolean"

    columns = ["row_id", "line_no", "kind", "a", "b", "head", "later", "prev", "begins"]

    def run(batches):
        for batch in batches:
            rows = []
            for rid, text in zip(batch["row_id"], batch["text"], strict=True):
                lines = text.split("\n")
                running = running_lines(lines)
                rows += [(rid, i + 1, "running", "", "", "", 0, "", False) for i in sorted(running)]
                prev, begins = "", True
                for i, token, rest, later in words_of(lines, running):
                    if rest:
                        head = _END_HYPHEN.sub("", token)
                        a, b = stripped(head + rest), stripped(f"{head}-{rest}")
                        rows.append((rid, i + 1, "broken", a, b, stripped(head), later + 1, prev, begins))
                        last, end = a, rest
                    else:
                        a = stripped(token)
                        if a and maybe_misread(a):
                            loud = shouted(token, a)
                            rows.append((rid, i + 1, "plain", a, loud if loud != a else "", "", 0, prev, begins))
                        last, end = a, token
                    prev, begins = last.lower(), end.rstrip("\"'”’»)]")[-1:] in ".!?:"
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return docs.where("text <> ''").mapInPandas(run, schema)


def word_pairs(clean: DataFrame) -> DataFrame:
    """Rows (first, form, n) of clean texts: a word as written after the lower case word before it, the count."""
    ship(clean.sparkSession)

    def frame(total):
        return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["first", "form", "n"])

    def run(batches):
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text in batch["text"]:
                first = ""
                for token in text.split():
                    core = stripped(token)
                    if core and any(c.isalpha() for c in core):
                        total[first, core] = total.get((first, core), 0) + 1
                    first = core.lower()
                if len(total) > 5 * ROWS:
                    yield frame(total)
                    total = {}
        yield frame(total)

    rows = clean.where("text <> ''").mapInPandas(run, "first string, form string, n long")
    return rows.groupBy("first", "form").agg(F.sum("n").alias("n"))


def vocabulary(pairs: DataFrame) -> DataFrame:
    """Rows (w, form, n) of word_pairs: the lower case words, the form seen most, the count."""
    forms = pairs.groupBy("form").agg(F.sum("n").alias("n"))
    return forms.withColumn("w", F.lower("form")).groupBy("w").agg(F.max_by("form", F.struct("n", "form")).alias("form"), F.sum("n").alias("n"))


def nearest_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (q, w, cost): for each distinct query q all words w within its bound, none is missed.

    queries: q; words: w. Both are sent to their shards; a task builds one trie for
    each shard it holds and walks it with the automata of the shard's queries.
    """
    ship(queries.sparkSession)
    keys = lambda query: F.pandas_udf("array<string>")(_key_maker(query))
    q = queries.select(F.col("q").alias("x"), F.lit(True).alias("is_query")).distinct()
    w = words.select(F.col("w").alias("x"), F.lit(False).alias("is_query")).distinct()
    sent = q.withColumn("key", F.explode(keys(True)("x"))).unionByName(w.withColumn("key", F.explode(keys(False)("x"))))

    def run(batches):
        shard: str | None = None
        trie = Trie()
        rows = []
        for batch in batches:
            for key, is_query, x in zip(batch["key"], batch["is_query"], batch["x"], strict=True):
                if key != shard:
                    shard, trie = key, Trie()
                if not is_query:  # a shard's words come before its queries
                    trie.add(x, x)
                    continue
                rows += [(x, y, c) for y, c in weighted(trie, x, CONFUSIONS, bound_of(x), edit_of(x)).items()]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=["q", "w", "cost"])
                    rows = []
        yield pd.DataFrame(rows, columns=["q", "w", "cost"])

    # of a shard without queries nothing is needed
    wanted = sent.where("is_query").select("key").distinct()
    both = sent.join(wanted, "key", "left_semi")
    return both.repartition("key").sortWithinPartitions("key", "is_query").mapInPandas(run, "q string, w string, cost int").distinct()


def _key_maker(query: bool):
    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda x: shard_keys(x, query))

    make.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return make


def repaired_pages(scans: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows of FOUND for page texts. scans, clean: row_id, text."""
    spark = scans.sparkSession
    ship(spark)
    seen = written(page_words(scans))
    pairs = written(word_pairs(clean))
    vocab = written(vocabulary(pairs))
    known = vocab.select(F.col("w").alias("q"), "form", "n")
    text = seen.where("kind <> 'running'")

    # the distinct words that the clean texts lack, with their best candidates there
    variants = F.array_distinct(F.filter(F.array(F.lower("a"), F.lower("b")), lambda x: x != ""))
    asked = text.select(F.explode(variants).alias("q")).distinct().join(known, "q", "left_anti")
    near = nearest_words(asked, vocab.select("w")).where("q <> w")
    least = F.min("cost").over(Window.partitionBy("q"))
    near = near.withColumn("least", least).where("cost = least").drop("least")
    near = written(near.join(known.withColumnRenamed("q", "w"), "w"))

    def readings(words):
        """Each word in its variants: q, dash (0: a, 1: b)."""
        both = F.array(*(F.struct(F.lower(c).alias("q"), F.lit(k).alias("dash")) for k, c in enumerate("ab")))
        some = F.filter(both, lambda x: x["q"] != "")
        return words.withColumn("id", F.xxhash64("row_id", "line_no", "a", "b", "prev", "later")).select("*", F.explode(some).alias("v")).select("*", "v.q", "v.dash").drop("v")

    def best(rows):
        """The best reading of each word: cost, then what the word before it says, then frequency."""
        together = pairs.select(F.col("first").alias("prev"), F.lower("form").alias("w"), "n").groupBy("prev", "w").agg(F.sum("n").alias("together"))
        ranked = rows.join(together, ["prev", "w"], "left").withColumn("together", F.coalesce("together", F.lit(0)))
        order = Window.partitionBy("id").orderBy("cost", F.desc("together"), F.desc("n"), "dash", "w")
        return ranked.withColumn("r", F.row_number().over(order)).where("r = 1")

    @F.pandas_udf("string")
    def cased(seen_: pd.Series, w: pd.Series, form: pd.Series, begins: pd.Series) -> pd.Series:
        return pd.Series([with_case(s, x, f, bool(g)) for s, x, f, g in zip(seen_, w, form, begins, strict=True)], dtype=object)

    word = cased(F.when(F.col("dash") == 1, F.col("b")).otherwise(F.col("a")), "w", "form", "begins")
    src = F.lit("converted").alias("src")

    # whole words: those whose plain form is unknown
    plain = text.where("kind = 'plain'").select("row_id", "line_no", "a", "b", "prev", "begins", "later")
    unknown = plain.join(asked.select(F.col("q").alias("u")), F.lower("a") == F.col("u"), "left_semi")
    wrong = best(readings(unknown).join(near, "q")).withColumn("word", word)
    misread = wrong.select(src, "row_id", "line_no", F.lit("misread").alias("kind"), "word")

    # broken words: a known variant, else, where the word shows a sign that is no letter, a candidate
    broken = text.where("kind = 'broken'").select("row_id", "line_no", "a", "b", "head", "prev", "begins", "later")
    each = readings(broken)
    exact = each.join(known, "q").withColumn("w", F.col("q")).withColumn("cost", F.lit(0))
    guessed = each.where(F.col("a").rlike(r"[0-9!@|$]")).join(near, "q")
    cols = ["id", "row_id", "line_no", "later", "a", "b", "head", "prev", "begins", "dash", "w", "form", "n", "cost"]
    chosen = best(exact.select(*cols).unionByName(guessed.select(*cols))).withColumn(
        "word", F.when(F.col("cost") > 0, word).when(F.col("dash") == 1, F.col("b")).otherwise(F.col("a"))
    )
    ids = broken.withColumn("id", F.xxhash64("row_id", "line_no", "a", "b", "prev", "later")).select("id", "row_id", "line_no", "a")
    hyphen = ids.join(chosen.select("id", "word"), "id", "left").select(
        src, "row_id", "line_no", F.lit("hyphen").alias("kind"), F.coalesce("word", "a").alias("word")
    )
    same_head = F.lower(F.substring(F.col("word"), 1, F.length("head"))) == F.lower("head")
    half = chosen.where("cost > 0").select(src, "row_id", F.when(same_head, F.col("later")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"), "word")
    running = seen.where("kind = 'running'").select(src, "row_id", "line_no", "kind", F.lit("").alias("word"))
    return running.unionByName(misread).unionByName(hyphen).unionByName(half).distinct()


def _inputs(spark, sf_dir):
    texts = table(spark, sf_dir, "original_converted").select("paper_id", "method", "extracted_text").distinct()
    scans = texts.where("method = 'scan'").select(F.col("paper_id").alias("row_id"), F.col("extracted_text").alias("text"))
    clean = texts.where("method = 'markdown'").select(F.col("paper_id").alias("row_id"), F.col("extracted_text").alias("text"))
    refs = table(spark, sf_dir, "original_references").select("ref_id", "raw_text", "title", "authors", "journal", "year", "doi")
    return scans, clean, refs


def p4_found(spark, sf_dir) -> DataFrame:
    """Rows (src, row_id, line_no, kind, word): what is repaired in page texts and references.

    Null and empty texts have no rows; copies of a row count once; a text without any
    noise has no rows; a word without a candidate within the bound stays as it is.
    """
    scans, clean, refs = _inputs(spark, sf_dir)
    return repaired_pages(scans, clean).unionByName(repaired_references(refs))


def p4_texts(spark, sf_dir) -> DataFrame:
    """Rows (src, row_id, text): page texts and references as continuous paragraphs."""
    scans, clean, refs = _inputs(spark, sf_dir)
    ship(spark)
    found = repaired_pages(scans, clean)
    notes = found.groupBy("row_id").agg(F.collect_list(F.struct("line_no", "kind", "word")).alias("notes"))

    def pages(batches):
        for b in batches:
            yield pd.DataFrame(
                {"src": "converted", "row_id": b["row_id"], "text": [reflowed(t, n if n is not None else []) for t, n in zip(b["text"], b["notes"], strict=True)]}
            )

    def raws(batches):
        for b in batches:
            texts = [repair_reference(raw, f)[1] for raw, *f in zip(b["raw_text"], b["title"], b["authors"], b["journal"], b["year"], b["doi"], strict=True)]
            yield pd.DataFrame({"src": "references", "row_id": b["ref_id"], "text": texts})

    schema = "src string, row_id long, text string"
    one = scans.where("text <> ''").join(notes, "row_id", "left").mapInPandas(pages, schema)
    return one.unionByName(refs.where("raw_text <> ''").distinct().mapInPandas(raws, schema))


def reflowed(text: str, notes) -> str:
    """The page text without furniture, its words joined and put right, one line a paragraph."""
    lines = text.split("\n")
    running = {n["line_no"] - 1 for n in notes if n["kind"] == "running"}
    joins = {n["line_no"] - 1: n["word"] for n in notes if n["kind"] == "hyphen"}
    right: dict[int, list[str]] = {}
    for n in notes:
        if n["kind"] == "misread":
            right.setdefault(n["line_no"] - 1, []).append(n["word"])
    parts: list[list[str]] = [[]]
    previous = -1
    for i, token, rest, _ in words_of(lines, running):
        gap = any(not lines[k].strip() for k in range(previous + 1, i) if k not in running) or (i != previous and lines[i].startswith("   "))
        if i != previous and previous >= 0 and gap and not any(k in running for k in range(previous + 1, i)):
            parts.append([])
        previous = i
        if rest and i in joins:
            head = _END_HYPHEN.sub("", token)
            core = stripped(head + rest)
            token = (head + rest).replace(core, joins[i]) if core else joins[i]
        else:
            core = stripped(token)
            for w in right.get(i, ()):
                if core and core.lower() != w.lower() and weighted(Trie([w.lower()]), core.lower(), CONFUSIONS, bound_of(core), edit_of(core)):
                    token = token.replace(core, w)
                    break
        parts[-1].append(token)
    return "\n\n".join(" ".join(p) for p in parts if p)
