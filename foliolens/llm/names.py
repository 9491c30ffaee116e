"""Problem 6: link the variant spellings of people's and organisations' names.

Names are read into a rare token (surname, or the place in an organisation's name)
and the rest (given names, initials, the organisation's other words). Rare tokens
within two edits of each other are found by a trie join: every token is cut into
two segments, of which one edit leaves one whole, and into three for two edits, and sent
to the shards of its segments; a task builds the trie of a shard and walks it with the
Levenshtein automata of the shard's other tokens. Names with one rare token are grouped into
entities by what else they say, in any order of tokens, a part for each letter that a
given name begins with, so that a hot surname is no single task; entities of neighbouring
rare tokens are joined where the rest agrees, those of one rare token where the given
names are neighbours across parts.

Every distinct name counts once, whatever its number of rows. Only tokens that
occur with a fixed share of all names reach the driver: a few hundred at most.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.canonical import _distance
from foliolens.llm.trie import Trie, within
from foliolens.session import ship, table, written

#: A token is a common one if it stands beside so many others, and beside this share of all names.
LEAST_PARTNERS, SHARE = 8, 0.001
BOUND = 2
#: Shares of the tokens up to which a trigram is one that tokens hardly have, and so for a name seen at most twice.
ODD, ODD_RARE = 0.00025, 0.0006
# Short forms of given names.
SHORT_FORMS = {
    "abby": "abigail", "agi": "agnes", "alec": "alexander", "alex": "alexander", "sasha": "alexander", "sandy": "alexander",
    "andy": "andrew", "tony": "anthony", "babs": "barbara", "barb": "barbara", "beth": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "ben": "benjamin", "bea": "beatrice", "bill": "william",
    "will": "william", "willy": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert",
    "bobby": "robert", "robbie": "robert", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher",
    "kit": "christopher", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "rich": "richard",
    "rick": "richard", "ricky": "richard", "dima": "dmitri", "mitya": "dmitri", "dora": "dorothea", "thea": "dorothea",
    "dot": "dorothea", "dorle": "dorothea", "ed": "edward", "eddie": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "ellie": "eleanor", "fran": "francesca", "frank": "francis", "fred": "frederick", "gene": "eugene", "greg": "gregory",
    "hank": "henry", "harry": "henry", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan",
    "kate": "katherine", "kathy": "katherine", "kathie": "katherine", "katie": "katherine", "kitty": "katherine", "ken": "kenneth", "larry": "lawrence",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael",
    "mick": "michael", "misha": "michael", "nate": "nathaniel", "nat": "nathaniel", "nick": "nicholas", "pat": "patricia",
    "pete": "peter", "pista": "istvan", "phil": "philip", "ron": "ronald", "sam": "samuel", "steve": "stephen",
    "sue": "susanna", "susie": "susanna", "suzy": "susanna", "tim": "timothy", "tom": "thomas", "uschi": "ursula", "vicky": "victoria", "wally": "walter", "walt": "walter",
    "zoli": "zoltan", "jutka": "judit", "ica": "ilona", "izzy": "isabelle", "bella": "isabelle", "joska": "jozsef",
}
# Contractions in names of organisations, and words without weight there.
CONTRACTIONS = {"natl": "national", "ctr": "centre", "center": "centre", "dept": "department", "intl": "international", "assn": "association", "govt": "government", "univ": "university"}
SMALL = {"the", "of", "for", "and", "in", "on", "de", "la", "der", "die", "das", "fur", "et", "und", "du", "des"}
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def folded(text: str) -> str:
    t = text.lower()
    if t.isascii():
        return t
    t = unicodedata.normalize("NFKD", t.translate(_SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def tokens_of(name: str) -> list[str]:
    """The folded words of a name; hyphens and apostrophes inside a word go."""
    return re.findall(r"[^\W\d_]+", folded(re.sub(r"(?<=\w)['’‐‑-](?=\w)", "", name)))


def close(a: str, b: str) -> bool:
    """One typing error apart; two in long words."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3:
        return False
    return _distance(a, b) <= (2 if min(len(a), len(b)) >= 8 else 1)


def shortened(word: str) -> set[str]:
    """word and its forms with one letter left out, or with up to two if it is long."""
    out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= 8:
        out |= {x[:i] + x[i + 1 :] for x in list(out) for i in range(len(x))}
    return out


class Reader:
    """Reads names, given the common tokens of all of them."""

    def __init__(self, common: set[str]):
        self.common = common
        self.memo: dict[str, str] = {}
        self.starts: dict[str, list[str]] = defaultdict(list)
        self.cuts: dict[str, list[str]] = defaultdict(list)
        for c in sorted(common):
            for n in range(3, len(c)):
                self.starts[c[:n]].append(c)
            for x in shortened(c):
                self.cuts[x].append(c)

    def near(self, w: str) -> list[str]:
        """The common tokens close to w: those that share a form with up to as many letters left out."""
        found = {c for x in shortened(w) for c in self.cuts.get(x, ())}
        return sorted(c for c in found if close(w, c))

    def known(self, w: str, cut: bool = False) -> str:
        """The common token that w stands for, else ''."""
        if w in self.common:
            return w
        if (have := self.memo.get(w)) is None:
            have = ""
            if w in CONTRACTIONS and CONTRACTIONS[w] in self.common:
                have = CONTRACTIONS[w]
            elif w in SHORT_FORMS:
                have = SHORT_FORMS[w]
            else:
                starts = self.starts.get(w, []) if len(w) >= 3 else []
                near = [] if starts or len(w) < 3 else self.near(w)
                have = min(starts or near, key=lambda c: (_distance(w, c), c)) if starts or near else ""
            self.memo[w] = have
        return have

    def read(self, name: str) -> tuple[str, str, str, str]:
        """(kind, rare token, rest, initials): kind p for people, o for organisations, a for an
        organisation's initials beside its place. rest: the given name, or the sorted words."""
        bare = re.sub(r"\(([^()]*)\)", r" \1 ", name)
        words = tokens_of(bare)
        if not words:
            return "", "", "", ""
        long = [w for w in words if len(w) >= 3 and w not in SMALL]
        if len(words) >= 5 or "&" in name or (len(words) >= 4 and any(w in SMALL for w in words)):
            return self._organisation(bare)
        upper = [folded(t) for t in re.findall(r"\b[^\W\d_]{3,7}\b", bare) if t.isupper()]
        if len(words) == 2 and len(upper) == 1 and "," not in bare:
            other = next((w for w in words if w != upper[0]), "")
            if len(other) > 5 and not self.known(other) and len(upper[0]) <= 6:
                return "a", other, "", "".join(sorted(upper[0]))
        return self._person(bare, long)

    def _organisation(self, bare: str) -> tuple[str, str, str, str]:
        acronyms = set()
        if not bare.isupper():
            acronyms = {folded(t) for t in re.findall(r"\b[^\W\d_]{3,7}\b", bare) if t.isupper()}
        kept, rare = [], []
        for w in tokens_of(bare):
            if w in SMALL or w in acronyms or len(w) < 2:
                continue
            k = self.known(w) if len(w) >= 3 else ""
            (kept if k else rare).append(k or w)
        # small words with typing errors are no places
        rare = [w for w in rare if len(w) > 4 or not any(_distance(w, s) <= 1 for s in SMALL)] or rare
        if not rare:
            kept.sort(key=len)
            rare = [kept.pop()] if kept else [""]
        place = max(rare, key=len)
        rest = sorted(kept + [w for w in rare if w != place])
        return "o", place, " ".join(rest), "".join(sorted(w[0] for w in [place, *rest]))

    def _person(self, bare: str, long: list[str]) -> tuple[str, str, str, str]:
        left, _, right = (x.strip() for x in bare.partition(","))

        def split(part):
            words, initials, order = [], [], []
            for raw in re.findall(r"[^\s,;]+", part):
                pieces = re.findall(r"[^\W\d_]+\.?", raw)
                if not pieces:
                    continue
                letters = [p.rstrip(".") for p in pieces]
                dotted = all(p.endswith(".") or len(x) == 1 for p, x in zip(pieces, letters))
                if all(len(x) <= 2 for x in letters) and (dotted or raw.isupper()):
                    short = [folded(c) for x in letters for c in x]
                    initials += short
                    order += [("i", c) for c in short]
                elif sum(map(len, letters)) >= 2:
                    w = folded("".join(letters))
                    # Jean-Luc and JeanLuc have two initials
                    caps = [folded(c) for c in re.findall(r"(?:(?<=[^\W\d_])[-‐‑]|(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ]))([^\W\d_])", raw)]
                    words.append((w, "".join([w[0], *caps])))
                    order.append(("w", w))
            return words, initials, order

        if right:
            lw, li, _ = split(left)
            rw, ri, order = split(right)
            if lw and (rw or (ri and len(lw) == 1)):
                surname = "".join(w for w, _ in lw)
                given = self._joined(rw)
                return "p", surname, given[0], self._initials(given, li + ri, order)
            words, initials, order = lw + rw, li + ri, []
        else:
            words, initials, order = split(bare)
        if not words:
            return "", "", "", ""
        if len(words) == 1:
            return "p", words[0][0], "", "".join(initials)
        if len(words) > 2:
            # a double given name written apart
            for k in range(len(words) - 1):
                both = words[k][0] + words[k + 1][0]
                if both in self.common or any(len(c) > 7 for c in self.near(both)):
                    words = [*words[:k], (both, words[k][1][0] + words[k + 1][1][0]), *words[k + 2 :]]
                    break
        like = [bool(self.known(w)) for w, _ in words]
        at = like.index(True) if like.count(True) == 1 else like.index(True) if True in like and words[like.index(True)][0] in self.common else 0
        if like.count(True) > 1:
            exact = [k for k, (w, _) in enumerate(words) if w in self.common]
            at = exact[0] if len(exact) == 1 else 0
        given = self._joined([words[at]])
        surname = "".join(w for k, (w, _) in enumerate(words) if k != at)
        return "p", surname, given[0], self._initials(given, initials, order)

    def _joined(self, words):
        return ("".join(w for w, _ in words), "".join(i for _, i in words)) if words else ("", "")

    def _initials(self, given, initials, order):
        """The given name's initials, a bar, the other initials; without a given name all of them."""
        return f"{given[1]}|{''.join(initials)}" if given[0] else "".join(initials)


def same_given(a: str, b: str) -> bool:
    """Whether two given names, in full, cut short or misspelt, may be one."""
    a2, b2 = SHORT_FORMS.get(a, a), SHORT_FORMS.get(b, b)
    if a2 == b2:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and (long.startswith(short) or SHORT_FORMS.get(short) == long):
        return True
    return close(a2, b2) or close(a, b) or (len(short) >= 4 and len(long) > len(short) + 1 and close(short, long[: len(short)]) and short[0] == long[0])


def initials_fit(initials: str, given: str, given_initials: str, middle: str) -> bool:
    """Whether bare initials may stand for a given name with these initials and middle initial."""
    if not initials or not given:
        return False
    forms = {given_initials, given_initials[:1]} | {f[:1] + f[1:] for f in (given_initials,)}
    full = set()
    for f in forms:
        full |= {f, f + middle}
    return initials in full


def entities_of(rows):
    """[(row, entity)] of the names with one rare token; rows: (name, n, kind, rest, initials).

    An entity is (kind, rest, initials, middle): what the most frequent full form says.
    """
    out = []
    people = [r for r in rows if r[2] == "p" and r[3]]
    bare = [r for r in rows if r[2] == "p" and not r[3]]
    groups: list[dict] = []
    weight = Counter()
    for r in people:
        weight[SHORT_FORMS.get(r[3], r[3])] += r[1] if r[3] not in SHORT_FORMS else 0
        weight[r[3]] += 0
    # long and frequent forms first, so that cuts and slips join them
    for r in sorted(people, key=lambda r: (-weight[SHORT_FORMS.get(r[3], r[3])], -r[1], r[0])):
        own, _, middle = r[4].partition("|")
        for g in groups:
            if same_given(r[3], g["given"]) and (not middle or not g["middle"] or middle == g["middle"]):
                break
        else:
            g = {"given": SHORT_FORMS.get(r[3], r[3]), "own": own, "middle": "", "n": 0, "rows": []}
            groups.append(g)
        g["rows"].append(r)
        g["n"] += r[1]
        g["middle"] = g["middle"] or middle
        if len(own) > len(g["own"]):
            g["own"] = own
    loose: dict[str, list] = defaultdict(list)
    for r in bare:
        fit = [g for g in groups if initials_fit(r[4], g["given"], g["own"], g["middle"])]
        exact = [g for g in fit if r[4] == g["own"] + g["middle"]]
        if len(r[4]) > 1 and exact:
            fit = exact
        fit.sort(key=lambda g: -g["n"])
        if len(fit) == 1 or (len(fit) > 1 and fit[0]["n"] >= 3 * fit[1]["n"]):
            fit[0]["rows"].append(r)
        else:
            loose[r[4]].append(r)
    for g in groups:
        out += [(r, ("p", g["given"], g["own"], g["middle"])) for r in g["rows"]]
    for initials, rs in loose.items():
        out += [(r, ("p", "", initials, "")) for r in rs]
    full: dict[str, list] = defaultdict(list)
    for r in rows:
        if r[2] == "o":
            full[r[3]].append(r)
    for rest, rs in full.items():
        out += [(r, ("o", rest, rs[0][4], "")) for r in rs]
    for r in rows:
        if r[2] == "a":
            fit = [(sum(x[1] for x in rs), rest, rs[0][4]) for rest, rs in full.items() if acronym_fits(r[4], rs[0][4])]
            out.append((r, ("o", *max(fit)[1:], "") if fit else ("o", "", r[4], "")))
    return out


def acronym_fits(acronym: str, initials: str) -> bool:
    """Whether sorted acronym letters are an organisation's sorted initials, one of which may be left out."""
    a, b = Counter(acronym), Counter(initials)
    return not a - b and sum((b - a).values()) <= 1


def entities_agree(a, b) -> bool:
    """Whether entities (kind, rest, initials, middle) of neighbouring rare tokens may be one."""
    if a[0] != b[0]:
        return False
    if a[0] == "o":
        return a[1] == b[1] if a[1] and b[1] else acronym_fits(a[2], b[2]) or acronym_fits(b[2], a[2])
    if a[3] and b[3] and a[3] != b[3]:
        return False
    if a[1] and b[1]:
        return same_given(a[1], b[1])
    if not a[1] and not b[1]:
        return a[2] == b[2]
    bare, full = (a, b) if not a[1] else (b, a)
    return initials_fit(bare[2], full[1], full[2], full[3])


def name_list(refs: DataFrame, column: str = "authors") -> DataFrame:
    """Rows (name, n): the distinct names of the lists and how many rows hold each."""
    a = F.trim(F.regexp_replace(F.col(column), r"^(?U)\s+|(?U)\s+$", ""))
    listed = F.when(a.startswith("["), F.coalesce(F.from_json(a, "array<string>"), F.array())).otherwise(F.split(a, ";"))
    name = F.regexp_replace("name", r"^(?U)\s+|(?U)\s+$", "")
    return (
        refs.where(F.col(column).isNotNull())
        .select(F.explode(listed).alias("name"))
        .select(name.alias("name"))
        .where("name <> '' and name <> 'et al.'")
        .groupBy("name")
        .agg(F.count("*").alias("n"))
    )


def common_tokens(names: DataFrame) -> set[str]:
    """The tokens beside at least LEAST_PARTNERS others and SHARE of the names; at most 5 / SHARE of them."""
    ship(names.sparkSession)

    def pairs(batches):
        for b in batches:
            rows = set()
            for name in b["name"]:
                ts = [t for t in tokens_of(name) if len(t) >= 3 and t not in SMALL]
                rows.update((x, y) for x in ts for y in ts if x != y)
            yield pd.DataFrame(list(rows), columns=["token", "other"])

    least = max(LEAST_PARTNERS, int(SHARE * names.count()))
    rows = (
        names.select("name")
        .mapInPandas(pairs, "token string, other string")
        .distinct()
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .collect()
    )
    return {r.token for r in rows}


def _segments(m: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a token of length m."""
    cuts = [m * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def keys_of(token: str) -> list[str]:
    """The shards in which a token is kept: the number of segments, its length, the segment's number and text."""
    m = len(token)
    return [f"{bound + 1}:{m}:{k}:{token[a:b]}" for bound in range(1, BOUND + 1) for k, (a, b) in enumerate(_segments(m, bound + 1))]


def probes_of(token: str, bound: int = BOUND) -> list[str]:
    """The shards that may keep a token within `bound` edits, one or two, of this one.

    Let each edit count in one segment of the other token, an insertion between two in the later one. The
    first segment k such that segments 0 to k have at most k edits has none, k stand before it and at most
    bound - k after it. Only a swap over a cut is in two segments. It leaves one whole if the other edit is
    in one of these two; else the outer one of them is looked up with the swap put back.
    """
    n, out = len(token), set()
    for m in range(max(1, n - bound), n + bound + 1):
        cut = _segments(m, bound + 1)
        at = f"{bound + 1}:{m}"
        for k, (a, b) in enumerate(cut):
            for shift in range(-k, k + 1):
                if abs(n - m - shift) <= bound - k and a + shift >= 0 and b + shift <= n:
                    out.add(f"{at}:{k}:{token[a + shift : b + shift]}")
        if abs(n - m) < bound:
            first, last = cut[0][1], cut[-1][0] + n - m
            if 0 < first < n:
                out.add(f"{at}:0:{token[: first - 1]}{token[first]}")
            if bound > 1 and 0 < last < n:
                out.add(f"{at}:{bound}:{token[last - 1]}{token[last + 1 :]}")
    return sorted(out)


@lru_cache(maxsize=1000)
def limits_of(bound: int, m: int, k: int) -> tuple[tuple[int, int], ...]:
    """How many edits, see probes_of, lie in the segments that are walked first in a shard of segment k, as `within` takes it.

    The last segment's shards are walked from the end: no edit in it, at most one up to the segment before it.
    """
    sizes = [b - a for a, b in _segments(m, bound + 1)]
    steps = list(enumerate(sizes[:0:-1])) if k == bound else [(k, sum(sizes[: k + 1]))]
    out = [(steps[0][0],) * 2]
    for (edits, size), more in zip(steps, [*(e for e, _ in steps[1:]), bound], strict=True):
        # a segment without letters has no limit of its own, nor has what comes behind it
        if not size:
            return ()
        out += [(edits, edits)] * (size - 1) + [(edits, more)]
    return tuple(out)


def neighbours(tokens: DataFrame, shortest: int = 4) -> DataFrame:
    """Rows (a, b, distance) of the distinct tokens b within the bound of the tokens a, a <> b.

    tokens: token, bound. A swap of neighbours is one edit. All pairs within the bound are found.
    Tokens of fewer than `shortest` letters have no neighbours: at one edit most short surnames are other names.
    """
    ship(tokens.sparkSession)

    @F.pandas_udf("array<string>")
    def kept(s: pd.Series) -> pd.Series:
        return s.map(keys_of)

    @F.pandas_udf("array<string>")
    def probed(s: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([probes_of(t, k) for t, k in zip(s, bound, strict=True)], dtype=object)

    t = tokens.where(F.length("token") >= shortest).groupBy("token").agg(F.max("bound").cast("int").alias("bound"))
    index = t.select("token", F.explode(kept("token")).alias("key"), F.lit(0).alias("bound"))
    probe = t.select("token", F.explode(probed("token", "bound")).alias("key"), "bound")
    sent = index.unionByName(probe).repartition("key").sortWithinPartitions("key", "bound")

    def run(batches):
        key, inside, trie, turned, limits = None, [], None, False, ()
        rows = []
        for b in batches:
            for k, token, bound in zip(b["key"], b["token"], b["bound"], strict=True):
                if k != key:
                    key, inside, trie = k, [], None
                if not bound:
                    inside.append(token)
                    continue
                if not inside or inside == [token]:
                    continue
                if trie is None:
                    # tokens that end alike are read from their end, so that they part late
                    parts, m, segment, _ = k.split(":", 3)
                    most, segment = int(parts) - 1, int(segment)
                    turned, limits = segment == most, limits_of(most, int(m), segment)
                    trie = Trie()
                    for x in inside:
                        trie.add(x[::-1] if turned else x, x)
                rows.extend((token, x, d) for x, d in within(trie, token[::-1] if turned else token, bound, limits).items() if x != token)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["a", "b", "distance"])
                rows = []
        yield pd.DataFrame(rows, columns=["a", "b", "distance"])

    # within its limits a shard may know a pair by a longer way than another shard
    return sent.mapInPandas(run, "a string, b string, distance int").groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _trigrams(token: str) -> set[str]:
    w = "^" + "".join(c if "a" <= c <= "z" else "?" for c in token) + "$"
    return {w[i : i + 3] for i in range(len(w) - 2)}


def trigram_counts(tokens: DataFrame) -> dict[str, int]:
    """In how many distinct tokens each trigram occurs; the alphabet is fixed, so at most 29^3 rows."""

    def count(batches):
        for b in batches:
            total: Counter = Counter()
            for t in b["token"]:
                total.update(_trigrams(t))
            yield pd.DataFrame({"g": list(total), "n": list(total.values())}, columns=["g", "n"])

    rows = tokens.select("token").distinct().mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    return {r.g: r.n for r in rows}


def linked_names(names: DataFrame) -> DataFrame:
    """Rows (name, entity) of the distinct names; names with one entity are one person or organisation.

    names: name, n. Names without a word have no entity. Bare initials that fit several
    people of a surname, none of them far more frequent, are an entity of their own.
    """
    spark = names.sparkSession
    ship(spark)
    # read three times below
    names = written(names)
    reader = Reader(common_tokens(names))

    def part_of(kind, token, rest, initials):
        """A hot surname's people fall into parts by what their given names begin with."""
        return (SHORT_FORMS.get(rest, rest) or initials)[:1] if kind == "p" else "organisation"

    def parse(batches):
        for b in batches:
            read = [(name, n, *reader.read(name)) for name, n in zip(b["name"], b["n"], strict=True)]
            yield pd.DataFrame([(*r, part_of(*r[2:])) for r in read], columns=["name", "n", "kind", "token", "rest", "initials", "part"])

    parsed = names.mapInPandas(parse, "name string, n long, kind string, token string, rest string, initials string, part string").where("token <> ''")

    def group(batches):
        token, part, held = None, None, []
        rows = []

        def close_group():
            for r, e in entities_of(held):
                rows.append((token, r[0], r[1], *e))

        cols = ["token", "name", "n", "kind", "rest", "initials", "middle"]
        for b in batches:
            for t, p, *r in zip(b["token"], b["part"], b["name"], b["n"], b["kind"], b["rest"], b["initials"], strict=True):
                if t != token or p != part:
                    close_group()
                    token, part, held = t, p, []
                held.append(r)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=cols)
                rows = []
        close_group()
        yield pd.DataFrame(rows, columns=cols)

    grouped = written(
        parsed.repartition("token", "part")
        .sortWithinPartitions("token", "part", "name")
        .mapInPandas(group, "token string, name string, n long, kind string, rest string, initials string, middle string")
        .withColumn("entity", F.concat_ws("\t", "kind", "token", "rest", "initials"))
    )
    ents = grouped.groupBy("entity", "token", "kind", "rest", "initials", "middle").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    ents = written(ents)
    trigrams = trigram_counts(ents)
    n_tokens = ents.select("token").distinct().count()

    @F.pandas_udf("int")
    def rarest(s: pd.Series) -> pd.Series:
        return s.map(lambda t: min(trigrams.get(g, 0) for g in _trigrams(t))).astype("int32")

    @F.pandas_udf("boolean")
    def agree(k1: pd.Series, r1: pd.Series, i1: pd.Series, m1: pd.Series, k2: pd.Series, r2: pd.Series, i2: pd.Series, m2: pd.Series) -> pd.Series:
        a, b = zip(k1, r1, i1, m1), zip(k2, r2, i2, m2)
        return pd.Series([entities_agree(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")

    # where two edits can't count as a slip, see `sure` below, tokens at two edits aren't looked for
    two = (F.length("token") >= 8) & (F.col("forms") == 1) & (rarest("token") <= F.greatest(F.lit(1), F.lit(ODD_RARE * n_tokens)))
    near = neighbours(ents.select("token", F.when(two, BOUND).otherwise(1).alias("bound")))
    cols = ["entity", "token", "kind", "rest", "initials", "middle", "n", "forms"]
    x = ents.select(*(F.col(c).alias(f"x_{c}") for c in cols))
    y = ents.select(*(F.col(c).alias(f"y_{c}") for c in cols))
    heavier = F.struct("y_forms", "y_n", "y_entity") > F.struct("x_forms", "x_n", "x_entity")
    # two edits are a slip only of a long token that is seen in one form and holds a trigram that tokens hardly have
    odd = F.when(F.col("x_n") <= 2, ODD_RARE * n_tokens).otherwise(ODD * n_tokens)
    sure = (F.col("distance") <= 1) | (
        (F.length("x_token") >= 8) & (F.col("x_forms") == 1) & (F.col("x_n") < F.col("y_n")) & (rarest("x_token") <= F.greatest(F.lit(1), odd))
    )
    fields = ("kind", "rest", "initials", "middle")
    found = ["x_entity", "y_entity", "y_forms", "y_n", "distance"]
    apart = (
        near.join(x, F.col("a") == F.col("x_token"))
        .join(y, F.col("b") == F.col("y_token"))
        .where(heavier & sure & (F.col("x_kind") == F.col("y_kind")))
        .where(agree(*(f"x_{f}" for f in fields), *(f"y_{f}" for f in fields)))
        .select(*found)
    )
    # given names of one surname that a slip sent to different parts
    given = ents.where("kind = 'p' and rest <> ''").select(F.col("rest").alias("token"), F.lit(1).alias("bound"))
    turned = neighbours(given, 3).where(F.substring("a", 1, 1) != F.substring("b", 1, 1))
    middles = (F.col("x_middle") == "") | (F.col("y_middle") == "") | (F.col("x_middle") == F.col("y_middle"))
    together = (
        turned.join(x.where("x_kind = 'p'"), F.col("a") == F.col("x_rest"))
        .join(y.where("y_kind = 'p'"), (F.col("b") == F.col("y_rest")) & (F.col("x_token") == F.col("y_token")))
        .where(heavier & middles)
        .select(*found)
    )
    up = (
        apart.unionByName(together)
        .groupBy("x_entity")
        .agg(F.max_by("y_entity", F.struct(-F.col("distance"), "y_forms", "y_n", "y_entity")).alias("up"))
    )
    tops = followed(written(up.select(F.col("x_entity").alias("entity"), F.col("up").alias("top"))))
    return grouped.join(tops, "entity", "left").select("name", F.coalesce("top", "entity").alias("entity"))


def followed(links: DataFrame) -> DataFrame:
    """links (entity, top), each to a heavier entity, followed to the last one: slips of slips, chains of any length.

    Every round doubles how far a link reaches and is written; the rounds end when no link changes.
    """
    while True:
        on = links.select(F.col("entity").alias("top"), F.col("top").alias("further"))
        longer = links.join(on, "top", "left").select("entity", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved"))
        longer = written(longer)
        if longer.where("moved").isEmpty():
            return links
        links = longer.drop("moved")


def p6_names(spark, sf_dir) -> DataFrame:
    """Rows (name, entity) of every distinct name in original_references.authors."""
    refs = table(spark, sf_dir, "original_references").select("ref_id", "authors").distinct()
    return linked_names(name_list(refs))


def p6_found(spark, sf_dir) -> DataFrame:
    """Rows (name_a, name_b), name_a < name_b, of the different names of one person or organisation."""
    linked = p6_names(spark, sf_dir)
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
