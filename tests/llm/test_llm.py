"""Operators for training data on small inputs, against brute force, round trips and fixed cases."""

import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from foliolens.llm import canonical, encoding, entities, lookalike, names, packing, registry, scans, sentences, splitting, stuffing
from foliolens.llm.trie import Trie, weighted, within

DATA = "/root/testdata/sf0.001"
VOCABULARY = f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"
have_tokenizers = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public tokenizers")


# tries


def test_automaton_finds_what_brute_force_finds():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(200)}
    trie = Trie(words)
    for q in sorted(words)[:80]:
        want = {w: d for w in words if (d := canonical._distance(q, w)) <= 2}
        assert within(trie, q, 2) == want


def test_weighted_automaton_counts_confusions():
    trie = Trie(["modern", "once", "comparatively"])
    found = lambda q: weighted(trie, q, scans.CONFUSIONS, scans.bound_of(q), scans.edit_of(q))
    assert found("rnodern") == {"modern": 1} and found("oricc") == {"once": 2} and found("comparaüveiy") == {"comparatively": 2}
    # misread once more
    assert found("r!odern") == {} and found("or!ce") == {"once": 1}
    # an edit counts where a sign shows that no writer typed the word
    assert found("xnce") == {} and found("x@nce") == {} and found("on@ce") == {"once": 2} and found("mode4rn") == {"modern": 2}


def test_page_words_are_read_by_the_automaton():
    for s in ("Page 12", "Pagc 3", "P@ge l4", "Pa9e 7", "Seife 12", "Scite 9", "oldal 5", "Seite12"):
        assert scans.page_word(s), s
    for s in ("Wage 12", "Stage 2", "Table 3", "Plage 4", "Page", "12"):
        assert not scans.page_word(s), s


def test_shards_lose_no_word_within_the_bound():
    """Every word that a comparison with the whole vocabulary finds within the bound is in a shard of the query."""
    rng = random.Random(8)
    words = {"".join(rng.choice("abcdehilmnortuw") for _ in range(rng.randint(2, 10))) for _ in range(1500)} | {"in", "period", "decline", "survey", "group", "einen", "minority"}
    whole = Trie(sorted(words))
    queries = ["iii", "per!od", "deciine", "s!irvey", "groi!p", "eir!en", "mir!ority"]
    back = {}
    for k, v in scans.CONFUSIONS.items():
        for c in v:
            back.setdefault(c, []).append(k)
    for w in rng.sample(sorted(words), 700):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            k = rng.choice((1, 2))
            w = w[:i] + (rng.choice(back[w[i : i + k]]) if w[i : i + k] in back and rng.random() < 0.8 else rng.choice(["", "x", "!"])) + w[i + k :]
            if not w:
                break
        queries.append(w or "x")
    n = 0
    for q in queries:
        asked = set(scans.shard_keys(q, True))
        for w in weighted(whole, q, scans.CONFUSIONS, scans.bound_of(q), scans.edit_of(q)):
            n += 1
            assert asked & set(scans.shard_keys(w, False)), (q, w)
    assert n > 200


def test_shards_keep_every_pair_within_the_bound():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 11)))
        b = list(a)
        kind = rng.randint(0, 3)
        k = rng.randrange(len(b))
        if kind == 0:
            b[k] = "x"
        elif kind == 1:
            b.insert(k, "x")
        elif kind == 2:
            del b[k]
        elif k + 1 < len(b):
            b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b)
        assert set(names.probes_of(a, 1)) & set(names.keys_of(b)), (a, b)
        c = list(b)
        c[rng.randrange(len(c))] = "y"
        if canonical._distance(a, "".join(c)) <= 2:
            assert set(names.probes_of(a, 2)) & set(names.keys_of("".join(c))), (a, b, c)


def test_few_shards_hold_every_neighbour(spark):
    """The trie join finds what comparing all pairs finds, also two swaps, with few shards a token."""
    for n in range(4, 30):
        token = "".join(chr(97 + k % 26) for k in range(n))
        assert len(names.probes_of(token, 1)) <= 7 and len(names.probes_of(token, 2)) <= 25
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(150)}
    for n in (5, 8, 9, 10, 13):
        word = "kdlmenofpgqhr"[:n]
        once = {x for i in range(n) for x in (word[:i] + word[i + 1 :], word[:i] + "z" + word[i:], word[:i] + "y" + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :])}
        words |= once | {word} | {x[:i] + c + x[j:] for x in once for i in [rng.randrange(len(x) - 1)] for c, j in (("", i + 1), ("z", i), ("y", i + 1), (x[i : i + 2][::-1], i + 2))}
    words = sorted(w for w in words if len(w) >= 3)
    bound = {w: rng.choice((1, 2)) for w in words}
    got = sorted(tuple(r) for r in names.neighbours(spark.createDataFrame(list(bound.items()), "token string, bound int"), 3).collect())
    assert got == sorted((a, b, d) for a in words for b in words if a != b and abs(len(a) - len(b)) <= 2 and (d := canonical._distance(a, b)) <= bound[a])


def test_names_are_read_once(spark):
    """The list of names, which takes a pass over all references, is made once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(f"Ann{k} Borkmund", 1) for k in range(20)], "name string, n long")
    assert names.linked_names(rows.mapInPandas(count, "name string, n long")).count() == 20 and seen.value == 20


def test_links_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(1, 12)] + [("x", "5"), ("y", "z")], "entity string, top string")
    got = {r.entity: r.top for r in names.followed(links).collect()}
    assert got == {**{str(k): "12" for k in range(1, 12)}, "x": "12", "y": "z"}
    assert names.followed(links.where("false")).count() == 0


# 1 entities


REF = "ref_id long, title string, authors string, year string, doi string, journal string, extra string"
REC = "record_id long, title string, authors string, year string, doi string, venue string, h string"


def _works(n):
    rng = random.Random(3)
    pick = lambda s: rng.choice(s.split())
    out = []
    for k in range(n):
        t = f"{pick('Rural Tidal Urban Alpine Postal')} {pick('lighthouses tramways libraries mortgages archives')} and {pick('weaving schooling taxation migration nutrition')} in {pick('Norvale Velmont Kövárd Östmark Falkró')}: a {pick('panel diary scoping')} {pick('study review survey')}"
        out.append((t, f"{pick('Zadimoford Narviier Plimobaey Trilizowick')}{k}, {pick('Anna Oleg Vera')}", str(1960 + k % 60), f"10.1000/w.{k:05d}", "Journal of Things"))
    return out


def test_entities_link_the_same_work_only(spark):
    works = _works(150)
    refs = [(k, t.upper() if k % 3 == 0 else t.replace("and", "&"), a, y, d if k % 2 else None, j, "x") for k, (t, a, y, d, j) in enumerate(works)]
    refs += [(1000, "Comment on: " + works[1][0], works[1][1], works[1][2], None, None, "x"), (1001, works[2][0] + " II", works[2][1], works[2][2], None, None, "x")]
    refs += [(1002, None, None, None, None, None, None), (1003, "", "", "", "", "", ""), refs[0], refs[0]]
    recs = [(k, t, a, y, d, j, "clash") for k, (t, a, y, d, j) in enumerate(works)] + [(5000, None, None, None, None, None, None)]
    got = {(r.ref_id, r.record_id) for r in entities.matches(spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC)).collect()}
    right = {(k, k) for k in range(150)}
    assert len(got & right) >= 147
    assert not [x for x in got if x[0] >= 1000] and len(got - right) <= 2


def test_entities_of_common_authors_without_a_title(spark):
    recs = [(k, t, f"Hotname, {'Anna' if k % 2 else 'Vera'}", y, None, f"Journal {chr(97 + k % 26)}{k // 26}", "") for k, (t, _, y, _, _) in enumerate(_works(120))]
    refs = [(k, None, recs[k][2], recs[k][3], "10.1000/wrong" if k % 2 else None, recs[k][5], "") for k in range(0, 120, 5)]
    got = {(r.ref_id, r.record_id) for r in entities.matches(spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC)).collect()}
    assert got == {(k, k) for k in range(0, 120, 5)}


def test_entities_of_common_authors_meet_without_a_year():
    import pyarrow as pa

    common = frozenset({"hotname", "anna", "vera"})

    def keys(titles, authors, years, probes):
        n = len(titles)
        cols = {c: list(range(n)) for c in "nhg"} | {"title": titles, "authors": [authors] * n, "year": years, "doi": [None] * n, "venue": [None] * n}
        schema = pa.schema([*((c, pa.int64()) for c in "nhg"), *((c, pa.string()) for c in list(cols)[3:])])
        return entities.describe(pa.RecordBatch.from_pydict(cols, schema), common, probes).column(11).to_pylist()

    titles = [t for t, *_ in _works(150)]
    slips = [t.replace("study", "stuudy").replace("review", "revview").replace("survey", "survvey") for t in titles]
    for authors in ("Hotname, Anna", "Xuvwy, Q.; Hotname, Vera"):
        # without a year, and with one that is a year off
        for years in ([None] * 150, ["1961"] * 150):
            a, b = keys(slips, authors, years, True), keys(titles, authors.replace("Xuvwy", "Zypqo"), ["1960"] * 150, False)
            assert sum(bool(set(x) & set(y)) for x, y in zip(a, b, strict=True)) >= 147


def test_entities_count_null_as_blank(spark):
    """Rows that differ in null and blank are one class, and every link comes once."""
    t, a, y, *_ = _works(1)[0]
    refs = [(k, t, a, y, d, j, "") for k, (d, j) in enumerate([(None, ""), ("", None), ("", ""), (None, None)])]
    recs = [(k, t, a, y, d, j, "") for k, (d, j) in enumerate([(None, ""), ("", None)])]
    # other works, so that there is something to learn from
    refs += [(10 + k, *w, "") for k, w in enumerate(_works(60)[1:])]
    recs += [(10 + k, *w, "") for k, w in enumerate(_works(60)[1:])]
    got = [(r.ref_id, r.record_id) for r in entities.matches(spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC)).collect()]
    assert len(got) == len(set(got))
    assert {x for x in got if x[0] < 10} == {(k, n) for k in range(4) for n in range(2)}


def test_only_ids_of_several_classes_are_compared(spark):
    """Pairs grow with the square of a work's copies, so p1_found must not sort them all out again; each comes once all the same."""
    works = _works(60)
    refs = [(100 * c + k, *w, "") for k, w in enumerate(works) for c in range(3)]
    recs = [(100 * c + k, *w, "") for k, w in enumerate(works) for c in range(2)]
    # ids that stand in two classes
    refs += [(7, *works[7][:4], None, ""), (8, *works[8][:4], None, "")]
    recs += [(7, *works[7][:4], None, ""), (109, *works[9][:4], None, "")]
    refs, recs = spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC)
    every = [(r.ref_id, r.record_id) for r in entities.matches(refs, recs).collect()]
    found = entities.matched(refs, recs)
    got = [(r.ref_id, r.record_id) for r in found.collect()]
    assert len(every) > len(set(every)) and len(got) == len(set(got)) and set(got) == set(every)
    assert {(7, 7), (107, 7), (8, 108), (9, 109)} <= set(got)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and plan.children().apply(0).nodeName() == "Project"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entities_lose_nothing_by_blocking(spark, monkeypatch):
    """Of the links that a comparison of all pairs finds, blocking finds at least 0.995."""
    from pyspark.sql import functions as F

    from foliolens.session import table

    refs = table(spark, DATA, "original_references").select("ref_id", "title", "authors", "year", "doi", "journal")
    recs = table(spark, DATA, "catalog_records").select("record_id", "title", "authors", "year", "doi", "venue")
    found = {(r.ref_id, r.record_id) for r in entities.matches(refs, recs).collect()}
    monkeypatch.setattr(entities, "candidate_pairs", lambda x, y: x.select(F.col("n").alias("x_n")).crossJoin(y.select(F.col("n").alias("y_n"))))
    every = {(r.ref_id, r.record_id) for r in entities.matches(refs, recs).collect()}
    assert len(found & every) >= 0.995 * len(every) and len(every) > 300


def test_entities_know_short_names():
    assert entities.author_names("Li, W.; Kim Ho; et al.; Brown, Anna") == [["li"], ["kim", "ho"], [], ["brown", "anna"]]


def test_entities_of_empty_tables(spark):
    none = entities.matches(spark.createDataFrame([], REF), spark.createDataFrame([], REC))
    assert none.count() == 0


def test_title_marks():
    assert entities.title_of("Corrigendum to: A title") == ("a title", "corr")
    assert entities.title_of("Coment on: A title")[1] == "comm"
    assert entities.title_of("A longer title II") == ("a longer title", "ii")
    assert entities.title_of("Wages, 1890–1894") == ("wages 1890 1894", "")
    assert entities.title_of("Ｗａｇｅｓ in Κöｖárd…") == ("wages in kovard ~", "")


def test_logistic_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    y = (rng.random(4000) < p).astype(float)
    got = entities.Logistic(x, y).probability(x)
    assert abs(got.mean() - y.mean()) < 0.03 and np.abs(got - p).mean() < 0.05


# 2 canonical values


def _entries(spark, *rows):
    return spark.createDataFrame(list(rows), "entry int, name string, abbrev string")


def test_values_map_to_entries(spark):
    e = _entries(spark, (1, "Tidal Borrowing Quarterly", "Tida. Borr. Quar."), (2, "Zeitschrift für Gemeindewesen", None), (3, "Annals of Rural Indebtedness", None), (4, "Annals of Rural Inheritance", None), (5, None, None))
    cases = {
        "tidal borrowing quarterly": 1, "Tid. Borr. Quart.": 1, "In: *Tidal Borrowing Quarterly*, 12(3)": 1, "Tidl Borrowing Qaurterly vol. 3, pp. 4–9": 1, "Tidal Borrowing…": 1,
        "Zeitschrift fur Gemeindewesen": 2, "Ztschrift für Gemeindewesen": 2, "Zeit. Geme.": 2, "Annals of Rural Indebtedness": 3, "Annals iof Rural Inheritance": 4,
        "Annals of Rural Mortgages": 0, "unknown": 0, "…": 0,
    }
    v = spark.createDataFrame([(k, "x") for k in cases] + [(None, "x"), ("  ", "x"), ("unknown", "x")], "j string, key string")
    got = {r.value: r.entry for r in canonical.mapped(v, "j", e).collect()}
    assert got == cases


def test_initials_of_one_entry_only_name_it(spark):
    names = ["International Journal of Volatile Vaccination and Remittances", "Archives of Tidal Wages", "Annals of Temporary Weaving", "Area"]
    e = spark.createDataFrame([(k, n, None) for k, n in enumerate(names, 1)], "entry int, name string, abbrev string")
    v = spark.createDataFrame([("IJVVR",), ("I.J.V.V.R.",), ("I. J. V. V. R.",), ("IJOVVAR",), ("ATW",), ("AREA",), ("N/A",), ("ijvvr",), ("UNKNOWN",)], "j string")
    got = {r.value: r.entry for r in canonical.mapped(v, "j", e).collect()}
    assert got == {"IJVVR": 1, "I.J.V.V.R.": 1, "I. J. V. V. R.": 1, "IJOVVAR": 1, "ATW": 0, "AREA": 4, "N/A": 0, "ijvvr": 0, "UNKNOWN": 0}


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 7)))
    keys = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)})
    v = spark.createDataFrame([(k,) for k in keys], "key string")
    e = spark.createDataFrame([(str(i), k) for i, k in enumerate(keys[:40])], "rid string, key string")
    got = {(r.key, r.rid): round(r.similarity, 9) for r in canonical.similarity_join(v, e, 0.3).collect()}
    want = {}
    for k in keys:
        for i, x in enumerate(keys[:40]):
            a, b = set(canonical.grams(k)), set(canonical.grams(x))
            if len(a & b) >= 0.3 * len(a | b):
                want[k, str(i)] = round(len(a & b) / len(a | b), 9)
    assert got == want


# 3 sentences


SENTENCES = [
    ("Dr. Wystrom disagrees. J. R. Moe agrees, i.e. not.", ["Dr. Wystrom disagrees.", "J. R. Moe agrees, i.e. not."]),
    ('Reviewers asked "Why so few? And why now?" before the vote. "It is so." The end.', ['Reviewers asked "Why so few? And why now?" before the vote.', '"It is so."', "The end."]),
    ("It ended. (A wave followed.) The survey (see Fig. 2) ends.", ["It ended.", "(A wave followed.)", "The survey (see Fig. 2) ends."]),
    ("Am 9. Mai 1968 begann die 5. Welle. Es gilt z. B. Folgendes.", ["Am 9. Mai 1968 begann die 5. Welle.", "Es gilt z. B. Folgendes."]),
    ("調査は増えた（「見えない。」とも）。驚くべき！次。", ["調査は増えた（「見えない。」とも）。", "驚くべき！", "次。"]),
    ("审稿人问：“为什么？为什么现在？”然后投票。“低估了！”编辑说。", ["审稿人问：“为什么？为什么现在？”然后投票。", "“低估了！”编辑说。"]),
    ("ในปี 2533 การสำรวจ ไม่ได้", ["ในปี 2533 การสำรวจ", "ไม่ได้"]),
    ("यह सही है। डॉ. क. वेराल लिखते हैं॥ ठीक।", ["यह सही है।", "डॉ. क. वेराल लिखते हैं॥", "ठीक।"]),
    ("سألت «لماذا؟ ولماذا؟» قبل. قال د. كلفري نعم.", ["سألت «لماذا؟ ولماذا؟» قبل.", "قال د. كلفري نعم."]),
    ("Γιατί τώρα; Γιατί εδώ; Ο κ. Βερράλης ήρθε.", ["Γιατί τώρα;", "Γιατί εδώ;", "Ο κ. Βερράλης ήρθε."]),
    ("# Head one.\nText one. Text\ntwo.\n\n| a. b | c |\n![f](x.png)\nFigure 3. A caption. More\n\n$$ a. b $$", ["# Head one.", "Text one.", "Text\ntwo.", "| a. b | c |", "![f](x.png)", "Figure 3. A caption. More", "$$ a. b $$"]),
    ("   \n\n", []),
]


@pytest.mark.parametrize(("text", "want"), SENTENCES)
def test_sentences(text, want):
    units = sentences.Splitter(sentences.evidence(text), {}).units(text)
    assert [text[s:e] for s, e in units] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n()\"“”…。AB1#|", max_size=80))
def test_units_cover_every_character_once(text):
    units = sentences.Splitter(sentences.evidence(text), {}).units(text)
    assert all(a < b for a, b in units) and all(x[1] <= y[0] for x, y in zip(units, units[1:]))
    assert "".join(text[a:b] for a, b in units).split() and "".join("".join(text[a:b] for a, b in units).split()) == "".join(text.split()) or not text.strip()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBe .!?\"()。,1's", max_size=60))
def test_ambiguous_tokens_are_all_the_split_needs(text):
    every = sentences.evidence(text)
    some = {t: every[t] for t in sentences.ambiguous(text) if t in every}
    assert sentences.Splitter(some, {}).units(text) == sentences.Splitter(every, {}).units(text)


def test_sentence_units_take_the_corpus(spark):
    rows = [(1, "He met Mme. Blanc there.", "x"), (2, "We saw mme. cases and mme. 3 and mme. x.", "x"), (3, None, "x"), (4, "", "x"), (5, " \n ", "x"), (6, "word " * 30000 + "end.", "x")]
    d = spark.createDataFrame(rows, "k long, t string, token string")
    got = sentences.sentence_units(d, "k", "t", sentences.readings(d, "k", "t")).groupBy("k").count().collect()
    assert {r.k for r in got} == {1, 2, 6}
    empty = d.where("false")
    assert sentences.sentence_units(empty, "k", "t", sentences.readings(empty, "k", "t")).count() == 0


def handed_on(monkeypatch, make, batch):
    """The sizes of what the function that `make` maps over a table hands on for one batch."""
    mapped = []
    for how in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(f"pyspark.sql.classic.dataframe.DataFrame.{how}", lambda df, f, schema, real=getattr(DataFrame, how): mapped.append(f) or real(df, f, schema))
    make()
    return [len(x) for x in mapped[-1](iter([batch]))]


def test_a_batch_of_many_documents_is_split_in_parts(spark, monkeypatch):
    """A worker's memory must not follow the number of documents in a batch, which is up to ten thousand."""
    n, text = 3000, "He met Mme. Blanc there. We saw 3 cases, e.g. of No. 7."
    d = spark.createDataFrame([(1, text)], "k long, t string")
    sizes = handed_on(monkeypatch, lambda: sentences.readings(d, "k", "t"), pd.DataFrame({"k": range(n), "t": text, "wanted": True}))
    assert sum(sizes) > sentences.ROWS and max(sizes) < 1.1 * sentences.ROWS
    own = [{"token": "Mme", "own": [1] * 8, "all": [2] * 8}]
    stats = pa.array([own, None] * (n // 2), pa.list_(pa.struct([("token", pa.string()), ("own", pa.list_(pa.int32())), ("all", pa.list_(pa.int64()))])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n), stats], names=["k", "t", "stats"])
    read = sentences.readings(d, "k", "t")
    sizes = handed_on(monkeypatch, lambda: sentences.sentence_units(d, "k", "t", read), batch)
    assert sum(sizes) == 2 * n and max(sizes) == 2 * sentences.DOCS


# 4 scans


PAGE = """Rural wages in Norvale: a panel study

1 Results

The arcbive confirms unpaid house-
hold labour over a self-
employed minority. The treafment
    – 12 –
RURAL WAGES IN NORVALE
14    Takler

group ends here.
Norvale   12.3   4
"""


def test_pages_are_repaired(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "row_id long, text string")
    clean = spark.createDataFrame([(9, "The archive confirms unpaid household labour over a self-employed minority. The treatment group ends here. Rural wages in Norvale: a panel study Results")], "row_id long, text string")
    got = {(r.line_no, r.kind, r.word) for r in scans.repaired_pages(pages, clean).collect()}
    assert got == {(5, "misread", "archive"), (5, "hyphen", "household"), (6, "hyphen", "self-employed"), (7, "misread", "treatment"), (8, "running", ""), (9, "running", ""), (10, "running", "")}
    notes = [{"line_no": a, "kind": b, "word": c} for a, b, c in got]
    assert "The archive confirms unpaid household labour over a self-employed minority. The treatment group ends here." in " ".join(scans.reflowed(PAGE, notes).split())
    none = spark.createDataFrame([], "row_id long, text string")
    assert scans.repaired_pages(none, none).count() == 0


def test_a_batch_of_many_pages_is_read_in_parts(spark, monkeypatch):
    n = 3000
    d = spark.createDataFrame([(1, PAGE)], "row_id long, text string")
    sizes = handed_on(monkeypatch, lambda: scans.page_words(d), pd.DataFrame({"row_id": range(n), "text": PAGE}))
    assert sum(sizes) > 3 * scans.ROWS and max(sizes) < 1.1 * scans.ROWS
    # pairs are summed over batches and handed on before they are many
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{i}x" for k in range(100)) for i in range(n)]
    sizes = handed_on(monkeypatch, lambda: scans.word_pairs(d), pd.DataFrame({"text": texts}))
    assert sum(sizes) == 100 * n and max(sizes) < 6 * scans.ROWS
    # the queries of one shard, each with many words in reach, don't wait for one another
    words = [f"mode{a}{b}n" for a in "bcdfghjk" for b in "bcdfghjk"]
    asked = [f"mode{a}!n" for a in "bcdfghjk"] * 400
    batch = pd.DataFrame({"key": "Sn", "is_query": [False] * len(words) + [True] * len(asked), "x": words + asked})
    sizes = handed_on(monkeypatch, lambda: scans.nearest_words(d.selectExpr("text q"), d.selectExpr("text w")), batch)
    assert sum(sizes) > scans.ROWS and max(sizes) < 1.1 * scans.ROWS


def test_references_are_repaired():
    raw = "[3] Alpha, B.: \"Te decline of rural ar-\nConclusion 232\nchives in Norvale, a fie1d trial,\" *Annals of\nMunicipal Wages*, 2001."
    found, text = scans.repair_reference(raw, ["Te decline of rural archives in Norvale, a field trial", "Alpha, B.", "Annals of Municipal Wages", "2001", None])
    assert set(found) == {(1, "hyphen", "archives"), (2, "running", ""), (3, "misread", "field")}
    assert "rural archives in Norvale, a field trial" in text
    assert scans.repair_reference("", [None] * 5) == ([], "")


# 5 splitting


def test_pieces_are_bounded_and_overlap(spark):
    text = "# H\n\n" + "\n\n".join(" ".join(f"w{p}x{i}" for i in range(70)) + "." for p in range(12))
    chunks = spark.createDataFrame([(1, "c1", 1, 3, "x"), (1, "c1", 1, 3, "x"), (1, "c2", None, 3, "x"), (2, "c1", 1, 9, "x"), (3, "c1", 99, 100, "x")], "paper_id long, chunk_id string, start_line int, end_line int, text string")
    texts = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "short")], "paper_id long, extracted_text string")
    got = splitting.pieces(splitting.chunk_texts(chunks, texts)).orderBy("piece").collect()
    words = text.split()
    assert all(r.n_words <= 250 for r in got) and got[0].start_line == 1
    back = got[0].text.split()
    for a, b in zip(got, got[1:]):
        assert a.text.split()[-30:] == b.text.split()[:30]
        back += b.text.split()[30:]
    assert back == words
    assert all(r.text.endswith(".") for r in got)


@pytest.mark.parametrize(
    ("text", "least"),
    [("x" * 10_438, 2), ("灯台の歴史と地方の暮らし。" * 400, 5), ("灯" * 6005, 6), ("word " * 600, 3)],
)
def test_texts_without_boundaries_are_cut(spark, text, least):
    """No piece holds more than 250 runs of characters, and without the overlap the pieces are the text."""
    chunks = spark.createDataFrame([(1, "c1", 1)], "paper_id long, chunk_id string, start_line int")
    texts = spark.createDataFrame([(1, text)], "paper_id long, extracted_text string")
    got = splitting.pieces(splitting.chunk_texts(chunks, texts)).orderBy("piece").collect()
    assert len(got) >= least and all(r.n_words <= 250 for r in got)
    runs = [r.text.split(" ") for r in got]
    back = runs[0] + [w for a, b in zip(runs, runs[1:]) for w in b[30:]]
    assert all(a[-30:] == b[:30] for a, b in zip(runs, runs[1:]))
    assert "".join(back) == "".join(text.split())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pieces_of_the_tables_keep_every_word(spark):
    """On all of sf0.001: limit, order, overlap and lines of the pieces, and most cuts at an end of sentence or stronger."""
    from pyspark.sql import functions as F

    from foliolens.session import table

    sections = splitting.chunk_texts(table(spark, DATA, "chunk_map"), table(spark, DATA, "original_converted"))
    bodies = {(r.paper_id, r.chunk_id, r.start_line): [w.w for w in r.words] for r in sections.where(F.size("words") > 250).collect()}
    held = {}
    for r in splitting.pieces(sections).collect():
        held.setdefault((r.paper_id, r.chunk_id), []).append(r)
    ends = 0
    for (paper, chunk), ps in held.items():
        ps.sort(key=lambda r: r.piece)
        assert [r.piece for r in ps] == list(range(1, len(ps) + 1)) and all(r.n_words <= 250 and r.start_line <= r.end_line for r in ps)
        words = [r.text.split(" ") for r in ps]
        assert all(a[-30:] == b[:30] for a, b in zip(words, words[1:]))
        assert words[0] + [w for b in words[1:] for w in b[30:]] in [v for k, v in bodies.items() if k[:2] == (paper, chunk)]
        ends += sum(r.text.rstrip("\"'”’»)]*_").endswith((".", "!", "?", "。", "…", "।", "؟")) for r in ps[:-1])
    assert {k[:2] for k in bodies} == set(held) and ends >= 0.6 * sum(len(ps) - 1 for ps in held.values())


# 6 names


def test_name_variants_are_linked(spark):
    groups = [
        ["Plodjiholm, Barbara", "Barbara Plodjiholm", "PLODJIHOLM B.", "Plodjiholm, B.", "Babs Plodjiholm", "Barbara Pldojiholm", "barbara plodjiholm"],
        ["Plodjiholm, Eugene C.", "Eugene C. Plodjiholm", "Plodjiholm EC", "Plodjiholm, C. Eugene"],
        ["Jean-Luc Trilizowick", "Trilizowick, J.-L.", "JeanLuc Trilizowick", "Trilizowick J-L"],
        ["Norby Institute for Labour and Housing Policy", "Norby Institute for Housing & Labour Policy", "Institute for Labour and Housing Policy, Norby", "Norby Institute for Labour and Housing Policy (NILHP)"],
    ]
    fill = [f"{g} {s}son" for g in ("Barbara", "Eugene", "Jean-Luc", "Oleg") for s in "Abeling Borkmund Carte Dormicks Eldrit Fiskarup Gilb Haldorss Ivaro Jutten".split()]
    cities = [f"{c}ville Institute for {a} and {b} Policy" for c in "Ab Bo Ca Da Ed Fa Go Ha Id Ja".split() for a, b in (("Labour", "Housing"),)]
    rows = [(n, 3) for g in groups for n in g] + [(n, 1) for n in fill + cities] + [("?!", 1)]
    got = {r.name: r.entity for r in names.linked_names(spark.createDataFrame(rows, "name string, n long")).collect()}
    for g in groups:
        assert len({got[n] for n in g}) == 1, (g, [got[n] for n in g])
    assert len({got[g[0]] for g in groups}) == len(groups) and len({got[n] for n in fill}) == len(fill)
    assert "?!" not in got


def test_a_hot_surname_is_grouped_in_parts(spark):
    """Slips in a given name's first letter are linked across the parts; other people of the surname are not."""
    fill = [f"{g} {s}son" for g in ("Barbara", "Oleg", "Eugene") for s in "Abeling Borkmund Carte Dormicks Eldrit Fiskarup Gilb Haldorss Ivaro Jutten".split()]
    rows = [(n, 3) for n in ("Barbara Hotname", "Hotname, Barbara", "Hotname, B.", "Babs Hotname", "Oleg Hotname", "Hotname O.", "Eugene Hotname")]
    rows += [("Varbara Hotname", 1), ("Hotname, Qleg", 1)] + [(n, 1) for n in fill]
    got = {r.name: r.entity for r in names.linked_names(spark.createDataFrame(rows, "name string, n long")).collect()}
    assert len({got[n] for n in ("Barbara Hotname", "Hotname, Barbara", "Hotname, B.", "Babs Hotname", "Varbara Hotname")}) == 1
    assert len({got[n] for n in ("Oleg Hotname", "Hotname O.", "Hotname, Qleg")}) == 1
    assert len({got[n] for n in ("Barbara Hotname", "Oleg Hotname", "Eugene Hotname")}) == 3


def test_name_lists(spark):
    rows = [(1, '["A B", "C; D"]'), (2, "A B; E F ;et al.;;"), (3, None), (4, " "), (5, "[broken"), (6, "[]")]
    got = {r.name: r.n for r in names.name_list(spark.createDataFrame(rows, "id long, authors string")).collect()}
    assert got == {"A B": 2, "C; D": 1, "E F": 1}
    assert names.linked_names(spark.createDataFrame([], "name string, n long")).count() == 0


# 7 look-alikes


def test_looks(spark):
    rows = [("Wages in Norvale", t, k) for k, t in enumerate(["Wаges in Νorvale", "Ｗａｇｅｓ　in Norvale", "Wa​ges in Nor­vale", "wages in Norvale", "Wages in Norvále", "Wages in Norvale", "", None, "Wages in Norvalе﻿"])]
    df = spark.createDataFrame(rows, "a string, b string, same int")
    model = lookalike.LookalikeModel(lookalike.bigram_counts(df, "a"))
    got = {r["same"] for r in lookalike.same_looks(df, "a", "b", model).collect()}
    assert got == {0, 1, 2, 8}
    assert model.form("Сëstrа ﬁne ​") == "Cëstra fine"
    assert model.form("Wages") == model.form("Wаgеѕ") == "Wages"
    assert model.form("Dr\u0435\u0301lune") == "Dr\u00e9lune"
    assert [r.form for r in lookalike.one_form(spark.createDataFrame([(None,), ("",)], "t string"), "t", model).collect()] == [None, ""]


def test_the_search_decides_between_near_letters(spark):
    """Texts of one rough skeleton are one only if the best readings are: the letters beside them decide."""
    words = "International Irish Ill lull full all London Oslo Order until 1890 2010 1001 Ireland Iceland ability " * 20
    model = lookalike.LookalikeModel(lookalike.bigram_counts(spark.createDataFrame([(words,)], "t string"), "t"))
    rows = [("International Order", "lnternational 0rder", 0), ("all Oslo", "aIl 0slo", 1), ("Ill", "lll", 2), ("1001", "lOOl", 3), ("Irish", "1rish", 4)]
    df = spark.createDataFrame(rows, "a string, b string, same int")
    assert all(lookalike.rough(a) == lookalike.rough(b) for a, b, _ in rows)
    got = {r["same"] for r in lookalike.same_looks(df, "a", "b", model).collect()}
    assert {0, 1, 4} <= got and 2 not in got
    assert model.form("lnternational 0rder") == "International Order"


# 8 encoding


@have_tokenizers
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    enc = encoding.BytePairEncoder(VOCABULARY)
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice((32, 97, 101, 115, 233, 0x4E2D, 0x1F600, 10, 48))) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["<|endoftext|> x", "swears Vadréna Reported ��", "a" * 5000, " \n\n  x", "it's we'll", "‍﻿"]
    for t in texts:
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids, repr(t)
    got = encoding.encoded(spark.createDataFrame([(None,), ("",), ("hello",)], "t string"), "t").collect()
    assert [r.ids for r in got] == [[], [], enc.encode("hello")]


@have_tokenizers
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoding_round_trip(text):
    enc = encoding.encoder(VOCABULARY)
    back = "".join(enc.text[i] for i in enc.encode(text)).encode("latin-1")
    assert back == text.encode("utf-8", "surrogatepass") if not any(0xD800 <= ord(c) < 0xE000 for c in text) else True


# 9 packing


def test_packing(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 2048, 5000, *range(1, 600)])) for k in range(3000)] + [(3000, None)]
    df = spark.createDataFrame(rows, "id long, size int")
    got = packing.packed(df, "id", "size", len(rows)).collect()
    fill: dict = {}
    for r in got:
        if r.container is None:
            assert r["size"] == 0
        else:
            fill[r.container] = fill.get(r.container, 0) + r["size"]
    total = sum(s or 0 for _, s in rows)
    assert max(fill.values()) <= packing.CAPACITY and sum(fill.values()) == total
    assert len(fill) <= 1.01 * total / packing.CAPACITY + 1
    pieces: dict = {}
    for r in got:
        pieces[r.item] = pieces.get(r.item, 0) + 1
    assert all(pieces[k] == max(1, -(-(s or 0) // packing.CAPACITY)) for k, s in rows)
    assert packing.packed(df.where("false"), "id", "size", 0).count() == 0


# 10 stuffing


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("best casino bonus\n" * 20, True),
        ("bump\n" + ", ".join(f"{a} running shoes {b}" for a in ("cheap", "buy", "best", "top") for b in ("online", "price", "sale")), True),
        ("\n".join(f"https://x{i}.test/a" for i in range(8)), True),
        ("Nice thread!\n<div style='display:none'>" + "roof repair price roof repair review cheap roof repair " * 5 + "</div>", True),
        ("g a r d e n   s h e d s   p r i c e\n" * 8, True),
        ("Cheap tea! Tea for sale! Buy tea online! Tea coupon! Is tea safe! Best tea shop! Tea price!", True),
        ("My fork cracked. " + "buy " + "roof repair discount, wholesale roof repair, roof repair online, " * 4, True),
        ("shoes best shoes buy shoes shoes price best shoes buy buy shoes price shoes shoes best shoes.", True),
        ("\n".join(f"SKU 4{i}317 Running shoes M {i}2.90 EUR -> sale" for i in range(1, 8)), True),
        ("hide / willow / quarry / lantern / bolt", True),
        ("saddle\nmeadow\nkettle\nhub\nrim", True),
        (">> best trail lamps price * buy trail lamps online * trail lamps sale * cheap trail lamps", True),
        ("Re: " + " ".join(f"https://x{i}.test/a" for i in range(8)), True),
        (">> Lamps near us? Lamps for sale? Cheap lamps? Buy lamps online? Lamps review? Lamps price?\n[15e86]", True),
        ("the best price of phone covers. " * 9, True),
        ("#cheap #shoes #cheap #shoes #shoes #sale #cheap #sale #shoes #sale #cheap shoes #cheap", True),
        ("> cheap lamps, best lamps, buy lamps, lamps sale, lamps price\nlol", False),
        ("WTB: oak panel, marking gauge, jack plane, hide glue", False),
        ("For sale: jack plane, 25.00 EUR, hide glue, 4.00 EUR, pickup only", False),
        ("Nobody here sells the valve!\n\nI never trusted the valve. Not sure the valve is the problem here, honestly.", False),
        ("I tried the filter last weekend. It rattles. My brother swears by the old one.\n\nSources: http://a.test/b, http://c.test/d, http://e.test/f, http://g.test/h", False),
        ("Reported this one, please remove it.\n> " + "roof repair price " * 20, False),
        ("\n".join(f"- {i}x tomato bed, {i * 7} mm" for i in range(1, 12)), False),
        ("\n".join(f"12:0{i}:11 INFO kettle={i * 311}" for i in range(9)), False),
        ("The fork cracked, and that is why I keep asking about the fork. " * 6, False),
        ("\n".join(f"cold frame: {i} votes" for i in range(3, 12)), False),
        ("haha haha haha haha haha haha haha haha haha", False),
        ("", False),
        (None, False),
    ],
)
def test_stuffing(text, want):
    assert stuffing.stuffed(stuffing.measures(text)) is want


def test_possible_loses_nothing(monkeypatch):
    """The quick test for pages that cannot be flagged changes no verdict."""
    import random

    rng = random.Random(5)
    words = ["roof", "repair", "buy", "the", "fork", "is", "good", "cheap", "x1y", "屋顶维修", "3.90 EUR", "54321", "https://a.test"]
    texts = [rng.choice([" ", ", ", ". ", "\n", " / "]).join(rng.choices(words[: rng.randint(1, len(words))], k=rng.randint(0, 40))) for _ in range(3000)]
    quick = [stuffing.stuffed(stuffing.measures(t)) for t in texts]
    monkeypatch.setattr(stuffing, "possible", lambda body: True)
    assert quick == [stuffing.stuffed(stuffing.measures(t)) for t in texts]
    assert any(quick) and not all(quick)


def test_stuffed_pages(spark):
    d = spark.createDataFrame([(1, "cheap shoes price\n" * 9, "x"), (2, None, "x"), (3, "word " * 40000, "x")], "doc_id long, text string, k string")
    got = {r.doc_id: r.stuffed for r in stuffing.stuffed_pages(d, "doc_id", "text").collect()}
    assert got == {1: True, 2: False, 3: False}
    assert stuffing.page_shapes(d.where("false"), "doc_id", "text").count() == 0


# all queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
    if name in registry.oracle_sql():
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
        r = c.execute(registry.oracle_sql()[name])
        cols = [x[0] for x in r.description]
        assert {tuple(x[k] for k in df.columns) for x in rows} == {tuple(x[cols.index(k)] for k in df.columns) for x in r.fetchall()}
