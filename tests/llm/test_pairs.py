"""Defects of prompt and response pairs on hand-made entries, and clusters of openings."""

import random

import pytest

from folioscope.llm import langid, openings, pairs
from folioscope.llm.openings import clusters

from .test_langid import sentence

NO = ["Sinto muito, mas não consigo processar este conteúdo agora.", "I am sorry, but I cannot help with that kind of text."]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return langid.fitted([(lang, " ".join(sentence(rnd, lang) for _ in range(3))) for lang in ("en", "pt", "de") for _ in range(40)])


def test_defects(spark, model):
    rnd = random.Random(7)
    s = lambda lang, n=2: " ".join(sentence(rnd, lang) for _ in range(n))
    rows, want = [], {}

    def add(original, translated, defect=None):
        k = len(rows)
        rows.append((k, "pt", original, translated, "clash"))
        if defect:
            want[k] = defect

    for _ in range(12):
        add(s("en"), s("pt"))
    for no in NO:
        for _ in range(4):
            add(s("en"), no + rnd.choice(("", " Algo mais?", "\n\n(12)")), "refusal")
    for empty in (None, "", "  ", "​", "...", '""', "```\n```", "[1]", "N/A"):
        add(s("en"), empty, "empty")
    x = s("en", 3)
    for copy in (x, x.upper(), x.replace(" ", "  "), x.replace("e", "е"), x.replace(" ", "\n", 3), f"“{x}”", f"[1] {x}", f"Translation: {x}"):
        add(x, copy, "copied")
    add(s("en"), s("de"), "wrong_language")
    add(s("de"), s("en"), "wrong_language")
    for mark in ("…", "", " -", ","):
        t = s("pt", 3)
        add(s("en", 3), t[: len(t) // 2].rstrip(" .") + mark, "truncated")
    quoted = "“I am sorry, but I cannot help with that kind of text,” wrote the quiet reader. " + s("en", 1)
    add(quoted, "“Sinto muito, mas não posso ajudar com este tipo de texto”, escreveu um leitor quieto porque estava chovendo. " + s("pt", 1))
    for same in ("TASVI-452", "Quenga Wexlotos", "96,86 kg", "1842"):
        add(same, same)
    add(None, None)
    rows.append((0, *rows[0][1:]))
    df = spark.createDataFrame(rows, "entry_id long, target_lang string, original string, translated string, defect string")
    got = {r["entry_id"]: r["defect"] for r in pairs.found(df, model).collect()}
    assert got == want
    assert pairs.judged(df.limit(0), model).count() == 0


def test_clusters_of_openings(spark):
    base = " ".join(f"w{k}" for k in range(30))
    near = base.replace("w29", "other")
    xs = [base, near, "w1 w2", " ".join(f"v{k}" for k in range(30)), ""]
    got = {r["words"]: r["leader"] for r in clusters(spark.createDataFrame([(x,) for x in xs], "words string")).collect()}
    assert got[base] == got[near] and len(set(got.values())) == 4 and set(got) == set(xs)


def test_short_refusals_are_found_and_short_openings_are_none(spark, model):
    rnd = random.Random(9)
    s = lambda lang: " ".join(sentence(rnd, lang) for _ in range(2))
    rows = [(k, "pt", s("en"), "Não posso.") for k in range(30)] + [(k, "pt", s("en"), f"Sim. Livro{k} casa{k} porta{k} rio{k} " + s("pt")) for k in range(30, 60)]
    rows += [(k, "pt", "Chapter three of the old quiet book was here.", "Capítulo três.") for k in range(60, 90)]
    df = spark.createDataFrame(rows, "entry_id long, target_lang string, original string, translated string")
    got = {r["entry_id"]: r["defect"] for r in pairs.found(df, model).collect()}
    assert {k for k, d in got.items() if d == "refusal"} == set(range(30))


def test_a_refusal_of_one_prompt_asked_often_still_counts(spark):
    a = "i am sorry but i cannot help with that"
    rows = [("the same prompt was asked again and again", a)] * 50 + [(f"other prompt {k} about thing {k} of {k} kinds", a) for k in range(4)]
    got = pairs.templates(spark.createDataFrame(rows, "q string, a string")).collect()
    assert [r["words"] for r in got] == [a]


def test_rounds_grow_slowly_with_dissimilar_texts_of_one_beginning(spark, monkeypatch):
    calls = []
    cut = openings.checkpointed
    monkeypatch.setattr(openings, "checkpointed", lambda df: calls.append(1) or cut(df))
    xs = [" ".join([f"c{i}" for i in range(20)] + [f"o{j}x{i}" for i in range(6)]) for j in range(600)]
    got = clusters(spark.createDataFrame([(x,) for x in xs], "words string"))
    assert got.select("leader").distinct().count() == 600
    assert (len(calls) - 2) / 2 <= 6


def test_clusters_against_all_pairs(spark):
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(4000)}" for _ in range(26)] for _ in range(60)]
    xs = {" ".join(ws) for ws in base}
    for ws in base:
        for _ in range(rnd.randrange(6)):
            v = list(ws)
            v[rnd.choice((0, -1))] = f"v{rnd.randrange(4000)}"
            xs.add(" ".join(v))
    grams = {x: {tuple(x.split()[k : k + 5]) for k in range(22)} for x in xs}
    near = [(a, b) for a in xs for b in xs if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    led = {r["words"]: r["leader"] for r in clusters(spark.createDataFrame([(x,) for x in sorted(xs)], "words string")).collect()}
    assert near and sum(led[a] == led[b] for a, b in near) >= 0.95 * len(near)


def test_sentences_that_chance_repeats_are_no_templates(spark, monkeypatch):
    monkeypatch.setattr(pairs, "RARE", 1 / 60, raising=False)
    no = "i am sorry but i cannot help with that"
    # Few sentences, each of which stands under a handful of unrelated prompts, and one that stands under many.
    rows = [(f"prompt {k} about thing {k} of {k} kinds", f"sentence {k % 60} of a small stock is number {k % 60}") for k in range(300)]
    rows += [(f"other {k} about matter {k} of {k} sorts", no) for k in range(30)]
    got = pairs.templates(spark.createDataFrame(rows, "q string, a string")).collect()
    assert [r["words"] for r in got] == [no]


def test_first_words_of_like_prompts_are_no_template(spark):
    rows = [(f"that winter the man{k} hid the key{k}", "naquele inverno") for k in range(12)] + [(f"cet hiver le {k} lit un {k}", "naquele inverno") for k in range(8)]
    rows += [(f"prompt{k} about thing {k} of {k} kinds", f"texto {k} sobre coisa {k} de {k} tipos") for k in range(200)]
    rows += [(f"other{k} about matter {k} of {k} sorts", "não posso") for k in range(5)]
    got = pairs.templates(spark.createDataFrame(rows, "q string, a string")).collect()
    assert [r["words"] for r in got] == ["não posso"]
