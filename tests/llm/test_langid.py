"""Languages of segments: labels, held-out accuracy, runs within a text, rejection."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import langid

NOUNS = {
    "en": "the library|the old bridge|the winter garden|a quiet reader|the blue letter|the night train",
    "pt": "a biblioteca|a ponte antiga|o jardim de inverno|um leitor quieto|a carta azul|o trem noturno",
    "de": "die Bibliothek|die alte Brücke|der Wintergarten|ein stiller Leser|der blaue Brief|der Nachtzug",
    "ru": "старая библиотека|тихий читатель|зимний сад|синее письмо|ночной поезд|новый мост",
    "zh": "旧图书馆|新的一章|冬天的花园|安静的读者|蓝色的信|夜间火车",
}
VERBS = {"en": "described|forgot|opened", "pt": "descreveu|esqueceu|abriu", "de": "beschrieb|vergaß|öffnete", "ru": "описывает|забывает|открывает", "zh": "描述了|忘记了|打开了"}
MORE = {"en": "because it was raining", "pt": "porque estava chovendo", "de": "weil es regnete", "ru": "потому что шёл дождь", "zh": "因为下雨了"}


def sentence(rnd, lang):
    gap = "" if lang == "zh" else " "
    s = gap.join([rnd.choice(NOUNS[lang].split("|")), rnd.choice(VERBS[lang].split("|")), rnd.choice(NOUNS[lang].split("|")), MORE[lang]])
    return s[0].upper() + s[1:] + ("。" if lang == "zh" else ".")


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    texts = [(lang, " ".join(sentence(rnd, lang) for _ in range(3))) for lang in NOUNS for _ in range(40)]
    texts += [("en", " ".join(sentence(rnd, "de") for _ in range(3))) for _ in range(5)]  # wrong labels
    return langid.fitted(texts)


def test_labels(spark):
    xs = ["en", "English", "en-US", "EN", "pt_br", "Português Brasileiro", "deu", " fr-FR ", "Español", "Inglês", "??", "auto", "und", "", " ", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string")
    got = [r["c"] for r in df.select("k", langid.label_code(F.col("x")).alias("c")).orderBy("k").collect()]
    assert got == ["en", "en", "en", "en", "pt", "pt", "de", "fr", "es", "en", None, None, None, None, None, None]


def test_held_out(model):
    rnd = random.Random(2)
    pairs = [(lang, sentence(rnd, lang)) for lang in NOUNS for _ in range(60)]
    got, conf = model.classify(pa.array([t for _, t in pairs]))
    assert sum(a == b for a, (b, _) in zip(got, pairs)) >= 0.99 * len(pairs)
    assert ((conf >= 0) & (conf <= 1)).all()


def test_no_language(model):
    got, conf = model.classify(pa.array(["TASVI-4522 Orilo", "12 345,6", "", None, "Tasmor Velquil Brenwyn", "ab"]))
    assert list(got) == [""] * 6 and not conf.any()


def test_segments(spark, model):
    rnd = random.Random(3)
    s = lambda lang: sentence(rnd, lang)
    texts = [f"{s('en')} {s('en')} {s('de')} {s('en')}", f"{s('pt')} TASVI-4522. {s('pt')}", None, "", "VELMO-1", s("zh") + s("zh")]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "block_id long, text string, lang string")
    got = [(r["block_id"], r["seg_no"], r["lang"]) for r in langid.segments(df, model).orderBy("block_id", "seg_no").collect()]
    assert got == [(0, 1, "en"), (0, 2, "de"), (0, 3, "en"), (1, 1, "pt"), (5, 1, "zh")]
    assert langid.segments(df.limit(0), model).count() == 0


def test_found_compares_with_the_label_of_the_side(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(sentence(rnd, lang) for _ in range(3)), lang) for k, lang in enumerate(list(NOUNS) * 30)], "doc_id long, text string, lang string")
    t = {k: sentence(rnd, lang) + " " + sentence(rnd, lang) for k, lang in enumerate(("en", "pt", "de", "en"))}
    blocks = spark.createDataFrame([(0, 1, "orig", t[0]), (0, 1, "orig", t[0]), (1, 1, "trans", t[1]), (2, 1, "trans", t[2]), (3, 2, "orig", t[3]), (4, 3, "orig", t[3]), (5, 1, "orig", "Kurz."), (6, 1, "orig", None)], "block_id long, doc_id long, side string, text string")
    books = spark.createDataFrame([(1, "English", "pt-BR"), (1, "English", "pt-BR"), (2, "??", "pt")], "doc_id long, source_lang string, target_lang string")
    got = sorted(tuple(r) for r in langid.found(blocks, books, docs).collect())
    assert got == [(2, 1, "de"), (3, 1, "en"), (4, 1, "en")]


def test_sample_is_bounded_and_skips_unlabelled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 5)
    docs = spark.createDataFrame([(k, "x" * 50, "en" if k % 2 else None) for k in range(300)] + [(999, None, "en"), (998, "", "en")], "doc_id long, text string, lang string")
    got = langid.sample(docs)
    assert 1 <= len(got) <= 5 and {lang for lang, _ in got} == {"en"}
    assert langid.sample(docs.limit(0)) == []
    none = langid.fitted([])
    assert list(none.classify(pa.array(["some words of any kind here"]))[0]) == [""]
