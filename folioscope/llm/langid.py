"""Languages of texts and of the single-language segments within them (problem 7).

Nearest centroid: normalised TF-IDF vectors of character n-grams are compared by cosine with several clustered
centroids per language; a vector too far from all of them, or without a lower-case word, has no language. The
classifier is fitted on a bounded sample of labelled texts (SAMPLE_TEXTS per language, chosen by hash over the whole
corpus); wrong labels are thrown out by classifying the sample itself. Everything else covers all rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.canon import canonical_points, code_points
from folioscope.llm.sentences import units_of
from folioscope.sources.tables import once_by_id

#: Buckets of hashed n-grams, n-gram lengths, centroids per language.
DIMS, GRAMS, CLUSTERS = 16384, (2, 3), 2
#: Labelled texts per language that the classifier is fitted on, and characters and paragraphs of them.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_PARTS = 300, 2000, 300
#: Cosine under which a text has no language.
REJECT = 0.12
#: Letters under which a text has no language; a letter of a script without spaces counts as four.
LETTERS = 15
#: Texts scored at once.
SLICE = 1000

# What language labels stand for, after lower-casing and cutting at the first of - _ and blank.
LABELS = {
    "en": ("en", "eng", "english", "inglês", "ingles", "inglés", "anglais", "englisch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugués", "portugais", "portugiesisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "espanhol", "castellano", "espagnol", "spanisch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francês", "frances", "francés", "französisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "alemão", "alemao", "alemán", "allemand"),
    "ru": ("ru", "rus", "russian", "русский", "russo", "ruso", "russe", "russisch"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "chinês", "chino", "chinois", "chinesisch", "mandarin"),
    "ja": ("ja", "jpn", "japanese", "日本語", "japonês"),
    "ar": ("ar", "ara", "arabic", "العربية", "árabe"),
    "hi": ("hi", "hin", "hindi", "हिन्दी"),
    "el": ("el", "ell", "gre", "greek", "ελληνικά", "grego"),
    "th": ("th", "tha", "thai", "ไทย", "tailandês"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
}

# Languages written in Latin letters.
LATIN = ("en", "pt", "es", "fr", "de", "it", "nl")


def label_code(label: Column) -> Column:
    """The two-letter code a written label stands for; null if it stands for none."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_\-(]+)", 1)
    spelt = F.from_json(F.lit(json.dumps({w: code for code, ws in LABELS.items() for w in ws})), "map<string,string>")
    return spelt[F.coalesce(key, F.lit(""))]


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Lower-case letter of each code point; a blank for all that is no letter or mark."""
    import unicodedata

    out = np.full(0x110000, 32, np.uint32)
    for cp in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)]:
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LM":
            out[cp] = ord(ch.lower()[0])
    out[0x3400:0xA000] = np.arange(0x3400, 0xA000)
    out[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return out


def _grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(row, bucket) of every n-gram of every text, by length and in order of rows, and which texts have words of a language."""
    cps, starts = canonical_points(*code_points(texts))
    n = len(starts) - 1
    low = _folding()[cps]
    row = np.repeat(np.arange(n), np.diff(starts))
    wide = cps >= 0x2E80
    caseless = (low == cps) & (low != 32) & ((cps >= 0x0590) & (cps < 0x1100) | wide)
    plain = (low == cps) & (low != 32)
    prev = np.concatenate([[32], low[:-1]])
    prev[starts[:-1][starts[:-1] < len(low)]] = 32
    after = np.concatenate([plain[1:], [False]]) & np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else plain
    begins = plain & (prev == 32) & after | caseless
    capital = (low != cps) & (low != 32)
    heads = (low != 32) & (prev == 32)
    worded = (np.bincount(row[begins], minlength=n) > 0) | (np.bincount(row[heads & capital], minlength=n) >= 4) & (np.bincount(row[plain], minlength=n) == 0)
    worded &= np.bincount(row[low != 32], np.where(wide, 4, 1)[low != 32], minlength=n) >= LETTERS
    keep = ~((low == 32) & (prev == 32))
    low, row = low[keep].astype(np.uint64), row[keep]
    grams = []
    for g in GRAMS:
        m = len(low) - g + 1
        if m <= 0:
            continue
        h = np.full(m, g, np.uint64)
        for k in range(g):
            h = (h ^ low[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = (row[:m] == row[g - 1 :]) & (low[:m] != 32 if g == 1 else True)
        grams.append((row[:m][ok], ((h[ok] >> np.uint64(13)) % np.uint64(DIMS)).astype(np.int64)))
    return grams, worded


@dataclass
class Model:
    """idf of each bucket; centroids (unit vectors) and the language of each."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]

    def weighted(self) -> np.ndarray:
        """Centroids by bucket, times idf."""
        if getattr(self, "_weighted", None) is None:
            self._weighted = np.ascontiguousarray((self.centroids * self.idf).T.astype(np.float32))
        return self._weighted

    def _scripts(self, texts: pa.Array):
        """(which texts, which centroids) by script: texts of Latin letters alone, and all others."""
        cps, starts = code_points(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        latin = np.bincount(row[(cps >= 0x0370) & (_folding()[cps] != 32)], minlength=len(texts)) == 0
        western = np.array([x in LATIN for x in self.langs])
        if western.any():
            yield latin, np.flatnonzero(western)
        yield (~latin if western.any() else np.ones(len(texts), bool)), np.arange(len(self.langs))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_weighted"}

    def classify(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language or '', confidence 0..1) of each text; nulls and empty texts have none."""
        names, confs = [], []
        for k in range(0, len(texts), SLICE):
            a, b = self._slice(texts[k : k + SLICE])
            names.append(a)
            confs.append(b)
        return (np.concatenate(names), np.concatenate(confs)) if names else (np.zeros(0, object), np.zeros(0))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        grams, worded = _grams(texts)
        cos, square = np.zeros((n, len(self.centroids)), np.float32), np.zeros(n)
        # Texts of Latin letters only share nothing with centroids of other scripts.
        for which, columns in self._scripts(texts):
            weighted = self.weighted()[:, columns]
            for row, bucket in grams:
                mine = which[row]
                r, b = (row, bucket) if mine.all() else (row[mine], bucket[mine])
                if len(r):
                    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    cos[np.ix_(r[first], columns)] += np.add.reduceat(weighted[b], first, axis=0)
        for row, bucket in grams:
            square += np.bincount(row, self.idf[bucket] ** 2, minlength=n)
        cos /= np.sqrt(np.maximum(square, 1e-18))[:, None]
        order = sorted(set(self.langs))
        best = np.stack([cos[:, [i for i, x in enumerate(self.langs) if x == lang]].max(1) for lang in order], 1)
        top = best.argmax(1)
        first = best[np.arange(n), top]
        rest = best.copy()
        rest[np.arange(n), top] = -1
        second = np.maximum(rest.max(1), 0) if best.shape[1] > 1 else np.zeros(n)
        conf = np.clip(1 - second / np.maximum(first, 1e-9), 0, 1) ** 0.5
        known = worded & (first >= REJECT)
        return np.where(known, np.array(order, object)[top], ""), np.where(known, conf, 0.0)


def _in_slices(texts: list[str], size: int = 100):
    """(start, row, bucket) of the n-grams of a few texts at a time, so that little is held at once."""
    for k in range(0, len(texts), size):
        for r, b in _grams(pa.array(texts[k : k + size]))[0]:
            yield k, r, b


def _dense(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), np.float32)
    for k, r, b in _in_slices(texts):
        np.add.at(x, (k + r, b), 1)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means; the start is the first vector and then the one farthest from all chosen."""
    c = [x[0]]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin(np.max(x @ np.stack(c).T, 1))])
    c = np.stack(c)
    for _ in range(8):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fitted(labelled: list[tuple[str, str]]) -> Model:
    """A model from (language, text) pairs; parts of texts whose own classification contradicts their label are left out once."""
    parts = [(lang, p) for lang, t in labelled for p in t.replace("\r", "\n").split("\n\n") if len(p.strip()) >= 20]
    by: dict[str, list[str]] = {}
    for lang, p in parts:
        by.setdefault(lang, [])
        if len(by[lang]) < SAMPLE_PARTS:
            by[lang].append(p)
    by = {k: v for k, v in by.items() if len(v) >= 2}
    if not by:
        return Model(np.ones(DIMS), np.zeros((1, DIMS), np.float32), [""])
    n = sum(map(len, by.values()))
    seen = np.zeros(DIMS, np.int64)
    for texts in by.values():
        for _, r, b in _in_slices(texts):
            seen += np.bincount(np.unique(r * DIMS + b) % DIMS, minlength=DIMS)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    model = None
    for turn in range(2):
        cents, langs = [], []
        for lang, texts in sorted(by.items()):
            if turn:
                own, _ = model.classify(pa.array(texts))
                texts = [t for t, o in zip(texts, own) if o == lang] or texts
            for v in _clustered(_dense(texts, idf), CLUSTERS if turn else 1):
                cents.append(v)
                langs.append(lang)
        model = Model(idf, np.stack(cents).astype(np.float32), langs)
    return model


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE_TEXTS (language, start of text) pairs per language, the first by hash of id over the whole table."""
    d = docs.select("doc_id", label_code(F.col("lang")).alias("code"), "text").where("code is not null and length(trim(text)) >= 40")
    counts = {r["code"]: r["count"] for r in d.groupBy("code").count().collect()}  # one row per known code
    if not counts:
        return []
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for code, n in counts.items():
        rate = F.when(F.col("code") == code, F.lit(min(1.0, 3.0 * SAMPLE_TEXTS / n))).otherwise(rate)
    from pyspark.sql.window import Window

    few = d.withColumn("h", h).where(F.col("h") < rate).select("code", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("k") <= SAMPLE_TEXTS)
    return [(r["code"], r["text"]) for r in first.orderBy("code", "k").collect()]


def classifier(model: Model):
    """A pandas UDF: array of texts -> array of struct(lang, confidence)."""
    shared = _Shared(model)

    @F.pandas_udf("array<struct<lang:string,confidence:double>>")
    def run(texts: pd.Series) -> pd.Series:
        lists = [[] if t is None else list(t) for t in texts]
        langs, conf = shared.model.classify(pa.array([x for t in lists for x in t], pa.string()))
        out, k = [], 0
        for t in lists:
            out.append([{"lang": str(langs[j]), "confidence": float(conf[j])} for j in range(k, k + len(t))])
            k += len(t)
        return pd.Series(out)

    return run


class _Shared:
    def __init__(self, model: Model):
        self.model = model


def segments(blocks: DataFrame, model: Model, row_id: str = "block_id", text: str = "text") -> DataFrame:
    """row_id, seg_no, lang, confidence, start_pos, end_pos: the single-language segments of each row.

    A segment is a longest run of sentences of one language; sentences without a language (names, numbers, codes,
    fragments) neither begin nor end one. confidence is the mean over the segment's sentences. Null and empty texts
    have no segments.
    """
    cut = blocks.select(row_id, F.col(text).alias("t"), units_of(F.col(text)).alias("us"))
    texts = F.transform("us", lambda u: F.substring(F.col("t"), u["start_pos"] + 1, u["end_pos"] - u["start_pos"]))
    named = cut.select(row_id, "us", classifier(model)(texts).alias("ls"))
    known = F.filter(F.zip_with("us", "ls", lambda u, x: F.struct(u["start_pos"].alias("a"), u["end_pos"].alias("b"), x["lang"].alias("lang"), x["confidence"].alias("c"))), lambda x: x["lang"] != "")
    none = F.array().cast("array<struct<a:int,b:int,lang:string,c:double,n:int>>")

    def add(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        new = F.struct(x["a"].alias("a"), x["b"].alias("b"), x["lang"].alias("lang"), x["c"].alias("c"), F.lit(1).alias("n"))
        more = F.struct(last["a"].alias("a"), x["b"].alias("b"), last["lang"].alias("lang"), (last["c"] + x["c"]).alias("c"), (last["n"] + 1).alias("n"))
        return F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["lang"] == x["lang"]), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(s, F.array(new)))

    return (
        named.select(row_id, F.posexplode(F.aggregate(known, none, add)).alias("k", "s"))
        .select(row_id, (F.col("k") + 1).alias("seg_no"), F.col("s.lang").alias("lang"), (F.col("s.c") / F.col("s.n")).alias("confidence"), F.col("s.a").alias("start_pos"), F.col("s.b").alias("end_pos"))
    )


def sides(blocks: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id, side, lang, confidence: the language that most characters of a side are in, and its share of them."""
    c = blocks.select("block_id", "doc_id", "side").join(segs, "block_id").groupBy("doc_id", "side", "lang").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("long").alias("n"))
    top = F.max(F.struct("n", "lang")).alias("m")
    return c.groupBy("doc_id", "side").agg(top, F.sum("n").alias("all")).select("doc_id", "side", "m.lang", (F.col("m.n") / F.col("all")).alias("confidence"))


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """block_id, doc_id, side, text with re-delivered rows once."""
    return once_by_id(blocks.select("block_id", "doc_id", "side", "text"), "block_id")


def found(blocks: DataFrame, books: DataFrame, docs: DataFrame, least: int = 40) -> DataFrame:
    """block_id, seg_no, lang of segments whose language isn't what the label of their book's side stands for."""
    b = distinct_blocks(blocks).where(F.length("text") >= least)
    labels = (
        books.select("doc_id", F.explode(F.array(F.struct(F.lit("orig").alias("side"), F.col("source_lang").alias("l")), F.struct(F.lit("trans").alias("side"), F.col("target_lang").alias("l")))).alias("x"))
        .groupBy("doc_id", F.col("x.side").alias("side")).agg(F.max(label_code(F.col("x.l"))).alias("code"))
    )
    labelled = b.join(labels, ["doc_id", "side"], "left")
    segs = segments(labelled.withColumn("key", F.struct("block_id", "code")), fitted(sample(docs)), "key")
    return segs.where(~F.col("lang").eqNullSafe(F.col("key.code"))).select("key.block_id", "seg_no", "lang")
