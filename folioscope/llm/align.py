"""Sentences of two languages that translate one another (problem 2).

Word translation tables are estimated by expectation-maximisation over all books: the expected counts of a round are
summed by Spark, books are the unit of work, and no table is collected. With the last table, spans are linked
competitively: the best-covered pair of sentences anywhere in a book is accepted first, its words are used up, and a
sentence whose words aren't used up yet may take a further partner; what isn't covered well enough stays alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.canon import with_canonical
from folioscope.llm.sentences import units_of
from folioscope.session import checkpointed
from folioscope.sources.tables import once_by_id

#: Sentences of one side worked on together; larger books are cut into pieces that overlap by their neighbours and are
#: widened by candidates from anywhere in the book.
PIECE = 400
#: Rounds of estimation after the first one by position.
ROUNDS = 3
#: Share of the shorter sentence's weight that must be covered for a link, and for a further partner.
COVERED, FURTHER = 0.5, 0.5
#: Word pairs whose expected count is under this share of both words' counts are no translation.
FAINT = 0.01
#: Share of a word's best translation from which another one is kept.
CLEAR = 0.3
#: Books in an Arrow batch.
BATCH = 200
#: Word pairs held by a task before they are handed on.
HELD = 2_000_000
#: Expected count from which a task hands a word pair on.
SLIGHT = 0.02
#: Scripts by which sides in no language of COMMON are told apart.
SCRIPTS = ("IsLatin", "IsCyrillic", "IsGreek", "IsArabic", "IsHebrew", "IsDevanagari", "IsHangul", "IsHan", "IsThai", "IsHiragana", "IsArmenian", "IsGeorgian", "IsBengali", "IsTamil")
# Words that tell the languages of a book's sides apart, so that each pair has a table of its own.
COMMON = {
    "de": "der die das den dem und ein eine dass aber nicht ist im auf",
    "en": "the and of that with on in was but by at an is",
    "es": "el la los las del que en con una pero y se un no",
    "fr": "le la les des du que dans et une est mais au sur a",
    "pt": "o a os as do da que em com uma mas e na no",
    "ru": "и в на не что с а по из к",
    "zh": "的 了 这 那 是 在 和 一",
}


def sentences(lines: DataFrame) -> DataFrame:
    """doc_id, side, line_id, at (order within the side), ws (hashes of its words) of every sentence with words of a language."""
    once = once_by_id(lines.select("doc_id", "side", "line_id", "i", "text"), "line_id").where("text is not null and doc_id is not null")
    c = with_canonical(once, "text", "c").select("doc_id", "side", "line_id", "i", "c", F.posexplode(units_of(F.col("c"))).alias("k", "u"))
    s = F.expr("substring(c, u.start_pos + 1, u.end_pos - u.start_pos)")
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"), F.lit(0))
    # Words in small letters or of a script without cases; a sentence in capitals counts by its words of capitals.
    small = F.size(F.regexp_extract_all(s, F.lit(r"(?<![\p{L}\p{N}\p{M}-])(?:\p{Ll}|(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])\p{Lo})[\p{L}\p{M}]+"), F.lit(0)))
    capitals = s.rlike(r"\p{Lu}{2,}(?:[^\p{L}\p{N}]+\p{Lu}{2,}){3}") & ~s.rlike(r"\p{Ll}")
    wide = s.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{4}")
    each = c.where((small >= 2) | wide | capitals).select("doc_id", "side", "line_id", (F.coalesce("i", F.lit(0)) * F.lit(1 << 31) + F.col("k")).alias("at"), words.alias("words"))
    each = checkpointed(each)
    votes = F.array(*[_votes(ws, lang) for lang, ws in COMMON.items()], *[_letters(script) for script in SCRIPTS])
    said = each.select("doc_id", "side", F.explode(votes).alias("v")).groupBy("doc_id", "side", "v.lang").agg(F.sum("v.n").alias("n"))
    top = said.groupBy("doc_id", "side").agg(F.max(F.struct("n", "lang")).alias("m"))
    pair = top.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("side", F.lit("="), "m.lang"))), ">").alias("pair"))
    salted = F.transform("words", lambda w: F.xxhash64("pair", w))
    return each.join(pair, "doc_id").select("doc_id", "side", "line_id", "at", salted.alias("ws"))


def _letters(script: str):
    """A vote for a script: languages that COMMON doesn't name share a table per script."""
    return F.struct((F.size(F.filter("words", lambda w: w.rlike(rf"^\p{{{script}}}"))) * 0.01).alias("n"), F.lit(script).alias("lang"))


def _votes(ws: str, lang: str):
    return F.struct((F.size(F.array_intersect("words", F.array(*map(F.lit, ws.split())))) * 1.0).alias("n"), F.lit(lang).alias("lang"))


def books(sents: DataFrame) -> DataFrame:
    """One row per book (per overlapping piece of a large one): doc_id, piece, pieces, o and t (its sentences), in order.

    Pieces of large books stay if a side is empty, as widened() may fill it.
    """
    n = sents.groupBy("doc_id", "side").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    most = n.groupBy("doc_id").agg(F.ceil(F.max("n") / PIECE).cast("int").alias("pieces"))
    placed = sents.join(n, ["doc_id", "side"]).join(most, "doc_id")
    rel = (F.col("at") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    piece = F.least(F.floor(rel * F.col("pieces")).cast("int"), F.col("pieces") - 1)
    near = F.filter(F.array(piece - 1, piece, piece + 1), lambda p: (p >= 0) & (p < F.col("pieces")))
    key = F.xxhash64(F.array_sort(F.array_distinct("ws")))
    placed = placed.select("doc_id", "pieces", "side", F.struct(F.col("at"), rel.alias("rel"), "line_id", "ws", key.alias("k")).alias("s"), F.explode(F.when(F.col("side") == "orig", F.array(piece)).otherwise(near)).alias("piece"))
    pick = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("s"))))
    return placed.groupBy("doc_id", "piece", "pieces").agg(pick("orig").alias("o"), pick("trans").alias("t")).where("size(o) > 0 and size(t) > 0 or pieces > 1")


def _each(bs: DataFrame, side: str) -> DataFrame:
    """doc_id and s, one row per sentence of a side of large books."""
    return bs.select("doc_id", F.explode(side).alias("s")).dropDuplicates(["doc_id", "s"])


def widened(large: DataFrame, table: DataFrame | None) -> DataFrame:
    """Pieces of large books with candidates from anywhere in the book added to t.

    A link needs half of the weight of one of the two sentences covered, so a linked pair shares a word, or a word and
    its translation, among the rarest words of that sentence that make up just over half of its weight. Sentences are
    met by these words alone, from either side; none is left out, however many there are.
    """
    o = checkpointed(large.select("doc_id", "piece", F.explode("o").alias("s")).groupBy("doc_id", "piece", "s.k").agg(F.first("s.ws").alias("ws")))
    t = checkpointed(_each(large, "t").groupBy("doc_id", F.col("s.k").alias("kt")).agg(F.min("s").alias("s")))
    ow, tw = o.select("doc_id", "piece", "k", F.explode(F.array_distinct("ws")).alias("e")), t.select("doc_id", "kt", F.explode(F.array_distinct("s.ws")).alias("f"))
    meaning = large.select(F.explode(F.flatten(F.transform("o", lambda x: x["ws"]))).alias("e")).distinct().withColumn("f", F.col("e"))
    if table is not None:
        meaning = meaning.unionByName(table.select("e", "f")).distinct()
    of_o = _rarest(ow, ["doc_id", "piece", "k"], "e").join(meaning, "e").join(tw, ["doc_id", "f"]).select("doc_id", "piece", "kt")
    of_t = _rarest(tw, ["doc_id", "kt"], "f").join(meaning, "f").join(ow, ["doc_id", "e"]).select("doc_id", "piece", "kt")
    far = of_o.unionByName(of_t).distinct().join(t, ["doc_id", "kt"]).groupBy("doc_id", "piece").agg(F.collect_list("s").alias("far"))
    both = large.join(far, ["doc_id", "piece"], "left").withColumn("t", F.array_sort(F.array_distinct(F.when(F.col("far").isNull(), F.col("t")).otherwise(F.concat("t", "far")))))
    return checkpointed(both.drop("far").where("size(o) > 0 and size(t) > 0"))


def _rarest(words: DataFrame, key: list[str], word: str) -> DataFrame:
    """The rarest words of each sentence that hold just over half of its weight (rarer words of a book weigh more)."""
    df = words.groupBy("doc_id", word).agg(F.count("*").alias("df"))
    n = words.select(*key).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    weighed = words.join(df, ["doc_id", word]).join(n, "doc_id").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("df", F.log1p(F.col("n") / F.col("df")).alias("w"), word))).alias("ws"))
    total = F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"])
    start = F.struct(F.lit(0.0).alias("had"), F.array().cast("array<bigint>").alias("kept"))
    take = lambda s, x: F.when(s["had"] <= F.col("total") * (1 - COVERED) + 1e-9, F.struct((s["had"] + x["w"]).alias("had"), F.array_append(s["kept"], x[word]).alias("kept"))).otherwise(s)
    return weighed.withColumn("total", total).select(*key, F.explode(F.aggregate("ws", start, take)["kept"]).alias(word))


class _Side:
    """Sentences of one side of a book as arrays."""

    def __init__(self, rel, line_id, words):
        self.rel, self.line_id, self.words = rel, line_id, words


def _arrow_books(batch: pa.RecordBatch):
    """(o, t, table) of each row, read from the Arrow buffers; table is None or arrays e, f, p, s."""

    def spread(name):
        c = batch.column(name)
        v = c.values
        ws = v.field("ws")
        return c.offsets.to_numpy(), v.field("rel").to_numpy(), v.field("line_id").to_numpy(), ws.offsets.to_numpy(), ws.values.to_numpy()

    def side(x, k):
        off, rel, line, woff, words = x
        a, b = off[k], off[k + 1]
        return _Side(rel[a:b], line[a:b], [np.unique(words[woff[j] : woff[j + 1]]) for j in range(a, b)])

    o, t = spread("o"), spread("t")
    table = None
    if "table" in batch.schema.names:
        c = batch.column("table")
        table = c.offsets.to_numpy(), [c.values.field(x).to_numpy() for x in ("e", "f", "p", "s")]
    for k in range(batch.num_rows):
        own = None if table is None else [x[table[0][k] : table[0][k + 1]] for x in table[1]]
        yield side(o, k), side(t, k), own


class _Book:
    """A book's sentences over its own two vocabularies."""

    def __init__(self, o: _Side, t: _Side, table):
        self.s, self.t, self.rs, self.rt = o.words, t.words, o.rel, t.rel
        self.ve = np.unique(np.concatenate(self.s)) if self.s else np.zeros(0, np.int64)
        self.vf = np.unique(np.concatenate(self.t)) if self.t else np.zeros(0, np.int64)
        self.is_ = [np.searchsorted(self.ve, x) for x in self.s]
        self.it = [np.searchsorted(self.vf, x) for x in self.t]
        self.xs, self.xt = self._incidence(self.is_, len(self.ve)), self._incidence(self.it, len(self.vf))
        self.same = self.ve[:, None] == self.vf[None, :]
        self.p = np.zeros(self.same.shape)
        self.sym = np.zeros(self.same.shape)
        if table is not None and len(table[0]):
            e, f, p, s = table
            i, j = np.searchsorted(self.ve, e), np.minimum(np.searchsorted(self.vf, f), len(self.vf) - 1)
            ok = self.vf[j] == f
            self.p[i[ok], j[ok]], self.sym[i[ok], j[ok]] = p[ok], s[ok]

    @staticmethod
    def _incidence(rows, n):
        x = np.zeros((len(rows), n), np.float32)
        for k, r in enumerate(rows):
            x[k, r] = 1
        return x

    def weights(self):
        """Rarer words within the book weigh more."""
        we = np.log1p(len(self.s) / np.maximum(self.xs.sum(0), 1))
        wf = np.log1p(len(self.t) / np.maximum(self.xt.sum(0), 1))
        return we, wf

    def by_place(self) -> np.ndarray:
        """Weight of each pair before anything is known: near places, and rare words that both have."""
        d = np.abs(self.rs[:, None] - self.rt[None, :]) * max(len(self.s), len(self.t))
        near = np.exp(-((d / 3.0) ** 2))
        e, f = np.nonzero(self.same)
        rare = 1.0 / np.maximum(np.maximum(self.xs.sum(0)[e], self.xt.sum(0)[f]), 1) ** 2
        shared = (self.xs[:, e] * rare) @ self.xt[:, f].T if len(e) else 0
        w = near * 0.3 + shared * 3 * (0.1 + near)
        return w / np.maximum(w.sum(1, keepdims=True), 1e-9)

    def links(self) -> list[tuple[int, int]]:
        """Competitive linking of spans; `how` has the score and the covered target words of each link."""
        # Against the best partners within the book, so that no language pair depends on how often the others occur.
        top_e, top_f = self.sym.max(1, keepdims=True), self.sym.max(0, keepdims=True)
        some = top_e[top_e > 0]
        least = 0.4 * np.median(some) if len(some) else 1.0
        rel = self.sym / np.maximum(np.maximum(top_e, top_f), least)
        rel[self.same] = 1.0
        rel[rel < 0.5] = 0
        we, wf = self.weights()
        cov_t = np.stack([rel[i].max(0) if len(i) else np.zeros(rel.shape[1]) for i in self.is_])  # best source of each target word
        cov_s = np.stack([rel[:, j].max(1) if len(j) else np.zeros(rel.shape[0]) for j in self.it])
        a = (self.xs * we) @ cov_s.T  # covered weight of the source sentence
        b = cov_t @ (self.xt * wf).T
        ts, tt = (self.xs @ we)[:, None], (self.xt @ wf)[None, :]
        fs, ft = a / np.maximum(ts, 1e-9), b / np.maximum(tt, 1e-9)
        score = np.maximum(fs, ft) * 0.6 + np.minimum(fs, ft) * 0.4
        free_s, free_t = [np.ones(len(i), bool) for i in self.is_], [np.ones(len(j), bool) for j in self.it]
        used_s, used_t = np.zeros(len(self.s), bool), np.zeros(len(self.t), bool)
        out, self.how = [], []
        order = np.argsort(-score, axis=None, kind="stable")
        for flat in order:
            i, j = divmod(int(flat), score.shape[1])
            if max(fs[i, j], ft[i, j]) < COVERED or score[i, j] < 0.35:
                if score[i, j] < 0.3:
                    break
                continue
            ci, cj = self.is_[i], self.it[j]
            r = rel[np.ix_(ci, cj)] * free_s[i][:, None] * free_t[j][None, :]
            gs, gt = r.max(1), r.max(0)
            part_s, part_t = (gs * we[ci]).sum() / max(ts[i, 0], 1e-9), (gt * wf[cj]).sum() / max(tt[0, j], 1e-9)
            need = FURTHER if used_s[i] or used_t[j] else COVERED
            if max(part_s, part_t) < need or min(part_s, part_t) < 0.15:
                continue
            if used_s[i] and used_t[j]:
                continue
            # A further partner must be covered itself: it is the smaller part of a merge.
            if used_s[i] and part_t < need or used_t[j] and part_s < need:
                continue
            out.append((i, j))
            self.how.append((float(score[i, j]), self.vf[cj[gt >= 0.5]]))
            used_s[i] = used_t[j] = True
            free_s[i] &= gs < 0.5
            free_t[j] &= gt < 0.5
        return out


def _by_place(b: _Book, rows: np.ndarray) -> np.ndarray:
    """Expected counts of the sentences `rows` over the pairs that their places allow, under the table known so far."""
    ns = rows / np.maximum(b.xs.sum(1), 1)
    c = (b.xs * ns[:, None]).T @ b.by_place() @ b.xt
    if b.p.any():
        told = c * (b.p + 0.02)
        c = told * (c.sum(0, keepdims=True) / np.maximum(told.sum(0, keepdims=True), 1e-12))
    return c


def _expected(first: bool):
    """Partition function: rows of books -> summed expected counts e, f, c."""

    def run(batches):
        left, right, vals, held = [], [], [], 0

        def flush():
            e, f, c = np.concatenate(left), np.concatenate(right), np.concatenate(vals)
            order = np.lexsort((f, e))
            e, f, c = e[order], f[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (f[1:] != f[:-1])]))
            c = np.add.reduceat(c, at)
            some = c > SLIGHT
            return pa.RecordBatch.from_arrays([pa.array(e[at][some]), pa.array(f[at][some]), pa.array(c[some].astype(np.float32))], ["e", "f", "c"])

        for batch in batches:
            for o, t, table in _arrow_books(batch):
                b = _Book(o, t, table)
                if first:
                    c = _by_place(b, np.ones(len(b.s), bool))
                else:
                    linked = b.links()
                    alone = np.ones(len(b.s), bool)
                    alone[[i for i, _ in linked]] = False
                    c = _by_place(b, alone)
                    for i, j in linked:
                        sub = b.p[np.ix_(b.is_[i], b.it[j])] + 1e-4
                        c[np.ix_(b.is_[i], b.it[j])] += sub / (sub.sum(0, keepdims=True) + 1e-3)
                c[b.same.any(1), :] = 0  # words that both sides write alike need no table
                c[:, b.same.any(0)] = 0
                e, f = np.nonzero(c > 1e-3)
                left.append(b.ve[e])
                right.append(b.vf[f])
                vals.append(c[e, f])
                held += len(e)
                if held > HELD:
                    yield flush()
                    left, right, vals, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _table(counts: DataFrame) -> DataFrame:
    """e, f, p (share of e's count), s (share of both words' counts) of the translations that aren't faint."""
    c = counts.groupBy("e", "f").agg(F.sum("c").alias("c"))
    c = checkpointed(c)
    te, tf = c.groupBy("e").agg(F.sum("c").alias("ce")), c.groupBy("f").agg(F.sum("c").alias("cf"))
    p, s = F.col("c") / F.col("ce"), F.col("c") / F.sqrt(F.col("ce") * F.col("cf"))
    t = checkpointed(c.join(te, "e").join(tf, "f").select("e", "f", p.cast("float").alias("p"), s.cast("float").alias("s")).where(F.col("s") >= FAINT))
    be, bf = t.groupBy("e").agg(F.max("s").alias("be")), t.groupBy("f").agg(F.max("s").alias("bf"))
    return t.join(be, "e").join(bf, "f").where((F.col("s") >= CLEAR * F.col("be")) | (F.col("s") >= CLEAR * F.col("bf"))).select("e", "f", "p", "s")


def _with_table(bs: DataFrame, table: DataFrame) -> DataFrame:
    """Books with the entries of their own words; words are joined once per book."""
    e = bs.select("doc_id", "piece", F.explode(F.array_distinct(F.flatten(F.transform("o", lambda x: x["ws"])))).alias("e")).join(table, "e")
    own = e.groupBy("doc_id", "piece").agg(F.collect_list(F.struct("e", "f", "p", "s")).alias("table"))
    none = F.array().cast("array<struct<e:bigint,f:bigint,p:float,s:float>>")
    return bs.join(own, ["doc_id", "piece"], "left").withColumn("table", F.coalesce("table", none))


def tables(lines: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(books, widened pieces of large books if there are any, translation table) after ROUNDS rounds of estimation."""
    # A row is a whole book with its part of the table, so few of them make an Arrow batch.
    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    bs = checkpointed(books(sentences(lines)))
    large = bs.where("pieces > 1")
    if large.isEmpty():
        large = None
    else:
        bs = bs.where("pieces = 1")
    every = lambda table: (bs, None) if large is None else (bs.unionByName(wide := widened(large, table)), wide)
    table = _table(every(None)[0].mapInArrow(_expected(True), "e long, f long, c float"))
    for _ in range(ROUNDS):
        table = _table(_with_table(every(table)[0], table).mapInArrow(_expected(False), "e long, f long, c float"))
    return bs, every(table)[1], table


def _copies(side: _Side) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for k, w in enumerate(side.words):
        out.setdefault(w.tobytes(), []).append(k)
    return out


def _large_pairs(large: DataFrame, table: DataFrame) -> DataFrame:
    """x, y: linked lines of large books.

    A target sentence may be linked in several pieces; these links compete for its words, best score first, as the
    links within a piece do.
    """

    def link(batches):
        for batch in batches:
            docs, cols = batch.column("doc_id").to_pylist(), [[], [], [], [], []]
            keys = [[c.values.field("k").to_numpy()[a:b] for a, b in zip(c.offsets.to_numpy(), c.offsets.to_numpy()[1:])] for c in (batch.column("o"), batch.column("t"))]
            for k, (o, t, own) in enumerate(_arrow_books(batch)):
                b = _Book(o, t, own)
                for (i, j), (score, words) in zip(b.links(), b.how):
                    for col, v in zip(cols, (docs[k], int(keys[0][k][i]), int(keys[1][k][j]), score, words.tolist())):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], ["doc_id", "ko", "kt", "score", "words"])

    links = _with_table(large, table).mapInArrow(link, "doc_id long, ko long, kt long, score double, words array<long>")
    links = links.groupBy("doc_id", "ko", "kt").agg(F.max(F.struct("score", "words")).alias("m"))
    ranked = links.groupBy("doc_id", "kt").agg(F.sort_array(F.collect_list(F.struct("m.score", "ko", "m.words")), asc=False).alias("ls"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<bigint>").alias("used"))

    def take(acc, x):
        free = F.size(F.array_except(x["words"], acc["used"])) >= F.greatest(F.lit(1), F.ceil(F.size(x["words"]) * FURTHER))
        ok = (F.size(acc["kept"]) == 0) | free
        return F.when(ok, F.struct(F.array_append(acc["kept"], x["ko"]).alias("kept"), F.array_union(acc["used"], x["words"]).alias("used"))).otherwise(acc)

    kept = ranked.select("doc_id", "kt", F.explode(F.aggregate("ls", start, take)["kept"]).alias("ko"))
    of = lambda side, key, line: _each(large, side).select("doc_id", F.col("s.k").alias(key), F.col("s.line_id").alias(line)).distinct()
    return kept.join(of("o", "ko", "x"), ["doc_id", "ko"]).join(of("t", "kt", "y"), ["doc_id", "kt"]).select("x", "y")


def found(lines: DataFrame) -> DataFrame:
    """line_id_a, line_id_b (a < b): lines of one book's two sides of which one translates a sentence of the other.

    Re-delivered lines count once. Null and empty texts, and lines without words of a language (names, codes), have no
    partner. Copies of a sentence within a side share its partners. Within books of more than PIECE sentences a
    partner is sought in the same and the neighbouring pieces and among the candidates of widened(), which are all.
    """
    bs, large, table = tables(lines)

    def link(batches):
        for batch in batches:
            xs, ys = [], []
            for o, t, own in _arrow_books(batch):
                b = _Book(o, t, own)
                alike_s, alike_t = _copies(o), _copies(t)
                for i, j in b.links():
                    for x in alike_s[o.words[i].tobytes()]:
                        for y in alike_t[t.words[j].tobytes()]:
                            xs.append(o.line_id[x])
                            ys.append(t.line_id[y])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    pairs = _with_table(bs, table).mapInArrow(link, "x long, y long")
    if large is not None:
        pairs = pairs.unionByName(_large_pairs(large, table))
    return pairs.select(F.least("x", "y").alias("line_id_a"), F.greatest("x", "y").alias("line_id_b")).where("line_id_a < line_id_b").distinct()
