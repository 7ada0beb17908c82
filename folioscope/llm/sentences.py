"""Sentence units of documents in any script (problem 10), as SQL expressions only.

Full stops that end nothing (decimals, addresses, file names, initials, abbreviations, ordinals, and terminators inside
a quotation or bracket) are replaced one for one by a private-use placeholder. Terminator patterns per script then set
a mark behind every sentence end. As the placeholder has the length of what it hides, the units' positions are those
of the original text, and cutting the original by them restores it. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN, MARK = "", ""

# Abbreviations before a name or a word.
BEFORE_NAMES = (
    "Mr Mrs Ms Messrs Dr Dra Drs Prof Profa Profª Sr Sra Srta St Ste Mme Mlle MM Mgr Hr Fr Frl Herr Uds Ud Vd Vds "
    "Sres Exmo Exma Ilmo Ilma Rev Hon Gen Col Capt Sgt Lt Jr г-н г-жа проф акад др γρ κ κα"
)
# Abbreviations before a number or in front of a list or example.
BEFORE_NUMBERS = (
    "fig figs vol vols p pp pág págs pag cap caps art arts cf aprox approx env núm num nº no nr abb bd ca tab ref eq sec "
    "sect ch chap kap hrsg vgl bzw zit s sog evtl inkl ggf ex ej e.g i.e d.h z.b стр рис гл табл им см напр ок тыс ул σελ δηλ εικ τομ βλ π.χ"
)
# German words in front of an ordinal.
BEFORE_ORDINALS = "am|die|der|das|dem|den|des|zur|zum|vom|beim|im|seit|bis|ab|jede[rsmn]?|eine?[rmns]?|ihre?[rmn]?|seine?[rmn]?"
# Sentence ends by script.
ENDS = ".!?…؟۔।॥։።"
WIDE_ENDS = "。！？｡．"
SPACE = r"\s\x1c-\x1f\u0085   -     　"

#: The same characters one by one.
BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hide(t: Column) -> Column:
    h, anyend = HIDDEN, ENDS + WIDE_ENDS
    names = "|".join(sorted(BEFORE_NAMES.split(), key=len, reverse=True))
    numbers = "|".join(x.replace(".", f"[.{h}]") for x in sorted(BEFORE_NUMBERS.split(), key=len, reverse=True))
    # Every pattern starts at the full stop and looks back, as full stops are few and letters many.
    edge = r"(?<![\p{L}\p{M}\p{N}_])"
    t = F.regexp_replace(t, r"[.](?=[\p{L}\p{N}_])(?<=[\p{L}\p{N}_][.])", h)
    t = F.regexp_replace(t, rf"[.](?=[\s,])(?<=(?<![\p{{L}}\p{{M}}\p{{N}}'’_{h}])\p{{L}}[.])(?!(?<=т[.{h}]\s[дп][.])\s+[^\p{{Ll}}\s])", h)
    t = F.regexp_replace(t, rf"[.](?=\s)(?<={edge}(?:{names}|vs)[.])", h)
    t = F.regexp_replace(t, rf"(?iu)[.](?=\s*(?:[\p{{N}}\p{{Ll}}(]|(?-i:[IVXLC]+)\b))(?<={edge}(?:{numbers})[.])", h)
    t = F.regexp_replace(t, rf"(?iu)[.](?=\s+\p{{Lu}})(?<=(?<![\p{{L}}])(?:{BEFORE_ORDINALS})\s{{1,2}}\d{{1,3}}[.])", h)
    low, high = "„", "“"

    def inside(x: Column, opens: str, closes: str) -> Column:
        """Terminators hidden between marks, by a running count of the open ones: one pass, however long the quotation."""
        pieces = F.regexp_extract_all(x, F.lit(rf"[^{opens}{closes}]*(?:[{opens}{closes}]|\z)"), F.lit(0))
        hidden = lambda p: F.regexp_replace(p, rf"[{anyend};](?![{anyend}]*\s?[{closes}])", h)

        def step(s: Column, p: Column) -> Column:
            closed = p.rlike(rf"[{closes}]\z")
            return F.struct(
                F.when(closed, F.greatest(s["open"] - 1, F.lit(0))).when(p.rlike(rf"[{opens}]\z"), s["open"] + 1).otherwise(s["open"]).alias("open"),
                F.concat(s["out"], F.array(F.when(closed & (s["open"] > 0), hidden(p)).otherwise(p))).alias("out"),
            )

        start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(pieces, start, step, lambda s: F.array_join(s["out"], ""))

    t = _let(t, lambda x: F.when(x.contains(low), inside(x, low, high)).when(x.contains("”"), inside(x, "“", "”")).otherwise(x))
    def within(o: str, c: str):
        return lambda x: F.when(x.contains(o), inside(x, "\\" + o, "\\" + c)).otherwise(x)

    for o, c in (("«", "»"), ("「", "」"), ("『", "』"), ("（", "）"), ("‘", "’"), ("(", ")")):
        t = _let(t, within(o, c))
    # A quotation that opens a sentence and is followed by its speaker doesn't end it.
    said = lambda x: F.regexp_replace(x, rf"((?<![：:，,])“[^“”]*)[{anyend}](?=”[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])", f"$1{h}")
    return _let(t, lambda x: F.when(x.contains("”"), said(x)).otherwise(x))


def _marked(t: Column) -> Column:
    """A paragraph with MARK behind each sentence end."""
    h = HIDDEN
    closers = r"(?:[\s]?»|[\"”“’'）)\]』」])*+"
    t = F.regexp_replace(
        t, rf"[{ENDS}]++(?!{h}){closers}(?=[{SPACE}]+(?:[—–-][{SPACE}]+)?[^\p{{Ll}}{SPACE},;:—–-])", f"$0{MARK}"
    )

    def others(t: Column) -> Column:
        t = F.regexp_replace(t, rf"[;;](?<=[\p{{IsGreek}}].){closers}(?=[{SPACE}]+[^\p{{Ll}}{SPACE}])", f"$0{MARK}")
        cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]"
        t = F.regexp_replace(t, rf"[{WIDE_ENDS}…]++(?<!(?<!{cjk}|[{WIDE_ENDS}]|…)…)(?![{h}{WIDE_ENDS}…])(?![」』])[”’）)]*+(?=[^\p{{Ll}},，、;:：{MARK}])", f"$0{MARK}")
        t = F.regexp_replace(t, rf"[{WIDE_ENDS}…]+[」』]+(?=[{SPACE}]*[「『])", f"$0{MARK}")
        return F.regexp_replace(t, rf"[{SPACE}]++(?=[฀-๿])(?<=[฀-๿][{SPACE}]{{1,9}})", f"$0{MARK}")

    return _let(t, lambda x: F.when(x.rlike(r"[\u0370-\u03ff\u0e00-\u0e7f\u3000-\ud7a3\uf900-\ufefe\uff00-\uffef]"), others(x)).otherwise(x))


def units_of(text: Column) -> Column:
    """Array of struct(start_pos, end_pos) in code points; empty for null, empty and blank texts."""
    nl = r"(?:\r\n|\r|\n| | )"
    item = r"(?:[•‣◦▪●*·-]|\d{1,3}[.)]|[A-Za-z][)])[ \t ]"
    def paragraphs_of(x: Column) -> Column:
        cut = F.split(F.regexp_replace(x, rf"{nl}(?:[{SPACE}​­﻿]*{nl})+", f"$0{MARK}"), MARK)
        return F.when(x.contains("\n") | x.contains("\r") | x.contains("\u2028") | x.contains("\u2029"), cut).otherwise(F.array(x))

    paragraphs = _let(text, paragraphs_of)

    def parts(p: Column) -> Column:
        lines = F.filter(F.split(p, nl), lambda x: F.trim(x) != "")
        listed = p.rlike(rf"^[{SPACE}]*{item}") & _let(lines, lambda ls: F.size(F.filter(ls, lambda x: x.rlike(rf"^[ \t]*{item}"))) * 2 > F.size(ls))
        heading = (F.length(F.trim(p)) < 60) & ~p.rlike(rf"\S[{SPACE}]*{nl}[{SPACE}]*\S") & ~p.rlike(rf"[{ENDS}{WIDE_ENDS};][\"”“’')）\]»」』{SPACE}]*$") & ~p.rlike(r"[\u0e00-\u0e7f]")
        items = F.regexp_replace(p, rf"{nl}(?=[ \t]*(?:{item}|[^\p{{Ll}}\s]))", f"$0{MARK}")
        return F.split(F.when(listed, items).when(heading, p).otherwise(_marked(_hide(p))), MARK)

    def placed(texts: Column, start: Column) -> Column:
        """Positions of consecutive texts from start on."""
        return F.aggregate(
            texts,
            F.struct(start.alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("out")),
            lambda s, u: F.struct(
                (s["at"] + F.length(u)).alias("at"),
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(u) - F.length(F.ltrim(u, F.lit(BLANKS)))).cast("int").alias("start_pos"),
                            (s["at"] + F.length(F.rtrim(u, F.lit(BLANKS)))).cast("int").alias("end_pos"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda s: F.filter(s["out"], lambda x: x["end_pos"] > x["start_pos"]),
        )

    ats = F.aggregate(
        paragraphs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,p:string>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), p.alias("p")))).alias("out")),
        lambda s: s["out"],
    )
    return F.when(text.isNotNull(), F.flatten(F.transform(ats, lambda x: placed(parts(x["p"]), x["at"]))))


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sent_no, start_pos, end_pos: the sentence units of every document, numbered from 1.

    Positions count code points from 0, end exclusive, without white space around the unit. Documents whose text is
    null, empty or blank have none; a text of one word or one sign is one unit; a null doc_id stays null.
    """
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(units_of(F.col(text))).alias("k", "u"))
        .select("doc_id", (F.col("k") + 1).cast("int").alias("sent_no"), "u.start_pos", "u.end_pos")
    )
