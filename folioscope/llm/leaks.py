"""Evaluation passages inside training texts (problem 9), by spaced seeds.

Texts become words: compatibility forms, case, accents, punctuation and invisible characters undone. Over every window
of RUN words two fixed masks keep the even and the odd positions. A window with at most one other word agrees with its
passage under one of them at least, so joining the masks' hashes loses nothing; the words around every hit are then
compared one by one.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, checkpointed

#: Words in a row, and how many of them may be another word.
RUN, OTHER = 12, 1
#: Words of 64 bits of the sieve of the items' hashes.
SIEVE = 1 << 16
# Letters that stand for two, and letters whose stroke is no combining mark.
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
STROKES = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ς": "σ"}


#: Scripts without spaces.
APART = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _plain() -> tuple[str, str]:
    """Lower-case letters, digits and signs that decompose to one other character, and those characters."""
    of, to = [], []
    for lo, hi in ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x2190), (0xFF00, 0xFFEF)):
        for cp in range(lo, hi):
            d = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
            if len(d) == 1 and d != chr(cp) and chr(cp).lower() == chr(cp):
                of.append(chr(cp))
                to.append(d)
    return "".join([*of, *STROKES]), "".join([*to, *STROKES.values()])


def words(text: Column) -> Column:
    """Array of compared words of a text; empty for null, empty and wordless texts. Scripts without spaces go by letter."""
    of, to = _plain()

    def paired(t: Column) -> Column:
        for two, letters in PAIRS.items():
            t = F.replace(t, F.lit(two), F.lit(letters))
        return t

    def plain(t: Column) -> Column:
        t = F.translate(t, of, to)
        t = _let(t, lambda x: F.when(x.rlike("[" + "".join(PAIRS) + "]"), paired(x)).otherwise(x))
        apart = lambda x: F.regexp_replace(x, rf"([{APART}])", " $1 ")
        return _let(t, lambda x: F.when(x.rlike(f"[{APART}]"), apart(x)).otherwise(x))

    # What texts without such letters don't need isn't done to them.
    t = _let(F.coalesce(text, F.lit("")), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), plain(F.lower(F.regexp_replace(x, r"[\p{Mn}\p{Me}\p{Cf}]", "")))).otherwise(F.lower(x)))
    return F.filter(F.split(t, r"[^\p{L}\p{N}\p{Mc}]+"), lambda w: w != "")


def _windows(rows: DataFrame, row_id: str, text: str, start: str, bits: Column | None = None) -> DataFrame:
    """row_id, h, start: both masks' hashes of every window, and the hashes of the window's words.

    With bits (see _sieve) only windows of which a hash may be among the passages' are written out.
    """
    hashed = rows.select(F.col(row_id), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("all"))
    n = F.size("all")

    def seeds(k: Column) -> Column:
        keep = lambda odd: F.xxhash64(F.lit(odd), *[F.get("all", k + j) for j in range(odd, RUN, 2)])
        return F.struct(k.alias("k"), F.array(keep(0), keep(1)).alias("h"))

    each = F.when(n >= RUN, F.transform(F.sequence(F.lit(0), n - RUN), seeds))
    if bits is not None:
        each = F.filter(each, lambda s: F.exists(s["h"], lambda h: _told(bits, h)))
    # Outer, as the filter that an inner one implies would be pushed down with all that makes the words, once per use.
    seed = F.transform("ss", lambda s: F.struct(s["h"].alias("h"), F.slice("all", s["k"] + 1, RUN).alias("ws")))
    at = hashed.select(row_id, "all", each.alias("ss")).select(row_id, F.explode_outer(seed).alias("s"))
    return at.select(row_id, F.explode("s.h").alias("h"), F.col("s.ws").alias(start))


def _told(bits: Column, h: Column) -> Column:
    """Whether the bit of a hash is set."""
    word = F.get(bits, F.pmod(F.shiftright(h, 6), F.lit(SIEVE)).cast("int"))
    return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


def _sieve(passages: DataFrame) -> Column:
    """Literal of SIEVE words of 64 bits with one bit per hash; its size doesn't depend on the passages."""
    one = F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")
    at = F.pmod(F.shiftright("h", 6), F.lit(SIEVE)).cast("int")
    rows = passages.groupBy(at.alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    found = [0] * SIEVE
    for r in rows:
        found[r["at"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(found)), "array<bigint>")


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id: which rows of docs hold RUN words in a row of an item, at most OTHER of them replaced.

    Null, empty and short texts hold and lend nothing; equal pairs come once. A sieve of fixed size drops most windows
    of the corpus where they are made. The items' windows are broadcast only if they are measured to be small, otherwise
    both sides are shuffled on the hash.
    """
    passages = checkpointed(_windows(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "item_id", "text", "passage").distinct())
    corpus = _windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "window", _sieve(passages))
    same = F.aggregate(F.zip_with("window", "passage", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return corpus.join(broadcast_if_small(passages), "h").where(same >= RUN - OTHER).select("doc_id", "item_id").distinct()
