"""Token ids of a public byte-level BPE vocabulary (problem 8), with higher-order functions only.

A text is cut by the vocabulary's word pattern. A word that is a token itself is looked up; every other distinct word
of the corpus is folded once: its bytes are an array, and the pair of lowest rank is merged until no pair has a rank. Ranks
lie in a literal: an array of BUCKETS small maps, addressed by the hash of the bytes, as a lookup in one map of the
whole vocabulary would scan it. Bytes are carried as ISO-8859-1 strings, one character per byte. No Python runs.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

BUCKETS = 16384
#: Folded words, and characters of them and their ids, up to which they are handed out as a literal.
LITERAL_WORDS, LITERAL_CHARS = 400_000, 16_000_000
_SPACE = r"\t-\r \x1c-\x1f\x85\xa0  -     　"
_UNICODE_SPACE = _SPACE.replace(r"\x1c-\x1f", "")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def rank_json(path: str) -> str:
    """JSON of BUCKETS maps from bytes (as ISO-8859-1 text) to rank."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                data = base64.b64decode(token)
                buckets[zlib.crc32(data) % BUCKETS][data.decode("latin-1")] = int(rank)
    return json.dumps(buckets, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _ranks(path: str | None) -> Column:
    return F.from_json(F.lit(rank_json(path or default_path())), "array<map<string,int>>")


def _rank(ranks: Column, word: Column) -> Column:
    return _let(word, lambda w: F.get(ranks, F.pmod(F.crc32(F.encode(w, "ISO-8859-1")), F.lit(BUCKETS)).cast("int"))[w])


def words_of(text: Column, path: str | None = None) -> Column:
    """Array of struct(w, r): the text's words as bytes, with the id of those that are tokens themselves."""
    s = _UNICODE_SPACE  # Java's \\s is ASCII unless told otherwise, so the class is written out
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+"
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    as_bytes = F.transform(words, lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"))
    return _let(_ranks(path), lambda ranks: F.transform(as_bytes, lambda w: F.struct(w.alias("w"), _rank(ranks, w).alias("r"))))


def folded(word: Column, path: str | None = None) -> Column:
    """Ids of one word: ranked merges folded over its bytes, the lowest rank first and the leftmost of equals."""
    return _let(_ranks(path), lambda ranks: _folded(word, ranks))


def _folded(word: Column, ranks: Column) -> Column:
    none = F.array().cast("array<int>")

    def pair(p: Column, k: Column) -> Column:
        return _rank(ranks, F.concat(F.get(p, k), F.get(p, k + 1)))

    def merged(s: Column) -> Column:
        def at(k: Column) -> Column:
            joined = F.concat(
                F.slice(s["p"], 1, F.greatest(k - 1, F.lit(0))),
                F.array(F.concat(F.element_at(s["p"], k), F.element_at(s["p"], k + 1))),
                F.slice(s["p"], k + 2, F.size(s["p"])),
            )
            return _let(
                joined,
                lambda p: F.struct(
                    p.alias("p"),
                    F.concat(
                        F.slice(s["r"], 1, F.greatest(k - 2, F.lit(0))),
                        F.when(k > 1, F.array(pair(p, k - 2))).otherwise(none),
                        F.when(k < F.size(p), F.array(pair(p, k - 1))).otherwise(none),
                        F.slice(s["r"], k + 2, F.size(s["p"])),
                    ).alias("r"),
                ),
            )

        low = F.array_min(s["r"])
        return F.when(low.isNull(), s).otherwise(_let(F.array_position(s["r"], low).cast("int"), at))

    def start(p: Column) -> Column:
        pairs = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda k: pair(p, k)))
        return F.struct(p.alias("p"), F.coalesce(pairs, none).alias("r"))

    pieces = _let(
        F.split(word, ""),
        lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), start(p), lambda s, _: merged(s), lambda s: s["p"]),
    )
    return F.transform(pieces, lambda w: _rank(ranks, w))


def token_ids(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row, without special tokens; null and empty texts have an empty array.

    Texts are cut once; each distinct word that is no token itself is folded once for the whole corpus. Rows repeated
    under one doc_id, or with a null one, each keep their own ids.
    """
    cut = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text), path).alias("ws"))
    hard = F.array_distinct(F.transform(F.filter("ws", lambda w: w["r"].isNull()), lambda w: w["w"]))
    # Per word its id, or -1, -2, ... for the text's first, second, ... word that is none.
    refs = F.transform("ws", lambda w: F.coalesce(w["r"], (-F.array_position(F.col("hard"), w["w"])).cast("int")))
    read = checkpointed(cut.withColumn("hard", hard).select("doc_id", refs.alias("refs"), "hard"))
    words = read.select(F.explode("hard").alias("w")).distinct()
    table = checkpointed(words.select("w", folded(F.col("w"), path).alias("ids")))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("w") + F.size("ids") * 6), F.lit(0)).alias("chars")).first()
    if size["n"] <= LITERAL_WORDS and size["chars"] <= LITERAL_CHARS:
        known = _known([(r["w"], r["ids"]) for r in table.collect()])
        own = _let(known, lambda t: F.transform("hard", lambda w: F.get(t, F.pmod(F.crc32(F.encode(w, "ISO-8859-1")), F.lit(BUCKETS)).cast("int"))[w]))
        return read.select("doc_id", _let(own, lambda t: _resolved(F.col("refs"), t)).alias("ids"))
    row = F.monotonically_increasing_id()  # of checkpointed rows, so that a repeated task numbers them alike
    read = read.withColumn("row", row)
    wanted = read.select("row", F.posexplode("hard").alias("k", "w"))
    own = wanted.join(table, "w").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("t"))
    ids = _let(F.transform("t", lambda x: x["ids"]), lambda t: _resolved(F.col("refs"), t))
    return read.select("row", "doc_id", "refs").join(own, "row", "left").select("doc_id", ids.alias("ids"))


def _resolved(refs: Column, own: Column) -> Column:
    """Ids of a text's words: the references, with the text's own words written out."""
    return F.flatten(F.transform(refs, lambda r: F.when(r < 0, F.get(own, -r - 1)).otherwise(F.array(r))))


def _known(folds: list[tuple[str, list[int]]]) -> Column:
    """A literal of BUCKETS maps from word to ids."""
    buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for w, ids in folds:
        buckets[zlib.crc32(w.encode("latin-1")) % BUCKETS][w] = ids
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,array<int>>>")


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of token ids: their binary pieces concatenated; ids outside the vocabulary give null."""
    with open(path or default_path(), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [""] * (1 + max(int(r) for _, r in pairs))
    for token, r in pairs:
        pieces[int(r)] = token.decode()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")
    return F.decode(F.aggregate(ids, F.lit(b""), lambda s, k: F.concat(s, F.get(table, k))), "UTF-8")
