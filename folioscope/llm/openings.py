"""Near-duplicate openings of texts: word shingles, MinHash bands, verified leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

#: Words per shingle and the similarity of near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and rows of a MinHash signature: a pair of similarity 0.8 shares a band with probability 0.996, one of 0.3 with 0.03.
BANDS, ROWS = 14, 5
#: Factor by which the leaders of a bucket grow from round to round.
MORE = 8


def opening(text: Column) -> Column:
    """The first sentence of a text as compared words; empty for null and wordless texts.

    A first sentence shorter than a shingle may open any text, so the opening goes on to a shingle's words, or to the
    end of a shorter text.
    """
    ends = r"[.!?…]+[\"”»’'“)]*(?:\s|$)|[。！？]|$"
    t = F.coalesce(text, F.lit(""))
    first = F.regexp_extract(t, rf"(?s)^[^\p{{L}}\p{{N}}]*(.*?)(?:{ends})", 1)
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\p{N}]+", " "))
    start = F.regexp_extract(t, rf"^(?:[^\p{{L}}\p{{M}}\p{{N}}]*[\p{{L}}\p{{M}}\p{{N}}]+){{1,{SHINGLE}}}", 0)
    return F.element_at(F.transform(F.array(plain(first)), lambda x: F.when(F.size(F.split(x, " ")) < SHINGLE, plain(start)).otherwise(x)), 1)


def shingles(words: Column) -> Column:
    """Hashes of the SHINGLE-word runs of a blank-separated text; a shorter text is one shingle."""
    w = F.split(words, " ")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda k: F.xxhash64(F.array_join(F.slice(w, k + 1, SHINGLE), " ")))
    return F.array_distinct(runs)


def clusters(openings: DataFrame, words: str = "words") -> DataFrame:
    """words, leader of each distinct opening: a leader is within SIMILAR of every opening it leads, or of their leader.

    openings holds distinct texts, so hot copies are one row. In each band the least text of a bucket leads it; texts
    that aren't similar enough to any of their leaders go another round among themselves until none is left, so no
    pairs within a bucket are emitted and none is dropped. Every round elects MORE times as many leaders in a bucket as
    the one before (each leads a share of the bucket by hash), so the rounds grow with the logarithm of the largest
    bucket even if all its texts are dissimilar.
    """
    s = openings.select(F.col(words).alias("words"), shingles(F.col(words)).alias("sh"))
    signature = [_least(k) for k in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *signature[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    todo = checkpointed(s.select("words", "sh", F.explode(bands).alias("band")))
    crowded = todo.groupBy("band").count().where("count > 1").select("band")
    todo = checkpointed(todo.join(crowded, "band", "left_semi"))
    done, leaders = None, 1
    while not todo.isEmpty():
        share = F.pmod(F.xxhash64("words", F.lit(leaders)), F.lit(leaders))
        lead = todo.groupBy("band", share.alias("share")).agg(F.min(F.struct("words", "sh")).alias("l")).select("band", "l")
        near = F.size(F.array_intersect("sh", "l.sh")) / F.size(F.array_union("sh", "l.sh")) >= SIMILAR
        led = checkpointed(todo.join(lead, "band").where(near).groupBy("words").agg(F.min("l.words").alias("leader")))
        done = led if done is None else done.unionByName(led)
        todo = checkpointed(todo.join(led, "words", "left_anti"))
        leaders *= MORE
    if done is None:
        return s.select("words", F.col("words").alias("leader"))
    return s.select("words").join(_settled(done), "words", "left").select("words", F.coalesce("leader", "words").alias("leader"))


def _settled(led: DataFrame) -> DataFrame:
    """words, leader where a leader that is led itself hands its texts on, so that one class isn't split by the round."""
    up = led.where("words <> leader").select(F.col("words").alias("leader"), F.col("leader").alias("higher"))
    return led.join(up, "leader", "left").select("words", F.coalesce("higher", "leader").alias("leader"))


def _least(k: int) -> Column:
    def salted(h: Column) -> Column:
        return F.xxhash64(h, F.lit(k))

    return F.array_min(F.transform("sh", salted))
