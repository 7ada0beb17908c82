"""Blocks of each book into batches of fixed capacity (problem 4).

Planning works on the histogram of lengths: a best-fit pass places counts of equal items into classes of equal open
batches and writes down slots (a run of ranks of one length goes to a run of batches). Blocks then take their slots by
joining on their length and their rank within it, so a book of any size is planned from at most max_batch_chars rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits of books without a configuration.
DEFAULT_SIZE, DEFAULT_CHARS = 10, 2200
#: Shares in which the equal lengths of a book are ranked.
SALT = 16


class _Batches:
    """Open batches by (free characters, free places), as runs of batch numbers."""

    def __init__(self, chars: int, places: int):
        self.chars, self.places, self.made = chars, places, 0
        self.open: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        self.keys: list[tuple[int, int]] = []

    def put(self, free: int, places: int, run: list[int]) -> None:
        if places > 0:
            if not self.open[free, places]:
                bisect.insort(self.keys, (free, places))
            self.open[free, places].append(run)

    def take(self, length: int, n: int, most_places: bool) -> tuple[tuple[int, int], list[int]] | None:
        """Up to n batches of the class that length fits best into."""
        k = bisect.bisect_left(self.keys, (length, 0))
        if k == len(self.keys):
            return None
        key = self.keys[k]
        if most_places:  # of the classes with as little room, the one with the most places left
            while k + 1 < len(self.keys) and self.keys[k + 1][0] == key[0]:
                k += 1
                key = self.keys[k]
        run = self.open[key][-1]
        got = [run[0], min(run[1], n)]
        if got[1] == run[1]:
            self.open[key].pop()
            if not self.open[key]:
                self.keys.remove(key)
        else:
            run[0] += got[1]
            run[1] -= got[1]
        return key, got

    def new(self, n: int) -> list[int]:
        run = [self.made, n]
        self.made += n
        return run


def plan(lengths: list[tuple[int, int]], chars: int, places: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(batches, slots) for a histogram of (length, count).

    A slot (length, rank, n, batch, per) says that the items of that length with ranks rank..rank+n-1 go to batches
    batch, batch+1, ..., each taking `per` of them. Long items come first, each into the fullest batch that has room.
    The second order shares out places: with many short items every batch keeps some room for a long one. The order
    that needs fewer batches is taken; it isn't tried where the first one reaches the least possible number.
    """
    best = None
    for spread in (False, True):
        b, slots = _Batches(chars, places), []
        todo = sorted(lengths, reverse=True)
        n_all, sum_all = sum(n for _, n in todo), sum(x * n for x, n in todo)
        least = max(-(-n_all // places), -(-sum_all // max(chars, 1)), 1)
        if spread and least > 1:
            b.put(chars, places, b.new(least))
        for length, n in todo:
            rank = 0
            while n:
                got = b.take(length, n, spread)
                if got is None:
                    per = max(1, min(places, chars // length if length else places, n))
                    run = b.new(n // per)
                    key, took = (chars, places), [run[0], run[1]]
                else:
                    key, took = got
                    per = 1 if spread else max(1, min(key[1], key[0] // length if length else key[1], n // took[1]))
                count = per * took[1]
                slots.append((length, rank, count, took[0], per))
                b.put(key[0] - per * length, key[1] - per, took)
                rank += count
                n -= count
        used = b.made if not (spread and least > 1) else max((s[3] + -(-s[2] // s[4]) for s in slots), default=0)
        if best is None or used < best[0]:
            best = (used, slots)
        if used <= least:  # no order can need fewer
            break
    return best


def batches(blocks: DataFrame, books: DataFrame, configs: DataFrame) -> DataFrame:
    """doc_id, batch_no (from 1), block_id, piece_no (from 1), start_pos, n_chars of the `orig` blocks of every book.

    Re-delivered blocks count once; a null char_count is the length of the text, a null text has length 0 and still
    takes a place. Only blocks longer than max_batch_chars are cut, into full pieces and a rest. Books without a known
    configuration have DEFAULT_SIZE and DEFAULT_CHARS; of two configurations of one book the lower number holds, and
    limits under 1 count as 1. Blocks without a book are packed as well.
    """
    once = blocks.where("side = 'orig'").groupBy("block_id", "doc_id").agg(F.max(F.coalesce("char_count", F.length("text"), F.lit(0))).alias("n"))
    limits = books.groupBy("doc_id").agg(F.min("config_id").alias("config_id")).join(
        configs.groupBy("config_id").agg(F.min("max_batch_size").alias("size"), F.min("max_batch_chars").alias("chars")), "config_id", "left"
    )
    limits = limits.select(F.col("doc_id").alias("book"), F.greatest(F.coalesce("size", F.lit(DEFAULT_SIZE)), F.lit(1)).alias("size"), F.greatest(F.coalesce("chars", F.lit(DEFAULT_CHARS)), F.lit(1)).alias("chars"))
    own = once.join(limits, F.col("doc_id").eqNullSafe(F.col("book")), "left").drop("book").fillna({"size": DEFAULT_SIZE, "chars": DEFAULT_CHARS})
    cut = F.when(F.col("n") > F.col("chars"), F.sequence(F.lit(1), F.ceil(F.col("n") / F.col("chars")).cast("int"))).otherwise(F.array(F.lit(1)))
    pieces = own.select("doc_id", "block_id", "size", "chars", "n", F.explode(cut).alias("piece_no")).withColumn("start_pos", ((F.col("piece_no") - 1) * F.col("chars")).cast("int"))
    pieces = pieces.withColumn("n_chars", F.least(F.col("n") - F.col("start_pos"), F.col("chars")).cast("int")).drop("n")

    def planned(parts):
        for pdf in parts:
            out = []
            for doc, size, chars, hist in zip(pdf["doc_id"], pdf["size"], pdf["chars"], pdf["hist"]):
                doc = None if pd.isna(doc) else int(doc)
                out += [(doc, *slot) for slot in plan([(h["n_chars"], h["n"]) for h in hist], int(chars), int(size))[1]]
            yield pd.DataFrame(out, columns=["d", "l", "rank", "many", "batch", "per"]).astype({"d": "Int64"})

    # Counts first by SALT shares of a book, so that blocks without a book or equal pieces of one text aren't one task's.
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("block_id", "piece_no"), F.lit(SALT)))
    shares = pieces.groupBy("doc_id", "size", "chars", "n_chars", "share").agg(F.count("*").alias("n"))
    histogram = shares.groupBy("doc_id", "size", "chars", "n_chars").agg(F.sum("n").alias("n"))
    # One row per book, over all cores: a row holds at most `chars` lengths, and planning costs far more than its bytes tell.
    spread = histogram.groupBy("doc_id", "size", "chars").agg(F.collect_list(F.struct("n_chars", "n")).alias("hist"))
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.sparkSession.sparkContext.defaultParallelism)
    slots = spread.repartition(tasks, F.xxhash64("doc_id")).mapInPandas(planned, "d long, l int, rank long, many long, batch long, per long")
    before = Window.partitionBy("doc_id", "n_chars").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select(F.col("doc_id").alias("sd"), F.col("n_chars").alias("sl"), F.col("share").alias("ss"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "n_chars", "share").orderBy("block_id", "piece_no")) - 1)
    at = F.col("doc_id").eqNullSafe(F.col("sd")) & (F.col("n_chars") == F.col("sl")) & (F.col("share") == F.col("ss"))
    ranked = ranked.join(starts, at).withColumn("r", F.col("start") + F.col("k"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("n_chars") == F.col("l")) & (F.col("r") >= F.col("rank")) & (F.col("r") < F.col("rank") + F.col("many"))
    return ranked.join(slots, on).select(
        "doc_id", (F.col("batch") + F.floor((F.col("r") - F.col("rank")) / F.col("per")) + 1).cast("int").alias("batch_no"), "block_id", "piece_no", "start_pos", "n_chars"
    )
