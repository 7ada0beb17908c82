"""Listings and work queues of books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import QUEUE_MARKS, marked


def listing(books: DataFrame, stage: str) -> DataFrame:
    """Documents of a stage: name, size_bytes, mtime; rows listed twice once. Suffixes in any case count."""
    b = books.where(F.col("stage") == stage).select("name", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "mtime").distinct()
    return b.where(F.lower("name").endswith(".pdf"))


def waiting(books: DataFrame, again: DataFrame) -> DataFrame:
    """Queued books whose original isn't among the finished ones and whose names don't say that they are in the target language already.

    Books in `again` (name) pass both tests and are flagged.
    """
    q = listing(books, "queue")
    done = listing(books, "original").select("name")
    a = again.select("name").distinct().withColumn("again", F.lit(True))
    fresh = q.join(done, "name", "left_anti").where(~marked(F.regexp_replace("name", r"(?i)\.pdf$", ""), QUEUE_MARKS)).select("name")
    keep = fresh.unionByName(a.select("name")).distinct()
    return q.join(keep, "name", "left_semi").join(a, "name", "left").withColumn("again", F.coalesce("again", F.lit(False)))


def ordered(queue: DataFrame, by: str = "smallest_first", custom: DataFrame | None = None) -> DataFrame:
    """queue with `place`: flagged books first, then by size or by the custom order (name, rank; missing names last), then by name.

    An unknown order and an empty custom one are 'smallest_first'.
    """
    q = queue
    if by == "custom" and custom is not None and not custom.isEmpty():
        q = q.join(custom.select("name", "rank"), "name", "left").withColumn("rank", F.coalesce("rank", F.lit(999999)))
        key = F.col("rank").asc()
    else:
        q = q.withColumn("rank", F.lit(0))
        key = F.col("size_bytes").desc() if by == "largest_first" else F.col("size_bytes").asc()
    # The order is one report of the whole queue, so its rows meet in one task; they are names and sizes only.
    return q.withColumn("place", F.row_number().over(Window.orderBy(F.col("again").desc(), key, F.col("name").asc()))).drop("rank")


def pending(outputs: DataFrame, validated: DataFrame) -> DataFrame:
    """Outputs (name) that have no report yet (name)."""
    return outputs.join(validated.select("name").distinct(), "name", "left_anti")


def overview(outputs: DataFrame, names: DataFrame, times: DataFrame, reports: DataFrame) -> DataFrame:
    """Outputs with their source (target, source), its seconds (source, seconds) and their report (name, result)."""
    n = names.select(F.col("target").alias("name"), "source")
    return outputs.join(n, "name", "left").join(times.select("source", "seconds"), "source", "left").join(reports.select("name", "result"), "name", "left")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order; the other columns settle ties."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    m = F.max(F.struct(*order, *rest)).alias("m")
    return df.groupBy(*keys).agg(m).select(*keys, "m.*").select(*df.columns)


def named(books: DataFrame, stage: str, by: str = "name_asc") -> DataFrame:
    """Listing of a stage with `place`: by name (case undone), or by time, the latest first and then by name backwards."""
    low = F.lower("name")
    order = [F.col("mtime").desc_nulls_last(), low.desc(), F.col("name").desc()] if by == "mtime_desc" else [low.asc(), F.col("name").asc(), F.col("mtime").asc(), F.col("size_bytes").asc()]
    # One report of names and sizes: its rows meet in one task.
    return listing(books, stage).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def rerun(books: DataFrame, name: str) -> DataFrame:
    """The queue of one finished original (name, size_bytes, mtime) to be processed again, past the done list; empty if there is none."""
    return listing(books, "original").where(F.col("name") == name)


def transitions(books: DataFrame, events: DataFrame) -> DataFrame:
    """Stage of each book after its events, as rows rather than moved files: name, stage, was.

    events: name, at, event in ('start', 'finish', 'stop', 'fail'). A started book is 'traduzindo', a finished one
    'original'; a stopped, failed or never finished one goes back to the queue (recovery), unless a finished original
    of its name is there. The last event holds; of equal times the one that ends more.
    """
    rank = F.when(F.col("event") == "finish", 3).when(F.col("event").isin("stop", "fail"), 2).otherwise(1)
    last = events.groupBy("name").agg(F.max_by("event", F.struct("at", rank)).alias("event"))
    b = books.groupBy("name").agg(F.min("stage").alias("was"), F.max((F.col("stage") == "original").cast("int")).alias("kept"))
    stage = (
        F.when((F.col("kept") == 1) | (F.col("event") == "finish"), "original")
        .when(F.col("event") == "start", "traduzindo").when(F.col("event").isNotNull(), "queue").otherwise(F.col("was"))
    )
    return b.join(last, "name", "left").select("name", stage.alias("stage"), "was")


def recovered(books: DataFrame, alive: bool) -> DataFrame:
    """Originals left in work by a run that isn't alive any more and go back to the queue: name. Partial outputs (_PT) and queued names stay."""
    if alive:
        return books.select("name").limit(0)
    left = listing(books, "traduzindo").where(~F.lower("name").endswith("_pt.pdf")).select("name").distinct()
    return left.join(listing(books, "queue").select("name").distinct(), "name", "left_anti")
