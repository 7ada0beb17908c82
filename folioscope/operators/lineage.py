"""What logs tell: which source became which output, and how long it took."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import duration

#: Lines of a log that are ordered in one task.
RUN = 4096


# Fixed formats: what the translation log writes when a book is begun, opened, saved and done.
_TIME = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
EVENTS = {
    "begin": r"Processando:\s+(.+\.pdf)", "open": _TIME + r".*Abrindo PDF: (.+)",
    "saved": _TIME + r".*PDF traduzido salvo: (.+)", "done": r"->\s+Traduzido:\s+(.+\.pdf)",
}


def log_events(lines: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """log_id, line_no, kind, name, ts of the events that log lines (log_id, line_no, text) tell; re-delivered lines count once.

    patterns: regular expressions by kind with one group, the name, or two, the time and the name. A line may tell
    several kinds; a null text tells none; a time that is none, or isn't asked for, is null.
    """
    once = lines.select("log_id", "line_no", "text").where("text is not null").distinct()
    found = []
    for kind, p in (patterns or EVENTS).items():
        two = re.compile(p).groups == 2
        name = F.trim(F.regexp_extract("text", p, 2 if two else 1))
        ts = F.try_to_timestamp(F.translate(F.regexp_extract("text", p, 1), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")) if two else F.lit(None).cast("timestamp")
        found.append(F.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), name.alias("name"), ts.alias("ts"))))
    return once.select("log_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("e")).select("log_id", "line_no", "e.*")


def _filled(lines: DataFrame, value, reset=None) -> DataFrame:
    """lines with `last`: the latest `value` before or in each line of its log, forgotten after a line where `reset` holds.

    Logs are ordered by runs of RUN lines, and the state at the start of a run comes from the runs before it, so a log
    that holds a third of all lines isn't sorted in one task.
    """
    ls = lines.withColumn("run", F.floor(F.col("line_no") / RUN)).withColumn("v", value).withColumn("r", F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False))
    mark = F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("x"))).when(F.col("r"), F.struct(F.lit(None).cast("string").alias("x")))
    ls = ls.withColumn("m", mark)
    before = Window.partitionBy("log_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("log_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = ls.where("m is not null").groupBy("log_id", "run").agg(F.max_by("m", "line_no").alias("end"))
    runs = ls.select("log_id", "run").distinct().join(ends, ["log_id", "run"], "left")
    carried = runs.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("log_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).select("log_id", "run", "carried")
    own = F.coalesce(F.when(F.col("v").isNotNull(), F.col("m")), F.last("m", ignorenulls=True).over(before))
    return ls.withColumn("seen", own).join(carried, ["log_id", "run"], "left").withColumn("last", F.coalesce("seen", "carried")["x"]).drop("seen", "carried", "m", "r", "v", "run")


def strict_mapping(lines: DataFrame) -> DataFrame:
    """log_id, target, source: each output with the last source begun before it; a source serves one output only.

    lines: log_id, line_no, kind ('begin', 'done', others), name. The last line of an output name holds.
    """
    f = _filled(lines, F.when(F.col("kind") == "begin", F.col("name")), F.col("kind") == "done")
    return _last(f.where("kind = 'done' and last is not null"))


def mapping(lines: DataFrame) -> DataFrame:
    """log_id, target, source: each output with the last source opened before it; a source may serve several."""
    f = _filled(lines, F.when(F.col("kind") == "open", F.col("name")))
    return _last(f.where("kind = 'done' and last is not null"))


def _last(f: DataFrame) -> DataFrame:
    return f.groupBy("log_id", F.col("name").alias("target")).agg(F.max_by("last", "line_no").alias("source"))


def timings(lines: DataFrame) -> DataFrame:
    """log_id, source, seconds between a source's opening and the next save; the last save of a source holds."""
    opened = F.when(F.col("kind") == "open", F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("|"), "name"))
    f = _filled(lines, opened).where("kind = 'saved' and last is not null")
    start = F.substring_index("last", "|", 1).cast("long")
    f = f.select("log_id", F.regexp_replace("last", r"^\d+\|", "").alias("source"), "line_no", ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1e6).alias("seconds"))
    return f.groupBy("log_id", "source").agg(F.max_by("seconds", "line_no").alias("seconds"))


def overridden(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """target, source, with manual mappings (target, source) over automatic ones (full outer join)."""
    a = auto.groupBy("target").agg(F.max("source").alias("auto"))
    m = manual.groupBy("target").agg(F.max("source").alias("manual"))
    return a.join(m, "target", "full_outer").select("target", F.coalesce("manual", "auto").alias("source"))


def throughput(books: DataFrame) -> DataFrame:
    """seconds, megabytes, seconds_per_mb over the books with a time. books: size_bytes, seconds."""
    timed = F.col("seconds").isNotNull() & (F.col("seconds") != 0)
    s, mb = F.coalesce(F.sum("seconds"), F.lit(0.0)), F.coalesce(F.sum(F.when(timed, F.col("size_bytes") / 1048576.0)), F.lit(0.0))
    return books.agg(s.alias("seconds"), mb.alias("megabytes")).withColumn("seconds_per_mb", F.try_divide("seconds", "megabytes"))


def report_blocks(text: DataFrame) -> DataFrame:
    """name, result, rate of every report in the texts (column value), whose reports are parted by lines of 60 '='."""
    b = text.select(F.explode(F.split("value", "={60}")).alias("b"))
    g = lambda p, k=1: F.regexp_extract("b", p, k)
    r = b.select(F.trim(g(r"VALIDATING: (.+)")).alias("name"), g(r"RESULT: (PASS|FAIL) \(rate=(\d+)%\)").alias("result"), g(r"RESULT: (PASS|FAIL) \(rate=(\d+)%\)", 2).alias("rate"))
    return r.where("name <> '' and result <> ''").withColumn("rate", F.col("rate").cast("int"))


def unit_totals(books: DataFrame) -> DataFrame:
    """completed, waiting, working and total books by their stages (name, stage); a book listed twice in a stage counts once."""
    n = lambda stage: F.count_distinct(F.when(F.col("stage") == stage, F.col("name")))
    t = books.agg(n("traduzidos").alias("completed"), n("queue").alias("waiting"), n("traduzindo").alias("working"))
    return t.withColumn("total", F.col("completed") + F.col("waiting") + F.col("working"))


def estimate(pace: DataFrame, waiting_mb: DataFrame, current: DataFrame, as_of) -> DataFrame:
    """seconds_per_mb, remaining_seconds, eta, finish (dd/MM HH:mm) and elapsed_seconds of a run at the time as_of.

    pace: one row seconds, megabytes of the timed books; waiting_mb: one row megabytes; current: no or one row
    size_mb, started, page, pages. Without timed books the pace comes from the current book's pages; without that
    either there is no estimate ('Calculando...' and '--').
    """
    c = current.select(F.struct("size_mb", "started", "page", "pages").alias("c")).agg(F.max("c").alias("c"))
    j = pace.select(F.col("seconds").alias("t"), F.col("megabytes").alias("mb")).join(waiting_mb.select(F.col("megabytes").alias("left_mb"))).join(c)
    elapsed = F.unix_timestamp(as_of) - F.unix_timestamp("c.started")
    per = F.when((F.col("mb") > 0) & (F.col("t") > 0), F.col("t") / F.col("mb"))
    left = F.coalesce("left_mb", F.lit(0.0))
    timed = left * per + F.coalesce(F.greatest(F.lit(0.0), F.coalesce("c.size_mb", F.lit(1.0)) * per - elapsed), F.lit(0.0))
    page = F.when((F.col("c.page") > 0) & (F.col("c.pages") > 0), elapsed / F.col("c.page"))
    page_mb = F.when(F.col("c.size_mb") > 0, page * F.col("c.pages") / F.col("c.size_mb"))
    paged = (F.col("c.pages") - F.col("c.page")) * page + left * F.coalesce(page_mb, F.lit(0.0))
    s = F.coalesce(timed, paged)
    return j.select(
        F.coalesce(per, page_mb).alias("seconds_per_mb"), s.alias("remaining_seconds"), F.when(s.isNull(), "Calculando...").otherwise(duration(s)).alias("eta"),
        F.coalesce(F.date_format(F.timestamp_seconds(F.unix_timestamp(as_of) + F.floor(s)), "dd/MM HH:mm"), F.lit("--")).alias("finish"), elapsed.alias("elapsed_seconds"),
    )


def effective_status(status, alive, command):
    """Status to show: a run that isn't alive is idle, a live one that is told to pause is paused, else the status as stored ('idle' if null)."""
    s = F.coalesce(status, F.lit("idle"))
    return F.when(alive & F.coalesce(command == "pause", F.lit(False)), "paused").when(~alive & s.isin("completed", "running", "paused"), "idle").otherwise(s)
