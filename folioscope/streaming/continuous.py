"""Continuous validation of outputs as they arrive (Structured Streaming over a folder of output rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import Settings

OUTPUT = "name string, doc_id long"
REPORT = "name string, doc_id long, source string, status string, passed boolean, rate double, batch long"
PROGRESS = "name string, at timestamp, status string, page int, pages int"


class QualityTooLow(RuntimeError):
    """Too few pages of an output pass."""


class Stopped(RuntimeError):
    """The control channel ended the query."""


@dataclass
class Validator:
    """Judges each output once.

    outputs: folder of parquet rows (name, doc_id); reports: folder that verdicts are appended to; mapping: gives the
    current (name, source) table, read again for every batch; judge: (name, doc_id, source) rows and the current
    settings -> the same with `passed` and `rate` (share of passing pages). Outputs without a source wait in the pending
    folder and are tried again with every batch; a source whose verdict is null gets the status 'skipped', so nothing
    disappears silently. control gives the command at the start of a batch: 'stop' ends the query, 'pause' leaves the
    batch's outputs pending. settings is read again for every batch. An output of which less than least_rate of the
    pages pass (rounded to three places) stops the query.
    """

    spark: SparkSession
    outputs: str
    reports: str
    pending: str
    mapping: Callable[[], DataFrame]
    judge: Callable[[DataFrame, Settings], DataFrame]
    least_rate: float = 0.5
    control: Callable[[], str] = lambda: "run"
    settings: Callable[[], Settings] = Settings

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def batch(self, new: DataFrame, number: int) -> None:
        """One micro-batch; safe to repeat, as names that have a report are left out."""
        command = self.control()
        if command == "stop":
            raise Stopped("told to stop")
        waiting = self._read(f"{self.pending}/current", OUTPUT)
        asked = new.select("name", "doc_id").unionByName(waiting).distinct()
        # Only the reports of these names are looked at, by a join that prunes columns.
        todo = asked.join(self._read(self.reports, REPORT).select("name").distinct(), "name", "left_anti")
        known = todo.join(self.mapping().select("name", "source"), "name", "left").persist()
        try:
            later = known if command == "pause" else known.where("source is null")
            later.select("name", "doc_id").write.mode("overwrite").parquet(f"{self.pending}/next")
            if command != "pause":
                verdict = self.judge(known.where("source is not null"), self.settings())
                status = F.when(F.col("passed").isNull(), "skipped").otherwise("checked")
                rows = verdict.select("name", "doc_id", "source", status.alias("status"), "passed", F.col("rate").cast("double").alias("rate"), F.lit(number).cast("long").alias("batch"))
                rows.write.mode("append").parquet(self.reports)
            self._read(f"{self.pending}/next", OUTPUT).write.mode("overwrite").parquet(f"{self.pending}/current")
        finally:
            known.unpersist()
        low = self._read(self.reports, REPORT).where((F.col("batch") == number) & (F.round("rate", 3) < self.least_rate)).select("name", "rate").limit(1).collect()
        if low:
            raise QualityTooLow(f"{low[0]['name']}: {low[0]['rate']:.3f} of its pages pass")

    def run(self, checkpoint: str):
        """Process what has arrived and stop; later calls with the same checkpoint go on from there."""
        stream = self.spark.readStream.schema(OUTPUT).parquet(self.outputs)
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Latest command per key and window of a stream of control events (ts, user_id, event_type), closed by watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "5 minutes"), "user_id")
        .agg(F.max(F.struct("ts", "event_type")).alias("m"), F.count("*").alias("n"))
        .select("user_id", F.col("window.start").alias("start"), F.col("m.event_type").alias("last"), "n")
    )


def progress(events: DataFrame) -> DataFrame:
    """Latest progress of each book (name, at, status, page, pages) of a stream or table of progress rows; of equal times the furthest page."""
    m = F.max(F.struct("at", "page", "status", "pages")).alias("m")
    return events.groupBy("name").agg(m).select("name", "m.at", "m.status", "m.page", "m.pages")


def report_text(rows: DataFrame) -> DataFrame:
    """value: one text report per verdict, in the form that lineage.report_blocks reads back."""
    pct = F.bround(F.coalesce("rate", F.lit(0.0)) * 100).cast("int")
    told = F.format_string("RESULT: %s (rate=%d%%)", F.when(F.col("passed"), "PASS").otherwise("FAIL"), pct)
    return rows.where("status = 'checked'").select(F.concat(F.lit("=" * 60 + "\nVALIDATING: "), "name", F.lit("\n"), told, F.lit("\n")).alias("value"))
