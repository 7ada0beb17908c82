"""Session helpers: local test sessions, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (as JSON) up to which a side may be broadcast; beyond it the same join is a shuffled one.
BROADCAST_BYTES = 32_000_000


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a local master (tests, benchmarks) gets a folder of our own; a cluster is told to name
    one, as a folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df computed once (checkpointed), with a broadcast hint only if its rows measure at most `most` bytes."""
    once = checkpointed(df)
    size = once.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in once.columns])))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(once) if size <= most else once
