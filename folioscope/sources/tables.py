"""Parquet tables of a data folder, and the rule that re-delivered rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, late: str) -> DataFrame:
    """Rows that differ only in the delivery time `late` once, with the earliest of it.

    One hash aggregation with map-side combining; nulls in any column compare equal.
    """
    keys = [c for c in df.columns if c != late]
    return df.groupBy(*keys).agg(F.min(late).alias(late)).select(*df.columns)


def once_by_id(df: DataFrame, key: str) -> DataFrame:
    """Equal rows once, where equal rows share `key`: only rows whose key occurs again are shuffled.

    The keys that occur again are broadcast only if they are measured to be few; otherwise the two joins are shuffled
    on the key. Rows with a null key are compared with each other.
    """
    again = broadcast_if_small(df.groupBy(key).count().where(f"count > 1 and `{key}` is not null").select(key))
    single = df.where(F.col(key).isNotNull()).join(again, key, "left_anti").select(*df.columns)
    several = df.join(again, key, "left_semi").select(*df.columns).unionByName(df.where(F.col(key).isNull())).distinct()
    return single.unionByName(several)
