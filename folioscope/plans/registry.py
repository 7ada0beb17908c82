"""Queries of the core by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import logparse
from folioscope.plans import core, flow
from folioscope.sources.tables import table

FLAGSHIP = "validate_char_count"


def p1_found(spark, d):
    return logparse.log_entries(table(spark, d, "log_line"))


def p1_templates(spark, d):
    return logparse.templates(table(spark, d, "log_line")).groupBy("template", "layout").agg(F.sum("n").alias("lines"))


def queries():
    return dict(flow.QUERIES) | {f.__name__: f for f in (p1_found, p1_templates)}


def oracle_sql():
    return dict(core.SQL)
