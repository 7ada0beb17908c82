"""Queries of the text problems: name -> function of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import align, canon, encode, langid, leaks, packing, pairs, scans, sentences
from folioscope.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return align.found(table(spark, d, "line_entry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.found(table(spark, d, "line_entry"), table(spark, d, "text_block"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "line_entry").select(F.lit("line_entry").alias("tbl"), F.col("line_id").alias("id"), "text")
    rows = rows.unionByName(table(spark, d, "text_block").select(F.lit("text_block").alias("tbl"), F.col("block_id").alias("id"), "text"))
    return canon.with_canonical(rows.distinct()).drop("text")


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.batches(table(spark, d, "text_block"), table(spark, d, "book"), table(spark, d, "config_set"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "ocr_entry"), table(spark, d, "text_block"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "ocr_entry"), table(spark, d, "text_block"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "ocr_entry"), langid.fitted(langid.sample(table(spark, d, "documents"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "text_block"), table(spark, d, "book"), table(spark, d, "documents"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fitted(langid.sample(table(spark, d, "documents")))
    return langid.segments(langid.distinct_blocks(table(spark, d, "text_block")), model)


def p7_sides(spark: SparkSession, d: str) -> DataFrame:
    blocks = langid.distinct_blocks(table(spark, d, "text_block"))
    return langid.sides(blocks, langid.segments(blocks, langid.fitted(langid.sample(table(spark, d, "documents")))))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_canonical, p4_batches, p5_found, p5_paragraphs, p6_found, p7_found, p7_segments, p7_sides, p8_ids, p9_found, p10_found)}
SQL: dict[str, str] = {}
