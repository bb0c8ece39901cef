"""Queries of problem 8: the subjects of documents and the corpus' make-up by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.subjects import subject_areas
from sparrowdex.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "doc_subjects", "subjects")))


def p8_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters a subject; a document of two subjects counts half for each."""
    found = p8_found(spark, sf_dir)
    each = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_list("subject").alias("subjects"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    parts = docs.join(each, "doc_id").select(F.explode("subjects").alias("subject"), (1 / F.col("n")).alias("documents"), (F.col("chars") / F.col("n")).alias("chars"))
    sums = parts.groupBy("subject").agg(F.round(F.sum("documents"), 1).alias("documents"), F.round(F.sum("chars"), 1).alias("chars"))
    return sums


QUERIES = {"p8_found": p8_found, "p8_makeup": p8_makeup}
SQL: dict[str, str] = {}
