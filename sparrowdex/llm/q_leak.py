"""Queries of problem 6: evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.leak import leaks
from sparrowdex.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of 12 words: the longest tile decides, so tiles start at 12 words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks(docs, "doc_id", "text", items, "item_id", "passage", min_match=12, longest=12, coverage=None).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also reordered passages: half of an item's words in tiles of at least 5."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    found = leaks(docs, "doc_id", "text", items, "item_id", "passage", min_match=5, longest=12, coverage=0.5)
    return found.withColumn("covered", F.round("covered", 6))


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
SQL: dict[str, str] = {}
