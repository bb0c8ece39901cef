"""Queries of problem 1: drawers and pages above the size limit of their scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.split import split_items
from sparrowdex.runtime import table


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    wings = table(spark, sf_dir, "wings").select(F.col("id").alias("wing_id"), F.col("name").alias("scope"))
    drawers = table(spark, sf_dir, "drawers").select("wing_id", F.lit("drawer").alias("item_kind"), F.col("id").alias("item_id"), "body")
    drawers = drawers.join(wings, "wing_id").select("item_kind", "item_id", "scope", "body")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.lit("page").alias("scope"), F.col("content_markdown").alias("body"))
    limits = table(spark, sf_dir, "size_limits")
    return split_items(drawers, limits).unionByName(split_items(pages, limits))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item is above its limit if it comes out in more than one piece: its first piece stands for it."""
    return _pieces(spark, sf_dir).filter("piece_no = 1").select("item_kind", "item_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

SQL = {
    "p1_found": """SELECT 'drawer' AS item_kind, d.id AS item_id
FROM drawers d JOIN wings w ON d.wing_id = w.id JOIN size_limits l ON l.scope = w.name WHERE strlen(d.body) > l.max_bytes
UNION ALL
SELECT 'page', p.page_id FROM pages p JOIN size_limits l ON l.scope = 'page' WHERE strlen(p.content_markdown) > l.max_bytes"""
}
