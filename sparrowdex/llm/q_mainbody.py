"""Queries of problem 2: the article of every fetched page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowdex.llm.mainbody import boilerplate_lines, main_bodies
from sparrowdex.runtime import table

_COLUMNS = ("page_id", "content_markdown", "title", "url")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "pages"), *_COLUMNS).selectExpr("id AS page_id", "line_no")


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_bodies(table(spark, sf_dir, "pages"), *_COLUMNS).selectExpr("id AS page_id", "body")


QUERIES = {"p2_found": p2_found, "p2_bodies": p2_bodies}
SQL: dict[str, str] = {}
