"""Queries of problem 7: a mixture with a target share of the tokens for every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.mix import copies, report, sized_documents, solve_rates
from sparrowdex.runtime import table, written


def _solved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    sized = written(sized_documents(table(spark, sf_dir, "documents"), targets, "doc_id", "text", "source"), "sized")
    return sized, solve_rates(sized, targets)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir)[1].filter("NOT reachable").select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(*_solved(spark, sf_dir)).select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, solved = _solved(spark, sf_dir)
    out = report(copies(sized, solved), solved)
    return out.withColumn("promised_share", F.round("promised_share", 6)).withColumn("reached_share", F.round("reached_share", 6))


QUERIES = {"p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares}

# No case depends on the choice of tokenizer, so bytes stand in for tokens.
SQL = {
    "p7_found": """WITH own AS (
  SELECT t.source, max(t.target_share) AS share, max(t.max_repeats) AS repeats,
         (SELECT sum(strlen(d.text)) FROM documents d WHERE d.source = t.source) AS n
  FROM mix_targets t GROUP BY t.source)
SELECT source FROM own WHERE n IS NULL OR share * (SELECT sum(n) FROM own) > repeats * n"""
}
