"""Name search: fuzzy by edit distance, prefix, over whole names and their parts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DISTANCE = 2


def name_tokens(name: Column) -> Column:
    """Lower-case runs of letters and digits; none if the only one is the whole name."""
    low = F.lower(name)
    parts = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when((F.size(parts) == 1) & (parts[0] == low), F.array().cast("array<string>")).otherwise(parts)


def _ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def fuzzy(names: DataFrame, queries: Iterable[str], limit: int = 20) -> DataFrame:
    """(query, name, distance, score, rank): names within two edits of a query, whole or by a part, exactly and for all names.

    The queries are a stated set and travel with the scan; the top of each comes
    from a window that keeps no more than `limit` rows a partition before it
    shuffles.  A query that is empty matches names and parts of up to two letters.
    """
    own = names.select("name").dropna().distinct()
    asked = own.withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries])))
    q = F.lower(F.col("query"))
    forms = F.concat(F.array(F.lower("name")), name_tokens(F.col("name")))
    near = F.filter(F.transform(forms, lambda x: F.when(F.abs(F.length(x) - F.length(q)) <= MAX_DISTANCE, F.levenshtein(x, q, MAX_DISTANCE)).otherwise(F.lit(-1))), lambda d: d >= 0)
    rows = asked.withColumn("distance", F.array_min(near)).filter("distance IS NOT NULL")
    rows = rows.withColumn("score", 1 / (1 + F.col("distance")))
    return _ranked(rows, [F.col("distance"), F.col("name")], limit).select("query", "name", "distance", "score", "rank")


def prefix(names: DataFrame, queries: Iterable[str], limit: int = 20) -> DataFrame:
    """(query, name, matched, score, rank): names of which the whole or a part begins with a query; shortest match first."""
    own = names.select("name").dropna().distinct()
    asked = own.withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries])))
    q = F.lower(F.col("query"))
    forms = F.concat(F.array(F.lower("name")), name_tokens(F.col("name")))
    match = F.array_min(F.transform(F.filter(forms, lambda x: x.startswith(q)), lambda x: F.octet_length(x)))
    rows = asked.withColumn("matched", match).filter("matched IS NOT NULL").withColumn("score", F.octet_length(q) / F.greatest("matched", F.lit(1)))
    return _ranked(rows, [F.col("matched"), F.col("name")], limit).select("query", "name", "matched", "score", "rank")
