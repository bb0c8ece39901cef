"""Queries of problem 5: the most similar vectors of every drawer embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.knn import decoded, exact_neighbours, nearest_neighbours
from sparrowdex.runtime import table, written


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = decoded(table(spark, sf_dir, "drawer_embeddings"), "drawer_id")
    near = nearest_neighbours(vectors, k=10, min_cosine=0.90).filter("cosine >= 0.90")
    return near.select(F.least("id", "neighbour").alias("drawer_a"), F.greatest("id", "neighbour").alias("drawer_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = decoded(table(spark, sf_dir, "drawer_embeddings"), "drawer_id")
    near = nearest_neighbours(vectors, k=10)
    return near.select(F.col("id").alias("drawer_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact 10 most similar vectors that come out, for the queries with an id divisible by 20 against all rows."""
    vectors = written(decoded(table(spark, sf_dir, "drawer_embeddings"), "drawer_id"), "vectors")
    asked = vectors.filter("id % 20 = 0")
    exact = exact_neighbours(vectors, asked).select("id", "neighbour").withColumn("true", F.lit(1))
    near = nearest_neighbours(vectors, k=10).select("id", "neighbour").withColumn("found", F.lit(1))
    both = exact.join(near, ["id", "neighbour"], "left").join(asked.select("id", "model"), "id")
    out = both.groupBy("model").agg(F.countDistinct("id").alias("queries"), F.round(F.sum(F.coalesce("found", F.lit(0))) / F.sum("true"), 4).alias("recall"))
    return out


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall}
# Little-endian float32 from its bits: infinities and NaN have an exponent of 255.
_FLOAT = """CASE WHEN (u >> 23) & 255 = 255 THEN NULL WHEN (u >> 23) & 255 = 0 THEN 0.0
  ELSE (CASE WHEN u >> 31 = 1 THEN -1.0 ELSE 1.0 END) * (1 + (u & 8388607) / 8388608.0) * pow(2.0, ((u >> 23) & 255) - 127) END"""
_DECODED = f"""raw AS (SELECT drawer_id AS id, embedding_model AS model, dim, quant, hex(bytes) AS h FROM drawer_embeddings
  WHERE embedding_model IS NOT NULL AND dim > 0 AND octet_length(bytes) = CASE quant WHEN 0 THEN 4 * dim WHEN 1 THEN 4 + dim END),
words AS (SELECT id, model, dim, quant, i, CAST('0x' || h[8*i+7:8*i+8] || h[8*i+5:8*i+6] || h[8*i+3:8*i+4] || h[8*i+1:8*i+2] AS BIGINT) AS u
  FROM (SELECT *, unnest(range(CASE quant WHEN 0 THEN dim ELSE 1 END)) AS i FROM raw)),
floats AS (SELECT id, model, dim, quant, i, {_FLOAT} AS v FROM words),
bytes1 AS (SELECT id, i, CAST('0x' || h[9+2*i:10+2*i] AS INTEGER) AS b FROM (SELECT id, h, unnest(range(dim)) AS i FROM raw WHERE quant = 1)),
vals AS (SELECT id, model, dim, i, v FROM floats WHERE quant = 0
  UNION ALL SELECT f.id, f.model, f.dim, b.i, f.v * (CASE WHEN b.b > 127 THEN b.b - 256 ELSE b.b END) FROM floats f JOIN bytes1 b USING (id) WHERE f.quant = 1),
vecs AS MATERIALIZED (SELECT id, model, dim, list(v ORDER BY i) AS x FROM vals GROUP BY id, model, dim
  HAVING count(v) = dim AND max(abs(v)) > 0)"""

SQL = {
    "p5_found": f"""WITH {_DECODED},
unit AS MATERIALIZED (SELECT id, model, dim, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM vecs),
near AS (SELECT l.id AS a, r.id AS b, list_dot_product(l.x, r.x) AS c FROM unit l JOIN unit r ON l.model = r.model AND l.dim = r.dim AND l.id <> r.id),
best AS (SELECT a, b, c FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS drawer_a, greatest(a, b) AS drawer_b FROM best WHERE c >= 0.90""",
}
