"""Queries of problem 4: symbols and the symbols that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.operators.hierarchy import descendants, full_paths, heavy_paths, path_segments, separate_cycles
from sparrowdex.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separate_cycles(table(spark, sf_dir, "symbols"), "id", "parent_id").selectExpr("id AS symbol_id", "cycle_id")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = heavy_paths(table(spark, sf_dir, "symbols"), "id", "parent_id")
    path = full_paths(tree).select("id", F.array_join("path", "/").alias("path"))
    out = tree.labels.join(path, "id")
    return out.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), F.col("depth"), (F.col("size") - 1).alias("n_descendants"), "path")


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = heavy_paths(table(spark, sf_dir, "symbols"), "id", "parent_id")
    return tree.labels.selectExpr("id AS symbol_id", "root AS root_id", "chain AS chain_id", "pos AS chain_pos", "pre AS first", "pre + size - 1 AS last", "light AS chains_above")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = heavy_paths(table(spark, sf_dir, "symbols"), "id", "parent_id")
    return descendants(tree).selectExpr("ancestor AS symbol_id", "id AS descendant_id", "distance")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as pieces of chains: few rows a symbol, whatever its depth."""
    tree = heavy_paths(table(spark, sf_dir, "symbols"), "id", "parent_id")
    return path_segments(tree).selectExpr("id AS symbol_id", "step", "chain AS chain_id", "upto")


QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p4_intervals": p4_intervals, "p4_segments": p4_segments}

_LINKS = """links AS (
  SELECT s.id, p.id AS parent FROM symbols s LEFT JOIN symbols p ON s.parent_id = p.id),
down AS (
  SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.id, d.root, d.depth + 1, d.path || '/' || CAST(l.id AS VARCHAR) FROM links l JOIN down d ON l.parent = d.id)"""

_LABELS = """anc AS (
  SELECT id, id AS above FROM links WHERE id IN (SELECT id FROM down)
  UNION ALL
  SELECT a.id, l.parent FROM anc a JOIN links l ON a.above = l.id WHERE l.parent IS NOT NULL),
sized AS (SELECT l.id, l.parent, n.size FROM links l JOIN (SELECT above AS id, count(*) AS size FROM anc GROUP BY above) n USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, id) AS r FROM sized WHERE parent IS NOT NULL),
placed AS (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY parent ORDER BY r > 1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ranked),
lab AS (
  SELECT id, id AS root, id AS chain, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS pre, CAST(0 AS BIGINT) AS light, size FROM sized WHERE parent IS NULL
  UNION ALL
  SELECT p.id, l.root, CASE WHEN r = 1 THEN l.chain ELSE p.id END, CASE WHEN r = 1 THEN l.pos + 1 ELSE 0 END, CAST(l.pre + p.off AS BIGINT),
    l.light + CASE WHEN r = 1 THEN 0 ELSE 1 END, p.size FROM placed p JOIN lab l ON p.parent = l.id)"""

SQL = {
    "p4_found": f"""WITH RECURSIVE {_LINKS},
open AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM down)),
walk AS (
  SELECT id, parent AS cur FROM open
  UNION
  SELECT w.id, o.parent FROM walk w JOIN open o ON w.cur = o.id),
ring AS (SELECT id FROM walk WHERE id = cur)
SELECT w.id AS symbol_id, min(w.cur) AS cycle_id FROM walk w WHERE w.cur IN (SELECT id FROM ring) GROUP BY w.id""",
    "p4_hierarchy": f"""WITH RECURSIVE {_LINKS},
anc AS (
  SELECT id, parent AS above FROM links WHERE id IN (SELECT id FROM down) AND parent IS NOT NULL
  UNION ALL
  SELECT a.id, l.parent FROM anc a JOIN links l ON a.above = l.id WHERE l.parent IS NOT NULL),
below AS (SELECT above AS id, count(*) AS n FROM anc GROUP BY above)
SELECT d.id AS symbol_id, d.root AS root_id, CAST(d.depth AS BIGINT) AS depth, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants, d.path
FROM down d LEFT JOIN below b USING (id)""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS},
anc AS (
  SELECT id, parent AS above, 1 AS distance FROM links WHERE id IN (SELECT id FROM down) AND parent IS NOT NULL
  UNION ALL
  SELECT a.id, l.parent, a.distance + 1 FROM anc a JOIN links l ON a.above = l.id WHERE l.parent IS NOT NULL)
SELECT above AS symbol_id, id AS descendant_id, distance FROM anc""",
    "p4_intervals": f"""WITH RECURSIVE {_LINKS},
{_LABELS}
SELECT id AS symbol_id, root AS root_id, chain AS chain_id, pos AS chain_pos, pre AS first, pre + size - 1 AS last, light AS chains_above FROM lab""",
    "p4_segments": f"""WITH RECURSIVE {_LINKS},
{_LABELS},
seg AS (
  SELECT id, light AS step, chain, pos AS upto FROM lab
  UNION ALL
  SELECT g.id, g.step - 1, u.chain, u.pos FROM seg g JOIN links l ON l.id = g.chain JOIN lab u ON u.id = l.parent WHERE g.step > 0)
SELECT id AS symbol_id, step, chain AS chain_id, upto FROM seg""",
}
