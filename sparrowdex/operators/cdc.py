"""Snapshots and incremental maintenance of the index: deltas, upserts, partition replacement, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.operators.lookup import SENTINEL, latest, real

# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "rs": "rust", "go": "go",
    "py": "python", "pyi": "python", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash", "java": "java", "c": "c", "h": "c", "zig": "zig", "md": "markdown", "markdown": "markdown",
    "yaml": "yaml", "yml": "yaml", "csv": "csv",
}


def detect_language(path: Column) -> Column:
    """Language by the extension of a path; null for others and for names that begin with their only dot."""
    ext = F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)\z", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), ext)


def refresh_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): unchanged, touched, modified, added or removed between two snapshots (path, sha256, mtime).

    An equal time means unchanged whatever the hash; paths are expected once a snapshot.
    """
    o = old.select("path", F.struct("sha256", "mtime").alias("o"))
    n = new.select("path", F.struct("sha256", "mtime").alias("n"))
    change = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(F.col("o.mtime").eqNullSafe(F.col("n.mtime")), "unchanged")
        .when(F.col("o.sha256").eqNullSafe(F.col("n.sha256")), "touched")
        .otherwise("modified")
    )
    return o.join(n, "path", "full").select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of several new rows of a key one of the largest id counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc("_new"), F.desc("id")]).drop("_new")


def current(files: DataFrame) -> DataFrame:
    """One row a path: the one indexed last, then the one of the largest id."""
    return latest(files, ["path"], [F.desc("indexed_at"), F.desc("id")])


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old table whose key the new one does not hold, and all rows of the new one."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files without gone(id), with their symbols and the edges from and to these removed as well."""
    f = files.join(gone.select("id"), "id", "left_anti")
    s = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(*symbols.columns)
    lost = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    e = edges.join(lost.select(F.col("id").alias("src_symbol_id")), "src_symbol_id", "left_anti").join(lost.select(F.col("id").alias("dst_symbol_id")), "dst_symbol_id", "left_anti")
    return f, s, e.select(*edges.columns)


def resolve_edges(named: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by name (src_file_id, src_name, dst_name, kind, line) to edges by id, and the names that stay unresolved.

    All symbols are there first, so the outcome does not depend on the order of
    writing: a source is the smallest id of its name in its file, else the edge
    falls away; a target is the smallest real id of its name, else a sentinel,
    given by a null id and its name.
    """
    src = symbols.groupBy(F.col("file_id").alias("src_file_id"), F.col("name").alias("src_name")).agg(F.min("id").alias("src_symbol_id"))
    dst = real(symbols).groupBy(F.col("name").alias("dst_name")).agg(F.min("id").alias("dst_symbol_id"))
    out = named.join(src, ["src_file_id", "src_name"]).join(dst, "dst_name", "left").select("src_symbol_id", "dst_symbol_id", "dst_name", "kind", "line").distinct()
    return out, out.filter("dst_symbol_id IS NULL").select("dst_name").distinct()


def resolve_parents(named: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, parent_id): the last symbol (by line, then id) of the parent's name in the same file; null without one."""
    last = symbols.filter(F.col("kind") != SENTINEL).groupBy("file_id", F.col("name").alias("parent")).agg(F.max_by("id", F.struct("line_start", "id")).alias("parent_id"))
    return named.join(last, ["file_id", "parent"], "left").select("id", "parent_id")


def prune(snapshots: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The snapshots beyond the first `keep` of each key, which may go."""
    return snapshots.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") > keep).drop("_n")
