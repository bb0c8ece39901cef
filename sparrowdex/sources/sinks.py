"""Sinks: JSON forms, snapshots of state with retention, a cached call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ndjson(rows: DataFrame, path: str, gzip: bool = False) -> None:
    rows.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def as_markdown(rows: DataFrame) -> DataFrame:
    """(line): each row as a line of a Markdown table body; pipes are escaped, nulls are empty."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def event_frames(rows: DataFrame, event: str = "message") -> DataFrame:
    """(frame): each row as a server-sent event."""
    return rows.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*rows.columns)), F.lit("\n\n")).alias("frame"))


def snapshot(tables: dict[str, DataFrame], root: str, stamp: int) -> None:
    """Write every table below root/stamp; a snapshot that exists is not written again."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{stamp}/{name}")


def restore(spark: SparkSession, root: str, stamp: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stamp}/{name}")


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Stamps of the snapshots below a folder, newest first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def prune_snapshots(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all but the newest snapshots; gives the stamps that went."""
    gone = snapshots(spark, root)[keep:]
    for stamp in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{stamp}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cached_graph(spark: SparkSession, path: str, build) -> DataFrame:
    """The call graph stored at a path, else the built one, which is then stored there; one that was not written to its end is built again."""
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_rotating(rows: DataFrame, path: str, most_bytes: int = 4 << 20) -> bool:
    """Append rows to a log folder of JSON lines; one that has reached its size is first moved aside, over the one moved before.

    Gives whether the log was rotated.
    """
    spark = rows.sparkSession
    fs, own = _fs(spark, path)
    full = fs.exists(own) and fs.getContentSummary(own).getLength() >= most_bytes
    if full:
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.1")
        fs.delete(aside, True)
        fs.rename(own, aside)
    rows.write.mode("append").json(path)
    return bool(full)
