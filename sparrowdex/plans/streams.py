"""Streaming twins and file sources and sinks as queries: what goes through a stream or a file comes back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.functions.web import bare_host
from sparrowdex.operators import graph as G
from sparrowdex.plans.binding import Tables, bound
from sparrowdex.plans.usage import SQL as USAGE
from sparrowdex.plans.usage import _LOG, _log
from sparrowdex.plans.web import _RULES as RULES
from sparrowdex.plans.web import SQL as WEB
from sparrowdex.runtime import shared_dir
from sparrowdex.sources import readers, sinks
from sparrowdex.streaming import ledgers


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _through(rows: DataFrame, label: str, mode: str) -> DataFrame:
    """Run a stream over all there is and read its last result from the shared folder."""
    spark, out = rows.sparkSession, _fresh(rows.sparkSession, label)

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("append").parquet(out)

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", _fresh(spark, f"{label}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.read_events(spark, f"{sf_dir}/events.parque[t]", files_per_trigger=64)  # a pattern may also name a single file


def E05_stream_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(ledgers.loop_counts(_events(spark, sf_dir)), "loops", "complete").filter("times >= 15")
    return out.select("event_type", "user_id", "times", F.unix_seconds("last_ts").alias("last_ts"))


def E07_stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(ledgers.rate_limited(_events(spark, sf_dir)), "rate", "append")


def E11_stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(ledgers.windowed_usage(_events(spark, sf_dir)), "usage", "complete")
    return out.select(F.unix_seconds("start").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def E01_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each burst of new rows is one refresh; the number of rows all refreshes saw."""
    out = _fresh(spark, "refresh")
    ledgers.watch(_events(spark, sf_dir), lambda batch, n: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(out), _fresh(spark, "refresh-state")).awaitTermination()
    return spark.read.schema("event_type string, n long").parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


def E13_stream_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of all pages as an egress log, streamed against an allowlist."""
    path = _fresh(spark, "egress")
    Tables(spark, sf_dir).pages.select(F.col("page_id").alias("ts"), bare_host(F.col("url")).alias("host")).write.json(path)
    log = spark.readStream.schema("ts long, host string").json(path)
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return _through(ledgers.egress_verdicts(log, rules), "verdicts", "append").select(F.col("ts").alias("page_id"), "ok")


def SC09_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log written as JSON lines and read again."""
    rows = _log(Tables(spark, sf_dir)).select("ts", "op", F.col("event_id").cast("string").alias("query"), "results", F.lit("repo").alias("repo"), "used_tokens", "saved_tokens", F.lit(None).cast("string").alias("agent_id"))
    path = _fresh(spark, "log")
    readers.append_log(rows, path)
    return readers.read_log(spark, path).select("ts", "op", "query", "results", "used_tokens", "saved_tokens")


def G12_cached_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cached_graph(spark, _fresh(spark, "graph"), lambda: G.call_graph(Tables(spark, sf_dir).edges))


def SC17_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols after three snapshots, of which two are kept, read back from the newest."""
    t, root = Tables(spark, sf_dir), _fresh(spark, "snapshots")
    for stamp in (1, 2, 3):
        sinks.snapshot({"symbols": t.symbols.filter(F.col("file_id") % 3 < stamp), "files": t.files}, root, stamp)
    sinks.prune_snapshots(spark, root, 2)
    newest = sinks.snapshots(spark, root)
    return sinks.restore(spark, root, newest[0], "symbols").select("id", "name", F.lit(len(newest)).alias("kept"))


def E13_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an egress log in three parts, each of which fills it, read from what is left after rotation."""
    path, pages = _fresh(spark, "netlog"), Tables(spark, sf_dir).pages
    for part in range(3):
        sinks.append_rotating(pages.filter(F.col("page_id") % 3 == part).select("page_id", F.lit(part).alias("part")), path, most_bytes=1)
    read = lambda p: spark.read.schema("page_id long, part int").json(p)
    return read(f"{path}.1").unionByName(read(path)).groupBy("part").agg(F.count("*").alias("n"))


def SC16_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as compressed JSON lines and read again."""
    path = _fresh(spark, "hits")
    sinks.write_ndjson(Tables(spark, sf_dir).edges, path, gzip=True)
    return spark.read.schema("src_symbol_id long, dst_symbol_id long, kind string, line int").json(path)


_IGNORE = ("vendor/", "*.md", "!drawer_*.md", "# comment", "/bench")

QUERIES = {f.__name__: f for f in (E01_watch, E05_stream_loops, E07_stream_rate_limit, E11_stream_usage, E13_stream_egress, E13_rotated, SC09_usage_log, SC16_ndjson, SC17_restored, G12_cached_graph)} | {
    "SC01_ignored": bound(lambda t: t.files.select("id", readers.ignored(F.col("path"), _IGNORE).alias("ignored"))),
    "SC03_index_outcomes": bound(lambda t: t.files.groupBy(F.when(readers.ignored(F.col("path"), _IGNORE), "ignored").otherwise("indexed").alias("outcome")).agg(F.count("*").alias("files"))),
    "SC15_fetched": bound(lambda t: readers.fetched(t.pages.select(F.col("page_id").alias("n"), F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/none"))).otherwise(F.col("url")).alias("url")), t.pages).select("n", "url", "status", "title", "error")),
    "SC16_json": bound(lambda t: sinks.as_json(t.symbols.select("id", "name", "line_start"))),
    "SC16_frames": bound(lambda t: sinks.event_frames(t.symbols.select("id", "name"), "hit")),
    "SC16_markdown_rows": bound(lambda t: sinks.as_markdown(t.symbols.select("id", "name", "qualified", "parent_id"))),
}

_OUT = r"(regexp_matches(path, '(?:^|/)\.[^/]') OR CASE WHEN regexp_matches(path, '^/?bench(?:/.*)?\z') THEN true WHEN regexp_matches(path, '(?:^|.*/)drawer_[^/]*\.md(?:/.*)?\z') THEN false WHEN regexp_matches(path, '(?:^|.*/)[^/]*\.md(?:/.*)?\z') THEN true WHEN regexp_matches(path, '(?:^|.*/)vendor(?:/.*)?\z') THEN true ELSE false END)"

SQL = {
    "E01_watch": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "E05_stream_loops": "SELECT event_type, user_id, count(*) AS times, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_ts FROM events GROUP BY 1, 2 HAVING count(*) >= 15",
    "E07_stream_rate_limit": """WITH a AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)
SELECT event_id, user_id, count(*) OVER v AS used, count(*) OVER v <= 5 AS allowed FROM a WINDOW v AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)""",
    "E11_stream_usage": USAGE["E11_daily_usage"],
    "E13_stream_egress": WEB["U11_allowed"],
    "SC09_usage_log": f"WITH {_LOG} SELECT ts, op, CAST(event_id AS VARCHAR) AS query, results, used_tokens, saved_tokens FROM log",
    "G12_cached_graph": "SELECT DISTINCT src_symbol_id AS src, dst_symbol_id AS dst FROM edges WHERE kind = 'call'",
    "SC01_ignored": f"SELECT id, {_OUT} AS ignored FROM files",
    "SC03_index_outcomes": f"SELECT CASE WHEN {_OUT} THEN 'ignored' ELSE 'indexed' END AS outcome, count(*) AS files FROM files GROUP BY 1",
    "SC15_fetched": """WITH p AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, page_id DESC) = 1), r AS (SELECT page_id AS n, CASE WHEN page_id % 5 = 0 THEN url || '/none' ELSE url END AS url FROM pages)
SELECT r.n, r.url, p.status, p.title, CASE WHEN p.url IS NULL THEN 'not fetched' ELSE p.error END AS error FROM r LEFT JOIN p ON p.url = r.url""",
    "SC16_json": """SELECT '{"id":' || id || ',"name":' || to_json(name) || ',"line_start":' || line_start || '}' AS json FROM symbols""",
    "SC16_frames": """SELECT 'event: hit' || chr(10) || 'data: {"id":' || id || ',"name":' || to_json(name) || '}' || chr(10) || chr(10) AS frame FROM symbols""",
    "SC16_ndjson": "SELECT src_symbol_id, dst_symbol_id, kind, line FROM edges",
    "SC17_restored": "SELECT id, name, 2 AS kept FROM symbols",
    "E13_rotated": "SELECT CAST(page_id % 3 AS INT) AS part, count(*) AS n FROM pages WHERE page_id % 3 > 0 GROUP BY 1",
    "SC16_markdown_rows": r"SELECT '| ' || id || ' | ' || replace(coalesce(name, ''), '|', '\|') || ' | ' || replace(coalesce(qualified, ''), '|', '\|') || ' | ' || coalesce(CAST(parent_id AS VARCHAR), '') || ' |' AS line FROM symbols",
}
