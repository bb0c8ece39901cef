"""Structured Streaming twins of the ledgers, limits and reports.

Each takes a streaming DataFrame of events(event_id, ts timestamp, user_id,
event_type, value) and gives the rows its batch twin gives once the stream has
been read to its end.  Watermarks bound the state; later rows fall away.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparrowdex.functions.web import allow_rules, is_allowed
from sparrowdex.runtime import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files that arrive in a folder, with ts as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): tumbling or sliding usage."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def loop_counts(events: DataFrame) -> DataFrame:
    """(event_type, user_id, times, last_ts), kept up to date; those of a threshold are filtered where the table is read."""
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("times"), F.max("ts").alias("last_ts"))


def session_reads(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions that a gap parts."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rate_limited(events: DataFrame, limit: int = 5, window: int = 48 * 3600, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, used, allowed): attempts of the last hours of each user, in order of time within a batch.

    State holds the times within the window of each user, no more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        used = []
        for t in rows["sec"].tolist():
            past = [p for p in past if p >= t - window]
            past.append(t)
            used.append(len(past))
        # rows of one second count together, as in the batch window
        rows["used"] = used
        rows["used"] = rows.groupby("sec")["used"].transform("max")
        state.update((past,))
        state.setTimeoutTimestamp(max(int((past[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "used": rows["used"], "allowed": rows["used"] <= limit})

    own = events.withWatermark("ts", late).select("event_id", "user_id", "ts", F.unix_seconds("ts").alias("sec"))
    return own.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, used long, allowed boolean", "past array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(rows: DataFrame, sink: str, mode: str = "append") -> None:
    """Read all that is there into an in-memory table named `sink`, then stop."""
    spark = rows.sparkSession
    query = rows.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/stream-{sink}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()


def watch(rows: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call `refresh` with what is new, at most once an interval (a burst of changes is one call), else once for all there is."""
    writer = rows.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deliver_once(reminders: DataFrame, now: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Append due reminders (id, due_at, message) to a folder, one file set a batch, so that a retried batch replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.filter(F.col("due_at") <= now).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return watch(reminders, put, checkpoint)


def egress_verdicts(log: DataFrame, rules: DataFrame) -> DataFrame:
    """(ts, host, ok) of a streamed egress log (ts, host) against an allowlist that is read as a static table."""
    own = allow_rules(rules).collect()  # the entries of one allowlist
    ok = is_allowed(F.col("host"), [r["key"] for r in own if not r["wild"]], [r["key"] for r in own if r["wild"]])
    return log.select("ts", "host", ok.alias("ok"))
