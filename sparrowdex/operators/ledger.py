"""Usage reports, audits, ledgers and other keyed state over time, as batch plans.

"Now" is always a value of the caller, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.functions.text import line_tokens
from sparrowdex.runtime import cut, partitions_for

# Estimated tokens by operation, and per result up to a hundred results.
FLAT = {"sym": 3500, "refs": 2000, "callers": 2000, "outline": 6000, "fuzzy": 2500, "prefix": 1500}
PER_RESULT = {"refs": 300, "callers": 300}


def saved_tokens(op: Column, results: Column, used: Column) -> Column:
    """Estimate of the tokens an answer saved; never below 0."""
    flat, per = F.lit(0), F.lit(0)
    for name, n in FLAT.items():
        flat = F.when(op == name, n).otherwise(flat)
    for name, n in PER_RESULT.items():
        per = F.when(op == name, n).otherwise(per)
    return F.greatest(F.lit(0), flat + per * F.least(results, F.lit(100)) - used)


def usage_report(log: DataFrame, now: Column, session: int = 1800, day: int = 86400) -> DataFrame:
    """(bucket, op, queries, used_tokens, saved_tokens): all time, the last day, the session, and each operation.

    log: (ts seconds, op, used_tokens, saved_tokens).  One pass: the buckets are
    grouping sets over flags.
    """
    own = log.withColumn("age", now - F.col("ts"))
    tagged = own.select("op", "used_tokens", "saved_tokens", F.explode(F.filter(F.array(F.lit("all_time"), F.lit("by_op"), F.when(F.col("age") <= day, "last_24h"), F.when(F.col("age") <= session, "session")), lambda x: x.isNotNull())).alias("bucket"))
    tagged = tagged.withColumn("op", F.when(F.col("bucket") == "by_op", F.col("op")))
    return tagged.groupBy("bucket", "op").agg(F.count("*").alias("queries"), F.sum("used_tokens").alias("used_tokens"), F.sum("saved_tokens").alias("saved_tokens"))


def session_audit(lines: DataFrame) -> DataFrame:
    """(session, messages, tokens) of lines(session, line)."""
    return lines.groupBy("session").agg(F.count("*").alias("messages"), F.sum(line_tokens(F.col("line"))).alias("tokens"))


def waste(lines: DataFrame, huge: int = 10_000, repeats: int = 3) -> DataFrame:
    """(session, kind, tokens, times): lines of more than `huge` tokens, and lines said `repeats` times or more with the tokens of their repetition."""
    t = lines.withColumn("tokens", line_tokens(F.col("line")))
    big = t.filter(F.col("tokens") > huge).select("session", F.lit("huge_tool_output").alias("kind"), "tokens", F.lit(1).cast("long").alias("times"))
    again = t.groupBy("session", "line").agg(F.count("*").alias("times"), F.first("tokens").alias("tokens")).filter(F.col("times") >= repeats)
    return big.unionByName(again.select("session", F.lit("duplicate_read").alias("kind"), (F.col("tokens") * (F.col("times") - 1)).alias("tokens"), "times"))


def read_ledger(reads: DataFrame) -> DataFrame:
    """(path, session, read_count, hash, last_ts) of reads(path, session, ts, seq, hash): the last hash counts."""
    return reads.groupBy("path", F.coalesce("session", F.lit("")).alias("session")).agg(F.count("*").alias("read_count"), F.max_by("hash", F.struct("ts", "seq")).alias("hash"), F.max("ts").alias("last_ts"))


def read_modes(reads: DataFrame) -> DataFrame:
    """reads with mode: full for a first read of a path in a session, stub for an unchanged one, diff for a changed one."""
    before = F.lag("hash").over(Window.partitionBy("path", "session").orderBy("ts", "seq"))
    return reads.withColumn("mode", F.when(before.isNull(), "full").when(before == F.col("hash"), "stub").otherwise("diff"))


def shell_ledger(runs: DataFrame) -> DataFrame:
    """(command, cwd, session, run_count, last_ts); a null session is ''."""
    return runs.groupBy("command", "cwd", F.coalesce("session", F.lit("")).alias("session")).agg(F.count("*").alias("run_count"), F.max("ts").alias("last_ts"))


def loops(reads: DataFrame, shells: DataFrame, threshold: int = 5, session: str | None = None) -> DataFrame:
    """(kind, what, session, times, last_ts): ledger rows seen at least `threshold` times."""
    a = reads.select(F.lit("read").alias("kind"), F.col("path").alias("what"), "session", F.col("read_count").alias("times"), "last_ts")
    b = shells.select(F.lit("shell").alias("kind"), F.col("command").alias("what"), "session", F.col("run_count").alias("times"), "last_ts")
    out = a.unionByName(b).filter(F.col("times") >= threshold)
    return out if session is None else out.filter(F.col("session") == session)


def poll(reminders: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Due reminders (due_at, id, delivered, ...) in order, and the table after their delivery."""
    due = (F.col("due_at") <= now) & ~F.col("delivered")
    return reminders.filter(due).orderBy("due_at", "id"), reminders.withColumn("delivered", F.col("delivered") | due)


def _by_window(rows: DataFrame, key: str, window: int) -> DataFrame:
    """Rows dealt to (key, _b): every row of a stretch of `window` seconds, with `_own`, and those of the stretch before.

    A sliding window that ends in a stretch lies within these, so that a hot key is
    as many groups as it has stretches of time.
    """
    b = F.floor(F.col("ts") / window)
    own = rows.withColumn("_b", b).withColumn("_own", F.lit(True))
    return own.unionByName(rows.withColumn("_b", b + 1).withColumn("_own", F.lit(False)))


def rate_limit(attempts: DataFrame, limit: int = 5, window: int = 48 * 3600) -> DataFrame:
    """attempts(key, ts seconds) with used, allowed, left and reset (seconds until the oldest in the window leaves it)."""
    w = Window.partitionBy("key", "_b").orderBy("ts").rangeBetween(-window, 0)
    out = _by_window(attempts, "key", window).withColumn("used", F.count("*").over(w)).withColumn("oldest", F.min("ts").over(w)).filter("_own").drop("_b", "_own")
    return out.withColumn("allowed", F.col("used") <= limit).withColumn("left", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("reset", window - (F.col("ts") - F.col("oldest"))).drop("oldest")


def valid_cache(entries: DataFrame, now: Column) -> DataFrame:
    """The last entry of each key (key, created, ttl, seq, ...), if it still lives: created + ttl is after now."""
    w = Window.partitionBy("key").orderBy(F.desc("created"), F.desc("seq"))
    return entries.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & (F.col("created") + F.col("ttl") > now)).drop("_n")


def suppressed(measured: DataFrame, budget: float, window: int = 7 * 86400) -> DataFrame:
    """measured(sig, ts seconds, tokens) with verdict and suppressed: a measurement of the signature over budget within the window before."""
    w = Window.partitionBy("sig", "_b").orderBy("ts").rangeBetween(-window, -1)
    bad = F.col("tokens") > budget
    out = _by_window(measured, "sig", window).withColumn("verdict", F.when(bad, "meta_error").otherwise("helped")).withColumn("suppressed", F.coalesce(F.max(bad).over(w), F.lit(False)))
    return out.filter("_own").drop("_b", "_own")


def running_total(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the running sum of a value within each key, in an order that ends with a unique column.

    Rows are dealt by ranges of (key, order); a range sums its own rows, and the
    sums of a key's earlier ranges are added, so that a hot key is many tasks.
    """
    slots = cut(rows.repartitionByRange(partitions_for(rows), key, *order).withColumn("_slot", F.spark_partition_id()))
    whole = slots.groupBy(key, "_slot").agg(F.sum(value).alias("_s"))
    before = whole.select(key, "_slot", F.sum("_s").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = slots.withColumn(name, F.sum(value).over(Window.partitionBy("_slot", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = (own[key].eqNullSafe(before[key])) & (own["_slot"] == before["_slot"])
    out = own.join(before, same, "left").select(*[own[c] for c in own.columns], "_before")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_slot", "_before")


def run_states(runs: DataFrame, now: Column, idle: int = 1800, alive: DataFrame | None = None) -> DataFrame:
    """runs(id, last_ts, exit_code[, pid]) with state: finished, crashed, running, zombie or stuck.

    A run without an exit code whose pid is not among alive(pid) is a zombie, a run
    that is idle for too long is stuck; without `alive` no run is a zombie.
    """
    own = runs.withColumn("_here", F.lit(True))
    if alive is not None:
        own = runs.join(alive.select("pid").distinct().withColumn("_here", F.lit(True)), "pid", "left")
    state = F.when(F.col("exit_code") == 0, "finished").when(F.col("exit_code").isNotNull(), "crashed").when(F.col("_here").isNull(), "zombie").when(now - F.col("last_ts") > idle, "stuck").otherwise("running")
    return own.withColumn("state", state).drop("_here")


def reaped(states: DataFrame) -> DataFrame:
    """Runs after a sweep: zombies count as crashed, with exit code -1."""
    dead = F.col("state") == "zombie"
    return states.withColumn("exit_code", F.when(dead, -1).otherwise(F.col("exit_code"))).withColumn("state", F.when(dead, "crashed").otherwise(F.col("state")))


def turn_pairs(turns: DataFrame, cap: int = 65536) -> DataFrame:
    """(conv, turn, body): each assistant turn with the last user turn since the assistant turn before.

    turns: (conv, turn, role, text).  A later user turn replaces an unanswered
    one, an assistant turn without a user turn has an empty one; bodies are cut
    at `cap` characters.
    """
    w = Window.partitionBy("conv").orderBy("turn")
    said = turns.filter(F.col("role").isin("user", "assistant")).withColumn("g", F.sum((F.col("role") == "assistant").cast("int")).over(w) - (F.col("role") == "assistant").cast("int"))
    in_group = Window.partitionBy("conv", "g").orderBy("turn")
    user = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(in_group)
    pairs = said.withColumn("user", user).filter("role = 'assistant'")
    return pairs.select("conv", "turn", F.substring(F.concat(F.lit("USER: "), F.coalesce("user", F.lit("")), F.lit("\n\nASSISTANT: "), F.coalesce("text", F.lit(""))), 1, cap).alias("body"))


def proxies_left(results: DataFrame, most: int = 3) -> DataFrame:
    """(proxy) of results(proxy, ts, seq, ok) that never failed `most` times in a row."""
    w = Window.partitionBy("proxy").orderBy("ts", "seq")
    own = results.withColumn("g", F.sum(F.col("ok").cast("int")).over(w))
    worst = own.filter(~F.col("ok")).groupBy("proxy", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
    return results.select("proxy").distinct().join(worst.select("proxy"), "proxy", "left_anti")


def proxy_list(body: Column, scheme: str) -> Column:
    """Proxies of a list in text form: trimmed lines that are neither blank nor comments, with the scheme where they have none."""
    rows = F.filter(F.transform(F.split(body, r"\r?\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]+|[ \t]+\z", ""))), lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(rows, lambda x: F.when(x.contains("://"), x).otherwise(F.concat(F.lit(f"{scheme}://"), x)))


def assigned_proxies(fetches: DataFrame, proxies: Column | list[str]) -> DataFrame:
    """fetches(n from 0) with proxy: the live ones in turn; null where none is left."""
    pool = proxies if isinstance(proxies, Column) else F.array(*[F.lit(p) for p in proxies]).cast("array<string>")
    return fetches.withColumn("proxy", F.when(F.size(pool) > 0, F.get(pool, (F.col("n") % F.greatest(F.size(pool), F.lit(1))).cast("int"))))
