"""Usage, audit, ledger and time queries over events, drawers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import ledger as E
from sparrowdex.operators.lookup import latest
from sparrowdex.plans import text as X
from sparrowdex.plans.binding import DRAWER, Tables, bound

_OP = "CASE event_type WHEN 'click' THEN 'sym' WHEN 'view' THEN 'refs' WHEN 'purchase' THEN 'callers' WHEN 'error' THEN 'fuzzy' ELSE 'outline' END"


def _log(t: Tables) -> DataFrame:
    """The events as a usage log: the type stands for the operation, the value for tokens, k for results."""
    own = t.events.select("event_id", "user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts"), F.expr(_OP).alias("op"), F.floor("value").alias("used_tokens"), F.get_json_object("props", "$.k").cast("long").alias("results"))
    return own.withColumn("saved_tokens", E.saved_tokens(F.col("op"), F.col("results"), F.col("used_tokens")))


_LOG = f"""log AS (SELECT *, greatest(0, CASE op WHEN 'sym' THEN 3500 WHEN 'refs' THEN 2000 + 300 * least(results, 100) WHEN 'callers' THEN 2000 + 300 * least(results, 100) WHEN 'outline' THEN 6000 WHEN 'fuzzy' THEN 2500 WHEN 'prefix' THEN 1500 ELSE 0 END - used_tokens) AS saved_tokens
 FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, {_OP} AS op, CAST(floor(value) AS BIGINT) AS used_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS results FROM events))"""


def _now(t: Tables) -> int:
    return t.events.agg(F.max(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))).first()[0] or 0


def _report(t: Tables) -> DataFrame:
    return E.usage_report(_log(t), F.lit(_now(t)))


def _lines(t: Tables) -> DataFrame:
    own = t.drawer.filter("wing = 'session'").select(F.coalesce("session_id", F.lit("-")).alias("session"), F.explode(T.lines(F.col("body"))).alias("line"))
    return own


def _reads(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("session"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts"), F.col("event_id").alias("seq"), F.expr("cast(get_json_object(props, '$.k') % 3 as int)").alias("hash"))


def _runs(t: Tables) -> DataFrame:
    return t.drawer.select(F.col("wing").alias("command"), F.coalesce("room", F.lit("/")).alias("cwd"), F.col("session_id").alias("session"), F.col("created_at").alias("ts"))


def _reminders(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', created_at) + doc_id % 10 * 86400").alias("due_at"), (F.col("doc_id") % 4 == 0).alias("delivered"))


def _mid(t: Tables) -> int:
    return t.documents.agg(F.expr("cast((min(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', created_at)) + max(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', created_at))) / 2 as long)")).first()[0] or 0


def _turns(t: Tables) -> DataFrame:
    parts = F.split("text", "\n\n", -1)
    own = t.documents.filter("source = 'session-turns'").select(F.col("doc_id").alias("conv"), F.posexplode(parts).alias("turn", "part"))
    return own.select("conv", "turn", F.when(F.col("part").startswith("USER: "), "user").when(F.col("part").startswith("ASSISTANT: "), "assistant").otherwise("system").alias("role"), F.regexp_replace("part", r"^(?:USER|ASSISTANT): ", "").alias("text"))


def _saved(t: Tables) -> DataFrame:
    """Tokens that compaction saves in each room, and how readable the results are."""
    smooth = T.smoothness(F.col("body"), T.drop_blank(F.col("body")))
    rows = t.drawer.select("room", (T.token_count(F.col("body")) - T.token_count(T.drop_blank(F.col("body")))).alias("saved"), smooth["readability"].alias("r"))
    return rows.groupBy("room").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"), F.round(F.avg("r"), 6).alias("readability"))


def _agents(t: Tables) -> DataFrame:
    """Users as runs: their last event, an exit code for some, and a process number."""
    last = F.max(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("last_ts")
    own = t.events.groupBy(F.col("user_id").alias("id")).agg(last)
    return own.withColumn("exit_code", F.expr("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 7 = 0 THEN 1 END")).withColumn("pid", F.col("id") % 100)


def _alive(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 100).alias("pid")).filter("pid % 4 <> 1").distinct()


_PROXIES = "# a list\n1.2.3.4:80\n\n  socks5://5.6.7.8:1080 \r\nproxy.example:3128"

QUERIES = {
    "A04_usage_report": bound(_report),
    "A05_saved": bound(lambda t: _log(t).select("event_id", "saved_tokens")),
    "A06_session_audit": bound(lambda t: E.session_audit(_lines(t))),
    "A07_waste": bound(lambda t: E.waste(_lines(t), huge=60)),
    "A08_compaction": bound(_saved),
    "A12_coverage": bound(lambda t: t.rooms.join(t.wings.selectExpr("id AS wing_id", "name AS wing"), "wing_id").join(t.drawers.select(F.col("room_id").alias("id")).distinct().withColumn("done", F.lit(True)), "id", "left").groupBy("wing").agg(F.count("*").alias("rooms"), F.count_if("done").alias("done"))),
    "A14_worst": bound(lambda t: t.drawer.select("wing", F.expr("CASE WHEN sha2(cast(body as binary), 256) <> sha256 THEN 2 WHEN room IS NULL THEN 1 ELSE 0 END").alias("s")).groupBy("wing").agg(F.max("s").alias("worst"))),
    "E02_read_ledger": bound(lambda t: E.read_ledger(_reads(t))),
    "E03_read_modes": bound(lambda t: E.read_modes(_reads(t)).select("seq", "mode")),
    "E04_shell_ledger": bound(lambda t: E.shell_ledger(_runs(t))),
    "E05_loops": bound(lambda t: E.loops(E.read_ledger(_reads(t)), E.shell_ledger(_runs(t)), 15)),
    "E06_due": bound(lambda t: E.poll(_reminders(t), F.lit(_mid(t)))[0]),
    "E06_after_poll": bound(lambda t: E.poll(_reminders(t), F.lit(_mid(t)))[1].groupBy("delivered").agg(F.count("*").alias("n"))),
    "E07_rate_limit": bound(lambda t: E.rate_limit(t.events.select("event_id", F.col("user_id").alias("key"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts"))).select("event_id", "used", "allowed", "left", "reset")),
    "E08_valid_cache": bound(lambda t: E.valid_cache(t.pages.select(F.regexp_replace("url", r"[?#].*\z", "").alias("key"), F.col("fetched_at").alias("created"), (F.col("depth") * 86400 * 90).alias("ttl"), F.col("page_id").alias("seq")), F.lit(t.pages.agg(F.max("fetched_at")).first()[0] or 0)).select("key", "seq")),
    "E09_suppressed": bound(lambda t: E.suppressed(t.events.select("event_id", F.col("user_id").alias("sig"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts"), F.col("value").alias("tokens")), 150).select("event_id", "verdict", "suppressed")),
    "E10_run_states": bound(lambda t: E.run_states(_agents(t), F.lit(_now(t)), 40000, _alive(t)).select("id", "state")),
    "E10_reaped": bound(lambda t: E.reaped(E.run_states(_agents(t), F.lit(_now(t)), 40000, _alive(t))).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") == -1).alias("swept"))),
    "U10_assigned": bound(lambda t: E.assigned_proxies(t.pages.select(F.col("page_id").alias("n")), E.proxy_list(F.lit(_PROXIES), "http"))),
    "E11_daily_usage": bound(lambda t: t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("day"), "event_type", "n", "value")),
    "SC11_turn_pairs": bound(lambda t: E.turn_pairs(_turns(t)).select("conv", "turn", F.md5("body").alias("md5"))),
    "W04_last_seen": bound(lambda t: latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")),
    "W05_recent": bound(lambda t: t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")),
    "W07_role_pairs": bound(lambda t: E.turn_pairs(_turns(t)).groupBy("conv").agg(F.count("*").alias("pairs"))),
}

_LINES = r"""ln AS (SELECT coalesce(session_id, '-') AS session, unnest(CASE WHEN body = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(regexp_replace(body, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\r\z', '')) END) AS line FROM drawer WHERE wing = 'session'),
tk AS (SELECT session, line, CASE WHEN line = '' THEN 0 ELSE greatest(1, strlen(line) // 4) END AS tokens FROM ln)"""
_READS = "reads AS (SELECT event_type AS path, CAST(user_id AS VARCHAR) AS session, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS INT) AS hash FROM events)"
_SHELL = "shell AS (SELECT wing AS command, coalesce(room, '/') AS cwd, coalesce(session_id, '') AS session, count(*) AS run_count, max(created_at) AS last_ts FROM drawer GROUP BY ALL)"
_REM = "rem AS (SELECT doc_id AS id, CAST(floor(epoch(created_at)) AS BIGINT) + doc_id % 10 * 86400 AS due_at, doc_id % 4 = 0 AS delivered FROM documents), mid AS (SELECT (min(CAST(floor(epoch(created_at)) AS BIGINT)) + max(CAST(floor(epoch(created_at)) AS BIGINT))) // 2 AS m FROM documents)"
_TURN = """part AS (SELECT doc_id AS conv, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS turn FROM documents WHERE source = 'session-turns'),
said AS (SELECT conv, turn, CASE WHEN starts_with(p, 'USER: ') THEN 'user' ELSE 'assistant' END AS role, regexp_replace(p, '^(?:USER|ASSISTANT): ', '') AS text FROM part WHERE starts_with(p, 'USER: ') OR starts_with(p, 'ASSISTANT: ')),
g AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM said),
pair AS (SELECT conv, turn, text, (SELECT u.text FROM g u WHERE u.conv = g.conv AND u.g = g.g AND u.role = 'user' ORDER BY u.turn DESC LIMIT 1) AS asked FROM g WHERE role = 'assistant')"""
_S = r"regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g')"

_ROOMS = rf"""a AS (SELECT room, body, {X._L.format("body")} AS a FROM drawer), b AS (SELECT room, body, array_to_string(list_filter(a, lambda x: {_S} <> ''), chr(10)) AS after FROM a),
c AS (SELECT room, {X._TOKENS.format("body")} - ({X._TOKENS.format("after")}) AS saved, list_filter({X._L.format("after")}, lambda x: x <> '') AS fb, {X._W.format("after")} AS w FROM b),
v AS (SELECT room, saved, {X._MEAN.format("fb")} AS ml, {X._MEAN.format("w")} AS mw FROM c)"""

_STATE = """r AS (SELECT user_id AS id, CAST(floor(epoch(max(ts))) AS BIGINT) AS l, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 7 = 0 THEN 1 END AS x FROM events GROUP BY user_id),
st AS (SELECT id, CASE WHEN x = 0 THEN 'finished' WHEN x IS NOT NULL THEN 'crashed' WHEN id % 100 % 4 = 1 THEN 'zombie' WHEN (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events) - l > 40000 THEN 'stuck' ELSE 'running' END AS state FROM r)"""

SQL = {
    "A08_compaction": f"WITH {DRAWER}, {_ROOMS} SELECT room, count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved, round(avg((greatest(0, least(1, 1 - greatest(ml - 40, 0) / 60)) + CASE WHEN mw < 25 THEN 1.0 ELSE 0.5 END) / 2), 6) AS readability FROM v GROUP BY room",
    "A04_usage_report": f"""WITH {_LOG}, now AS (SELECT max(ts) AS m FROM log), b AS (
SELECT 'all_time' AS bucket, NULL AS op, * EXCLUDE (op) FROM log UNION ALL SELECT 'by_op', op, * EXCLUDE (op) FROM log UNION ALL SELECT 'last_24h', NULL, * EXCLUDE (op) FROM log WHERE ts >= (SELECT m - 86400 FROM now) UNION ALL SELECT 'session', NULL, * EXCLUDE (op) FROM log WHERE ts >= (SELECT m - 1800 FROM now))
SELECT bucket, op, count(*) AS queries, CAST(sum(used_tokens) AS BIGINT) AS used_tokens, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM b GROUP BY bucket, op""",
    "A05_saved": f"WITH {_LOG} SELECT event_id, saved_tokens FROM log",
    "A06_session_audit": f"WITH {DRAWER}, {_LINES} SELECT session, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM tk GROUP BY session",
    "A07_waste": f"""WITH {DRAWER}, {_LINES} SELECT session, 'huge_tool_output' AS kind, CAST(tokens AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS times FROM tk WHERE tokens > 60
UNION ALL SELECT session, 'duplicate_read', CAST(any_value(tokens) * (count(*) - 1) AS BIGINT), count(*) FROM tk GROUP BY session, line HAVING count(*) >= 3""",
    "A12_coverage": "SELECT w.name AS wing, count(*) AS rooms, count(*) FILTER (WHERE r.id IN (SELECT room_id FROM drawers)) AS done FROM rooms r JOIN wings w ON w.id = r.wing_id GROUP BY 1",
    "A14_worst": f"WITH {DRAWER} SELECT wing, max(CASE WHEN sha256(body) <> drawer.sha256 THEN 2 WHEN room IS NULL THEN 1 ELSE 0 END) AS worst FROM drawer GROUP BY wing",
    "E02_read_ledger": f"WITH {_READS} SELECT path, session, count(*) AS read_count, arg_max(hash, (ts, seq)) AS hash, max(ts) AS last_ts FROM reads GROUP BY path, session",
    "E03_read_modes": f"WITH {_READS}, l AS (SELECT seq, hash, lag(hash) OVER (PARTITION BY path, session ORDER BY ts, seq) AS b FROM reads) SELECT seq, CASE WHEN b IS NULL THEN 'full' WHEN b = hash THEN 'stub' ELSE 'diff' END AS mode FROM l",
    "E04_shell_ledger": f"WITH {DRAWER}, {_SHELL} SELECT command, cwd, session, run_count, last_ts FROM shell",
    "E05_loops": f"""WITH {DRAWER}, {_SHELL}, {_READS} SELECT 'read' AS kind, path AS what, session, count(*) AS times, max(ts) AS last_ts FROM reads GROUP BY path, session HAVING count(*) >= 15
UNION ALL SELECT 'shell', command, session, run_count, last_ts FROM shell WHERE run_count >= 15""",
    "E06_due": f"WITH {_REM} SELECT id, due_at, delivered FROM rem, mid WHERE due_at <= m AND NOT delivered",
    "E06_after_poll": f"WITH {_REM} SELECT delivered OR due_at <= m AS delivered, count(*) AS n FROM rem, mid GROUP BY 1",
    "E07_rate_limit": """WITH a AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
w AS (SELECT event_id, ts, count(*) OVER v AS used, min(ts) OVER v AS o FROM a WINDOW v AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW))
SELECT event_id, used, used <= 5 AS allowed, greatest(0, 5 - used) AS left, 172800 - (ts - o) AS reset FROM w""",
    "E08_valid_cache": r"""WITH c AS (SELECT regexp_replace(url, '[?#].*\z', '') AS key, page_id AS seq, fetched_at, depth * 7776000 AS ttl FROM pages QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, page_id DESC) = 1)
SELECT key, seq FROM c WHERE fetched_at + ttl > (SELECT max(fetched_at) FROM pages)""",
    "E09_suppressed": """WITH a AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value > 150 AS bad FROM events)
SELECT event_id, CASE WHEN bad THEN 'meta_error' ELSE 'helped' END AS verdict, coalesce(bool_or(bad) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING), false) AS suppressed FROM a""",
    "E10_run_states": f"WITH {_STATE} SELECT id, state FROM st",
    "E10_reaped": f"WITH {_STATE} SELECT CASE state WHEN 'zombie' THEN 'crashed' ELSE state END AS state, count(*) AS n, count(*) FILTER (WHERE state = 'zombie') AS swept FROM st GROUP BY 1",
    "U10_assigned": "SELECT page_id AS n, ['http://1.2.3.4:80', 'socks5://5.6.7.8:1080', 'http://proxy.example:3128'][page_id % 3 + 1] AS proxy FROM pages",
    "E11_daily_usage": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "SC11_turn_pairs": f"WITH {_TURN} SELECT conv, CAST(turn AS INT) AS turn, md5(left('USER: ' || coalesce(asked, '') || chr(10) || chr(10) || 'ASSISTANT: ' || text, 65536)) AS md5 FROM pair",
    "W04_last_seen": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "W05_recent": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "W07_role_pairs": f"WITH {_TURN} SELECT conv, count(*) AS pairs FROM pair GROUP BY conv",
}
