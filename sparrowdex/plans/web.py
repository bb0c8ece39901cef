"""URL, HTML, date and proxy queries over pages, documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowdex.functions import udfs as P
from sparrowdex.functions import web as W
from sparrowdex.plans.binding import bound

# Addresses of many forms from the pages' own, so that every branch is met.
_FORMS = """array(url, concat('ftp://', page_id, '.example/x'), concat('http://10.', page_id % 256, '.0.1:80/a'), concat('https://user:pw@172.', page_id % 64, '.1.1/'), concat('http://', 190 + page_id % 4, '.168.0.9'),
 concat('http://[fe80::', page_id % 9, ']:8080/'), concat('http://127.0.0.', page_id % 300, '/'), 'https://LOCALHOST/x', concat('http://a', page_id, '.localhost/'), concat('https://8.8.4.', page_id % 256), 'no scheme', 'http:///path')"""
_FORMS_SQL = """[url, 'ftp://' || page_id || '.example/x', 'http://10.' || page_id % 256 || '.0.1:80/a', 'https://user:pw@172.' || page_id % 64 || '.1.1/', 'http://' || 190 + page_id % 4 || '.168.0.9',
 'http://[fe80::' || page_id % 9 || ']:8080/', 'http://127.0.0.' || page_id % 300 || '/', 'https://LOCALHOST/x', 'http://a' || page_id || '.localhost/', 'https://8.8.4.' || page_id % 256, 'no scheme', 'http:///path']"""
_RULES = ("*.example", "docs.sele.test", ".invalid # all of these", "", "# nothing", "Mipa.TEST")
_PROSE = "concat('See (', url, '), then ', url, '; or https://b.example/', page_id, '.')"
_HTML = "concat('<html><head><TITLE a=b> ', coalesce(title, ''), ' </TITLE></head><body><nav><a href=\"/home#top\">x</a></nav><article>A<article>', coalesce(title, ''), '</article><p><a href=''sub/p.html''>y</a> &amp; <a href=mailto:a@b>m</a></p></article></body></html>')"
_STAMPS = "array(date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'+02:30'\"), date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'-04:00'\"), cast(doc_id as string), 'soon')"
_DELAYS = "array(concat(doc_id % 7, 'h', doc_id % 60, 'm'), concat(doc_id, 's'), concat(doc_id % 3, 'd'), cast(doc_id as string), 'x5', '5', '7h3', '')"


def _allow(t):
    rules = t.pages.sparkSession.createDataFrame([(r,) for r in _RULES], "rule string")
    return W.allowed(t.pages.select("page_id", W.bare_host(F.col("url")).alias("host")), rules).select("page_id", "ok")


def _streaks(t):
    """Users with three errors in a row, and when the third came first: a proxy would be evicted there."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = t.events.select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    own = own.withColumn("g", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w)).filter("bad")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id"))).filter("n = 3")
    return own.groupBy("user_id").agg(F.min("ts").alias("evicted_at"))


QUERIES = {
    "U01_urls": bound(lambda t: t.pages.select("page_id", F.array_join(W.urls(F.expr(_PROSE)), " ").alias("urls"))),
    "U02_url_host": bound(lambda t: t.pages.select("page_id", F.explode(F.expr(_FORMS)).alias("u")).select("page_id", "u", W.url_host(F.col("u")).alias("host"))),
    "U03_safe_url": bound(lambda t: t.pages.select("page_id", F.explode(F.expr(_FORMS)).alias("u")).select("page_id", "u", W.is_safe_url(F.col("u")).alias("safe"))),
    "U04_html_title": bound(lambda t: t.pages.select("page_id", W.html_title(F.expr(_HTML)).alias("title"))),
    "U05_main_element": bound(lambda t: t.pages.select("page_id", P.main_element_of(F.expr(_HTML)).alias("main"))),
    "U06_markdown": bound(lambda t: t.pages.select("page_id", P.markdown_of(F.expr(_HTML)).alias("markdown"))),
    "U07_links": bound(lambda t: t.pages.select("page_id", F.array_join(P.links_of(F.col("url"), F.expr(_HTML)), " ").alias("links"))),
    "U08_thread": bound(
        lambda t: t.documents.select("doc_id", P.thread_of(F.expr(
            "to_json(array(named_struct('data', named_struct('children', array(named_struct('data', named_struct('title', 'T', 'author', source, 'subreddit', lang, 'selftext', text, 'score', doc_id))))), named_struct('data', named_struct('children', array(named_struct('data', named_struct('title', '', 'author', 'b', 'subreddit', '', 'selftext', '', 'score', 1L)))))))"
        )).alias("markdown"))
    ),
    "U09_timestamps": bound(lambda t: t.documents.select("doc_id", F.posexplode(F.expr(_STAMPS)).alias("k", "s")).select("doc_id", "k", W.rfc3339(F.col("s")).alias("epoch"))),
    "U09_delays": bound(lambda t: t.documents.select("doc_id", F.posexplode(F.expr(_DELAYS)).alias("k", "s")).select("doc_id", "k", W.delay_seconds(F.col("s")).alias("seconds"))),
    "U10_evicted": bound(_streaks),
    "U11_allowed": bound(_allow),
    "U12_flat_content": bound(
        lambda t: t.documents.select("doc_id", W.flat_content(F.expr(
            "CASE WHEN doc_id % 2 = 0 THEN to_json(array(named_struct('type', 'text', 'text', source), named_struct('type', 'tool_use', 'text', 'x'), named_struct('type', 'text', 'text', lang))) ELSE substring(to_json(named_struct('t', source)), 6, length(to_json(named_struct('t', source))) - 6) END"
        )).alias("content")).filter("content IS NOT NULL")
    ),
    "T18_diff": bound(lambda t: t.documents.select("doc_id", P.diff_of(F.col("text"), F.regexp_replace("text", "the", "a")).alias("diff"))),
    "T24_fnv1a": bound(lambda t: t.drawers.select("id", P.fnv1a_64(F.col("source_id")).alias("hash"))),
}

_URL_SQL = W.URL.replace("'", "''")
_HOST = r"lower(CASE WHEN starts_with(own, '[') THEN regexp_extract(own, '^\[([^\]]*)\]', 1) ELSE regexp_replace(own, ':[^:]*\z', '') END)"
_HOSTS = rf"form AS (SELECT page_id, unnest({_FORMS_SQL}) AS u FROM pages), auth AS (SELECT *, regexp_replace(regexp_extract(u, '^[^:]*://([^/]*)', 1), '^.*@', '') AS own FROM form), host AS (SELECT page_id, u, {_HOST} AS h FROM auth)"
_OCT = "TRY_CAST(regexp_extract(h, '^(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})\\z', {0}) AS INT)"

SQL = {
    "U01_urls": f"SELECT page_id, array_to_string(CASE WHEN url = 'https://b.example/' || page_id THEN [url] ELSE list_distinct_ordered END, ' ') AS urls FROM (SELECT page_id, url, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(s, '{_URL_SQL}'), lambda x: struct_pack(p := instr(s, x), x := x)))), lambda y: y.x) AS list_distinct_ordered FROM (SELECT page_id, url, 'See (' || url || '), then ' || url || '; or https://b.example/' || page_id || '.' AS s FROM pages))",
    "U02_url_host": rf"SELECT page_id, u, nullif(regexp_extract(u, '^[^:]*://([^/]*)', 1), '') AS host FROM (SELECT page_id, unnest({_FORMS_SQL}) AS u FROM pages)",
    "U03_safe_url": rf"""WITH {_HOSTS}, oct AS (SELECT *, {_OCT.format(1)} AS a, {_OCT.format(2)} AS b, {_OCT.format(3)} AS c, {_OCT.format(4)} AS d FROM host)
SELECT page_id, u, regexp_matches(u, '^https?://') AND h <> '' AND NOT (h IN ('localhost', '0.0.0.0', 'broadcasthost', 'ip6-localhost', 'ip6-loopback', '::1', '::') OR ends_with(h, '.localhost'))
AND NOT coalesce(a < 256 AND b < 256 AND c < 256 AND d < 256 AND (a = 127 OR a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a + b + c + d = 0) OR (a + b + c + d = 1020)), false)
AND NOT regexp_matches(h, '^(f[cd][0-9a-f]{{2}}|fe[89ab][0-9a-f]):') AS safe FROM oct""",
    "U04_html_title": r"SELECT page_id, nullif(regexp_replace(coalesce(title, ''), '^[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g'), '') AS title FROM pages",
    "U05_main_element": """SELECT page_id, 'A<article>' || coalesce(title, '') || '</article><p><a href=''sub/p.html''>y</a> &amp; <a href=mailto:a@b>m</a></p>' AS main FROM pages""",
    "U06_markdown": r"""WITH t AS (SELECT page_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN t = '' THEN '' ELSE t || ' ' END || '[x](/home#top)' || chr(10) || chr(10) || 'A' || CASE WHEN t = '' THEN '' ELSE chr(10) || chr(10) || t END || chr(10) || chr(10) || '[y](sub/p.html) & [m](mailto:a@b)' AS markdown FROM t""",
    "U07_links": r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_replace(url, '[?#].*\z', '') AS own FROM pages)
SELECT page_id, host || '/home ' || CASE WHEN own = host THEN host || '/' ELSE regexp_replace(own, '[^/]*\z', '') END || 'sub/p.html' AS links FROM u""",
    "U08_thread": r"""WITH d AS (SELECT doc_id, coalesce(nullif(source, ''), '?') AS a, coalesce(nullif(lang, ''), '?') AS r, regexp_replace(text, '^\s+|\s+\z', '', 'g') AS t FROM documents)
SELECT doc_id, '**r/' || r || '**  \| u/' || a || ' \| score ' || doc_id || chr(10) || chr(10) || CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END || '---' || chr(10) || chr(10) || '## Top comments' AS markdown FROM d""",
    "U09_timestamps": """WITH s AS (SELECT doc_id, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS e FROM documents)
SELECT doc_id, k, CASE k WHEN 0 THEN e WHEN 1 THEN e - 9000 WHEN 2 THEN e + 14400 WHEN 3 THEN doc_id END AS epoch FROM s, (SELECT CAST(unnest(range(5)) AS INT) AS k)""",
    "U09_delays": """SELECT doc_id, k, CASE k WHEN 0 THEN nullif(doc_id % 7 * 3600 + doc_id % 60 * 60, 0) WHEN 1 THEN nullif(doc_id, 0) WHEN 2 THEN nullif(doc_id % 3 * 86400, 0) WHEN 3 THEN doc_id WHEN 5 THEN 5 END AS seconds
FROM documents, (SELECT CAST(unnest(range(8)) AS INT) AS k)""",
    "U10_evicted": """WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n FROM m WHERE bad) SELECT user_id, min(ts) AS evicted_at FROM n WHERE n = 3 GROUP BY user_id""",
    "U11_allowed": r"""WITH h AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[^:]*://([^/]*)', 1), '^.*@', ''), ':[^:]*\z', ''), '\.+\z', '')) AS h FROM pages)
SELECT page_id, h <> '' AND (h IN ('docs.sele.test', 'mipa.test') OR ends_with(h, '.example') OR h = 'example' OR ends_with(h, '.invalid') OR h = 'invalid') AS ok FROM h""",
    "U12_flat_content": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), source, lang) ELSE source END AS content FROM documents WHERE doc_id % 2 = 0 OR source IS NOT NULL",
    "T24_fnv1a": """WITH b AS (SELECT id, hex(encode(source_id)) AS h FROM drawers),
v AS (SELECT id, list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS HUGEINT))),
  lambda x, y: CAST(((x - x % 256) + xor(CAST(x % 256 AS INT), CAST(y AS INT))) * 1099511628211 % 18446744073709551616 AS HUGEINT)) AS u FROM b)
SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash FROM v""",
}
