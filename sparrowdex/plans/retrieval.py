"""Retrieval queries over drawers, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.functions.text import plain_markdown
from sparrowdex.functions.udfs import embed
from sparrowdex.operators import retrieval as R
from sparrowdex.operators.lookup import lines_at  # noqa: F401
from sparrowdex.plans.binding import DRAWER, Tables, bound

_Q = "compiler thread Prüfung cache thread"
_TERMS = R.query_terms(_Q)


def _asked(t: Tables):
    """The stated set of queries: every vector with an id divisible by 20."""
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _one(t: Tables):
    return t.embeddings.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def _context(t: Tables):
    top = R.ranked(R.bm25(t.drawers, _Q, 8))
    return R.pick_context(top.join(t.drawer.select("id", "source_id", "room", "body"), "id"), 300).select("place", "id", F.octet_length("block").alias("bytes"))


def _modes(t: Tables):
    """The same search under one name of each mode."""
    out = None
    for name in ("text", "KNN", "fusion"):
        got = R.search(R.SearchMode.parse(name), _docs(t), _vectors(t), _Q, _one(t), 10).select(F.lit(name).alias("mode"), "id")
        out = got if out is None else out.unionByName(got)
    return out


def _code_hits(t: Tables):
    """The best code drawers of a query, their source ids taken apart, with the beginning of the body."""
    code = t.drawer.filter("wing = 'code'")
    top = R.ranked(R.bm25(code, "session cache parse", 10)).join(code.select("id", "source_id", "body"), "id")
    part = lambda i: F.regexp_extract("source_id", r"^code:([^#]*)#([^@]*)@(\d+)", i)
    return top.select("rank", "id", part(1).alias("file"), part(2).alias("symbol"), part(3).try_cast("int").alias("line"), F.array_join(F.slice(F.split("body", "\n", -1), 1, 12), "\n").alias("snippet"))


def _bm25_sql(source: str, key: str, text: str, words: list[str]) -> str:
    weights = ", ".join(f"('{w}', {words.count(w)})" for w in dict.fromkeys(words))
    return rf"""t AS (SELECT {key} AS id, list_filter(regexp_split_to_array(translate(lower({text}), '{R.MARKED}', '{R.FOLDED}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM {source}),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), qw AS (SELECT * FROM (VALUES {weights}) v(term, times)),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM qw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * l / a))) AS score
  FROM tf JOIN df USING (term) JOIN qw USING (term), st GROUP BY id)"""


_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DOTS = "list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))"

QUERIES = {
    "R01_dedup": bound(lambda t: R.dedup(t.drawers)),
    "R01_add": bound(lambda t: R.add_documents(t.drawers.filter("id % 2 = 0").select("id", "source_id", "sha256", "body"), t.drawers.filter("id % 2 = 1").select("id", "source_id", "sha256", "body")).select("id")),
    "R02_vector_search": bound(lambda t: R.vector_search(_vectors(t), _asked(t), 10).withColumn("score", F.round("score", 6))),
    "R03_l2_search": bound(lambda t: R.vector_search(_vectors(t), _asked(t), 10, "l2").withColumn("score", F.round("score", 6))),
    "R04_bm25": bound(lambda t: R.bm25(t.drawers, _Q, 50).select("id", F.round("score", 6).alias("score"))),
    "R04_bm25_all": bound(lambda t: R.bm25(_docs(t), _Q).select("id", F.round("score", 6).alias("score"))),
    "R05_overlap": bound(lambda t: R.overlap_score(t.drawers, _Q).select("id", F.round("score", 6).alias("score"))),
    "R06_hybrid": bound(lambda t: R.hybrid(_docs(t), _vectors(t), _Q, _one(t), 20).select("id", F.round("score", 9).alias("score"))),
    "R07_search_modes": bound(_modes),
    "R18_capture": bound(lambda t: R.capture(t.drawers, t.events.select(F.col("event_type").alias("op"), F.col("user_id").cast("string").alias("query")), "events").filter("source_id LIKE 'events:%'").select("source_id", "body")),
    "R08_hash_embedding": bound(lambda t: t.drawers.select("id", F.round(embed(F.coalesce("body", F.lit("")))[0].cast("double"), 5).alias("first"))),
    "R10_quantise": bound(lambda t: t.embeddings.withColumn("c", R.quantise(F.col("embedding"))).select("vec_id", F.round("c.scale", 9).alias("scale"), F.aggregate("c.q", F.lit(0).cast("long"), lambda s, x: s + x).alias("q_sum"), F.round(R.cosine(F.col("embedding"), R.dequantise(F.col("c"))), 4).alias("kept"))),
    "R11_hamming": bound(lambda t: R.vector_search(_vectors(t), _asked(t), 10, "hamming").withColumn("score", F.round("score", 6))),
    "R12_list": bound(lambda t: t.drawer.filter("wing = 'note'").orderBy("id").limit(100).select("id", "wing", "room", "source_id")),
    "R09_embed_once": bound(lambda t: t.drawers.select(F.sha2(F.col("body").cast("binary"), 256).alias("hash"), "body").dropDuplicates(["hash"]).select("hash", F.size(embed(F.coalesce("body", F.lit("")))).alias("dim"))),
    "R12_get": bound(lambda t: t.drawer.join(t.drawer_embeddings.filter("dim = 96").select(F.col("drawer_id").alias("id")), "id", "left_semi").select("id", "wing", "room", "source_id")),
    "R12_count": bound(lambda t: t.drawer.groupBy("wing").agg(F.count("*").alias("n"))),
    "R13_delete": bound(lambda t: R.delete(t.drawer, ids=t.drawers.filter("id % 10 = 3").select("id"), before=1740000000, wing="session").select("id")),
    "R13_cascade": bound(lambda t: t.drawer_embeddings.withColumnRenamed("drawer_id", "id").join(R.delete(t.drawer, before=1740000000, wing="session").select("id"), "id", "left_semi").groupBy("embedding_model").agg(F.count("*").alias("n"))),
    "R14_code_hits": bound(_code_hits),
    "R15_context": bound(lambda t: _context(t).select("place", "id")),
    "R15_blocks": bound(_context),
    "R16_plain_markdown": bound(lambda t: t.pages.select("page_id", plain_markdown(F.col("content_markdown")).alias("text"))),
    "J08_rank_fusion": bound(lambda t: R.fuse([R.ranked(R.bm25(_docs(t), "latency budget", 30)), R.ranked(R.overlap_score(_docs(t), "latency budget", 30))], 20).select("id", F.round("score", 9).alias("score"))),
    "W01_ordinal_rank": bound(lambda t: R.ranked(R.bm25(t.drawers, _Q, 40)).select("id", "rank")),
}

SQL = {
    "R01_dedup": "SELECT id, min(id) OVER (PARTITION BY source_id, sha256(body)) AS kept_id FROM drawers",
    "R01_add": """WITH odd AS (SELECT id FROM drawers WHERE id % 2 = 1 QUALIFY id = min(id) OVER (PARTITION BY source_id, sha256(body)))
SELECT id FROM drawers WHERE id % 2 = 0 UNION ALL SELECT d.id FROM drawers d JOIN odd USING (id) WHERE NOT EXISTS (SELECT 1 FROM drawers e WHERE e.id % 2 = 0 AND e.source_id = d.source_id AND e.sha256 = d.sha256)""",
    "R02_vector_search": f"""WITH {_VEC}, s AS (SELECT q.id AS query_id, v.id, {_DOTS} / (sqrt({_DOTS.replace('v.v), lambda', 'q.v), lambda')}) * sqrt({_DOTS.replace('q.v, v.v', 'v.v, v.v')})) AS s FROM v q, v WHERE q.id % 20 = 0)
SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "R03_l2_search": f"""WITH {_VEC}, s AS (SELECT q.id AS query_id, v.id, greatest(0.0, 1 - list_sum(list_transform(list_zip(v.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2) AS s FROM v q, v WHERE q.id % 20 = 0)
SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "R04_bm25": f"WITH {_bm25_sql('drawers', 'id', 'body', _TERMS)} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 50",
    "R04_bm25_all": f"WITH {_bm25_sql('documents', 'doc_id', 'text', _TERMS)} SELECT id, round(score, 6) AS score FROM bm",
    "R05_overlap": rf"""WITH t AS (SELECT id, regexp_split_to_array(translate(lower(body), '{R.MARKED}', '{R.FOLDED}'), '[^\p{{L}}\p{{N}}]+') AS t FROM drawers),
s AS (SELECT id, ({' + '.join(f"CAST(list_contains(t, '{w}') AS INT)" for w in _TERMS)}) / {len(_TERMS)} AS s FROM t) SELECT id, round(s, 6) AS score FROM s WHERE s > 0""",
    "R06_hybrid": f"""WITH {_bm25_sql('documents', 'doc_id', 'text', _TERMS)}, lex AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 40), {_VEC},
s AS (SELECT v.id, {_DOTS} / (sqrt({_DOTS.replace('v.v), lambda', 'q.v), lambda')}) * sqrt({_DOTS.replace('q.v, v.v', 'v.v, v.v')})) AS s FROM v q, v WHERE q.id = 0),
vec AS (SELECT id, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS r FROM s QUALIFY r <= 40),
f AS (SELECT id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY id) SELECT id, round(CAST(s AS DOUBLE), 9) AS score FROM f ORDER BY round(CAST(s AS DOUBLE), 12) DESC, id LIMIT 20""",
    "R07_search_modes": f"""WITH {_bm25_sql('documents', 'doc_id', 'text', _TERMS)}, lex AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 20), {_VEC},
s AS (SELECT v.id, {_DOTS} / (sqrt({_DOTS.replace('v.v), lambda', 'q.v), lambda')}) * sqrt({_DOTS.replace('q.v, v.v', 'v.v, v.v')})) AS s FROM v q, v WHERE q.id = 0),
vec AS (SELECT id, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS r FROM s QUALIFY r <= 20),
f AS (SELECT id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY id)
SELECT 'text' AS mode, id FROM lex WHERE r <= 10 UNION ALL SELECT 'KNN', id FROM vec WHERE r <= 10 UNION ALL (SELECT 'fusion', id FROM f ORDER BY round(CAST(s AS DOUBLE), 12) DESC, id LIMIT 10)""",
    "R15_context": f"""WITH {DRAWER}, {_bm25_sql('drawers', 'id', 'body', _TERMS)}, top AS (SELECT id, room, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm JOIN drawer USING (id) QUALIFY rank <= 8)
SELECT 1 AS place, id FROM top WHERE rank = 1 UNION ALL (SELECT 2, id FROM top WHERE rank > 1 ORDER BY room IS NOT DISTINCT FROM (SELECT room FROM top WHERE rank = 1), rank LIMIT 1)""",
    "R15_blocks": f"""WITH {DRAWER}, {_bm25_sql('drawers', 'id', 'body', _TERMS)}, top AS (SELECT id, room, source_id, body, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm JOIN drawer USING (id) QUALIFY rank <= 8),
picked AS (SELECT 1 AS place, * FROM top WHERE rank = 1 UNION ALL (SELECT 2, * FROM top WHERE rank > 1 ORDER BY room IS NOT DISTINCT FROM (SELECT room FROM top WHERE rank = 1), rank LIMIT 1)),
head AS (SELECT *, '## ' || source_id || ' (room=' || coalesce(room, '-') || ', score=' || printf('%.2f', score) || ')' || chr(10) AS h, CASE WHEN (SELECT count(*) FROM picked) = 1 THEN 1200 WHEN place = 1 THEN 800 ELSE 400 END AS share FROM picked),
room AS (SELECT *, greatest(share - strlen(h), 0) AS r FROM head),
cut AS (SELECT *, CASE WHEN strlen(body) <= r THEN body ELSE left(body, CAST(list_max(list_filter(range(0, r + 1), lambda n: strlen(left(body, n)) <= r)) AS INT)) END AS b FROM room)
SELECT place, id, CAST(strlen(h) + strlen(b) + CASE WHEN strlen(b) < strlen(body) THEN strlen(chr(10) || '…[truncated]') ELSE 0 END AS INT) AS bytes FROM cut""",
    "R16_plain_markdown": r"""WITH a AS (SELECT page_id, regexp_replace(content_markdown, '!?\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?m)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+)', '', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(x, '(?m)^[ \t]*(?:```|~~~)[^\n]*$', '', 'g') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(x, '\*\*|__|~~|`', '', 'g'), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g') AS x FROM c)
SELECT page_id, regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g') AS text FROM d""",
    "R18_capture": "SELECT DISTINCT 'events:' || event_type AS source_id, event_type || ': ' || user_id AS body FROM events",
    "R10_quantise": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM v),
q AS (SELECT *, list_transform(v, lambda x: greatest(-127, least(127, CAST(round(x / s) AS INT)))) AS q FROM c)
SELECT vec_id, round(s, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS q_sum, round(list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2] * s)) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * s * x * s)))), 4) AS kept FROM q""",
    "R11_hamming": """WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x >= 0) AS b FROM embeddings),
s AS (SELECT q.id AS query_id, v.id, 1 - 2 * list_sum(list_transform(list_zip(v.b, q.b), lambda p: CAST(p[1] <> p[2] AS INT))) / len(v.b) AS s FROM b q, b v WHERE q.id % 20 = 0)
SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "R12_list": f"WITH {DRAWER} SELECT id, wing, room, source_id FROM drawer WHERE wing = 'note' ORDER BY id LIMIT 100",
    "R09_embed_once": "SELECT DISTINCT sha256(body) AS hash, 384 AS dim FROM drawers",
    "R12_get": f"WITH {DRAWER} SELECT id, wing, room, source_id FROM drawer WHERE id IN (SELECT drawer_id FROM drawer_embeddings WHERE dim = 96)",
    "R12_count": f"WITH {DRAWER} SELECT wing, count(*) AS n FROM drawer GROUP BY wing",
    "R13_delete": f"WITH {DRAWER} SELECT id FROM drawer WHERE id % 10 <> 3 AND NOT (wing = 'session' AND created_at < 1740000000)",
    "R13_cascade": f"WITH {DRAWER} SELECT embedding_model, count(*) AS n FROM drawer_embeddings WHERE drawer_id IN (SELECT id FROM drawer WHERE NOT (wing = 'session' AND created_at < 1740000000)) GROUP BY 1",
    "R14_code_hits": rf"""WITH {DRAWER}, code AS (SELECT * FROM drawer WHERE wing = 'code'), {_bm25_sql('code', 'id', 'body', ['session', 'cache', 'parse'])},
top AS (SELECT id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM bm QUALIFY rank <= 10)
SELECT rank, id, regexp_extract(source_id, '^code:([^#]*)#([^@]*)@(\d+)', 1) AS file, regexp_extract(source_id, '^code:([^#]*)#([^@]*)@(\d+)', 2) AS symbol, TRY_CAST(regexp_extract(source_id, '^code:([^#]*)#([^@]*)@(\d+)', 3) AS INT) AS line,
array_to_string(string_split(body, chr(10))[1:12], chr(10)) AS snippet FROM top JOIN code USING (id)""",
    "J08_rank_fusion": rf"""WITH {_bm25_sql('documents', 'doc_id', 'text', ['latency', 'budget'])}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 30),
o AS (SELECT id, (CAST(list_contains(t, 'latency') AS INT) + CAST(list_contains(t, 'budget') AS INT)) / 2 AS s FROM t), b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM o WHERE s > 0 QUALIFY r <= 30),
f AS (SELECT id, CAST(sum(1.0 / (60 + r)) AS DOUBLE) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) SELECT id, round(s, 9) AS score FROM f ORDER BY round(s, 12) DESC, id LIMIT 20""",
    "W01_ordinal_rank": f"WITH {_bm25_sql('drawers', 'id', 'body', _TERMS)} SELECT id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM bm QUALIFY rank <= 40",
}
