"""Text queries over documents and drawer bodies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.functions import udfs as P
from sparrowdex.operators.ledger import running_total
from sparrowdex.plans.binding import bound


#: Lines of a text in SQL.
_L = r"CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(regexp_replace({0}, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\r\z', '')) END"
_W = r"list_filter(regexp_split_to_array({0}, '[ \t\r\n\f]+'), lambda x: x <> '')"
_S = r"regexp_replace({0}, '^[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g')"
_MARKS = T.PUNCTUATION.replace("{", "{{").replace("}", "}}")
_TOKENS = f"len({_W}) + CAST(floor((length({{0}}) - length(translate({{0}}, '{_MARKS}', ''))) / 3) AS BIGINT)"


def _case(x: str, forms) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{f}') THEN '{f}'" for f in forms) + " END"


def _numbered(source: str, text: str, key: str) -> str:
    """Lines with their number and run (islands of equal trimmed or exact lines)."""
    return f"""ln AS (SELECT {key}, unnest({_L.format(text)}) AS line, generate_subscripts({_L.format(text)}, 1) AS n FROM {source})"""


_RUNS = f"""{_numbered('drawers', 'body', 'id')}, tr AS (SELECT id, n, {_S.format('line')} AS line FROM ln),
mk AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY id ORDER BY n) THEN 0 ELSE 1 END AS new FROM tr),
isl AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS g FROM mk),
run AS (SELECT id, g, any_value(line) AS line, count(*) AS k FROM isl GROUP BY id, g HAVING count(*) > 1 AND any_value(line) <> '')"""

_RUNS_MARKED = _RUNS.replace("FROM drawers)", "FROM marked)")

_EXACT = f"""{_numbered('drawers', 'body', 'id')}, mk AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY id ORDER BY n) THEN 0 ELSE 1 END AS new FROM ln)"""


#: What is put behind each body, by its id, so that every rule finds something.
_FOUND = {
    0: "if true {\n}\n  if 0 == 0 { run }",
    1: "// let a = 1;\n   // return b",
    2: "n = x + 0\nk = 1 * x + 1 + 0",
    3: "  \n\t\n \t end",
    4: "again and again\n again and again\nagain and again",
}
def _literal(text: str) -> str:
    """A text as SQL, with control characters by their code."""
    return " || ".join(f"chr({ord(x)})" if x in "\n\t" else f"'{x}'" for x in re.split("([\n\t])", text) if x)


_MARKED = "marked AS (SELECT id, body || chr(10) || CASE id % 5 " + " ".join(f"WHEN {k} THEN {_literal(v)}" for k, v in _FOUND.items()) + " END AS body FROM drawers)"


def _marked(t):
    """Drawers with lines behind their bodies that the rules are about."""
    put = F.create_map(*[F.lit(x) for item in _FOUND.items() for x in item])
    return t.drawers.select("id", F.concat("body", F.lit("\n"), F.element_at(put, (F.col("id") % 5).cast("int"))).alias("body"))


def _line_windows(t):
    """Consecutive equal lines of every drawer as islands of a window over its lines, which scales with the rows of lines."""
    from pyspark.sql import Window

    ln = t.drawers.select("id", F.posexplode(F.transform(T.lines(F.col("body")), T.strip)).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n")
    mark = ln.withColumn("new", F.when(F.col("line") == F.lag("line").over(w), 0).otherwise(1))
    isl = mark.withColumn("g", F.sum("new").over(w))
    return isl.groupBy("id", "g").agg(F.first("line").alias("line"), F.count("*").alias("times")).filter("times > 1 AND line <> ''").select("id", "line", "times")


def _economy(t):
    """Running use of drawers in order of time, by wing, with pressure and ratio."""
    used = running_total(t.drawer.select("id", "wing", "created_at", T.byte_tokens(F.col("body")).alias("tokens")), "wing", ["created_at", "id"], "tokens", "used")
    p = T.pressure(F.col("used"))
    return used.select("id", "used", F.round(p, 6).alias("pressure"), T.ratio(p).alias("ratio"))


_DOC = "doc_id"

QUERIES = {
    "T01_token_count": bound(lambda t: t.documents.select(_DOC, T.token_count(F.col("text")).alias("tokens"))),
    "T02_byte_tokens": bound(lambda t: t.drawers.select("id", T.byte_tokens(F.col("body")).alias("tokens"), (T.byte_tokens(F.col("body")) > 500).alias("above"))),
    "T03_repeated_lines": bound(lambda t: t.drawers.select("id", F.explode(T.repeated_lines(F.col("body"))).alias("r")).select("id", "r.line", F.col("r.n").cast("long").alias("times"))),
    "T03_repeated_tokens": bound(lambda t: _marked(t).select("id", T.repeated_tokens(F.col("body")).alias("saved")).filter("saved > 0")),
    "T04_trivial_conditions": bound(lambda t: _marked(t).select("id", F.explode(T.trivial_conditions(F.col("body"))).alias("condition"))),
    "T05_dead_code": bound(lambda t: _marked(t).select("id", F.explode(T.dead_code(F.col("body"))).alias("line"))),
    "T06_foldable": bound(lambda t: _marked(t).select("id", F.explode(T.foldable(F.col("body"))).alias("expression"))),
    "T07_blank_lines": bound(lambda t: _marked(t).select("id", F.size(T.blank_lines(F.col("body"))).alias("blank")).filter("blank > 0")),
    "T08_drop_blank": bound(lambda t: t.drawers.select("id", F.md5(T.drop_blank(F.col("body"))).alias("md5"))),
    "T08_drop_repeats": bound(lambda t: t.drawers.select("id", F.md5(T.drop_repeats(F.col("body"))).alias("md5"))),
    "T08_drop_dead_code": bound(lambda t: _marked(t).select("id", F.md5(T.drop_dead_code(F.col("body"))).alias("md5"))),
    "T08_limit_blank_runs": bound(lambda t: _marked(t).select("id", F.md5(T.limit_blank_runs(F.col("body"))).alias("md5"))),
    "T08_fold": bound(lambda t: _marked(t).select("id", F.md5(T.fold(F.col("body"))).alias("md5"))),
    "T09_compact": bound(lambda t: _marked(t).withColumn("c", P.compact(1, 0.5)(F.col("body"))).select("id", T.token_count(F.col("body")).alias("before"), T.token_count(F.col("c.text")).alias("after"), F.array_join("c.rules", ",").alias("rules"), F.round("c.disruption", 6).alias("disruption"))),
    "T10_smoothness": bound(lambda t: t.drawers.select("id", T.smoothness(F.col("body"), T.drop_blank(F.col("body"))).alias("s")).select("id", *[F.round(f"s.{n}", 6).alias(n) for n in ("disruption", "readability", "compatibility", "preservation")])),
    "T11_trigram_jaccard": bound(
        lambda t: t.drawers.select("id", "body").alias("a").join(t.drawers.select("id", "body").alias("b"), F.expr("a.id + 1 = b.id"))
        .select(F.col("a.id").alias("id"), F.round(P.trigram_similarity("a.body", "b.body"), 6).alias("similarity")).withColumn("near", F.col("similarity") >= 0.85)
    ),
    "T12_seen": bound(lambda t: t.drawers.groupBy(F.md5("body").alias("hash")).agg(F.count("*").alias("times"), F.min("id").alias("first_id")).filter("times > 1")),
    "T13_head_tail": bound(lambda t: t.drawers.select("id", F.md5(T.head_tail(F.col("body"), 5, 5)).alias("md5"))),
    "T14_error_lines": bound(lambda t: t.drawers.select("id", F.md5(T.error_lines(F.col("body"))).alias("md5"))),
    "T15_squeeze": bound(lambda t: t.drawers.select("id", F.md5(T.squeeze(F.col("body"))).alias("md5"))),
    "T15_squeeze_window": bound(lambda t: t.drawers.select("id", F.md5(T.squeeze(F.col("body"), 20)).alias("md5"))),
    "T16_economy": bound(_economy),
    "T17_entropy_lines": bound(
        lambda t: t.documents.select(_DOC, F.explode(T.lines(F.col("text"))).alias("line")).withColumn("keep", T.entropy(F.col("line")) >= 2.5)
        .groupBy(_DOC).agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))
    ),
    "A13_entropy": bound(lambda t: t.documents.select(_DOC, F.round(T.entropy(F.col("text")), 6).alias("bits"))),
    "T19_cut_bytes": bound(lambda t: t.documents.select(_DOC, T.cut_bytes(F.col("text"), 61).alias("head"))),
    "T20_after_trigger": bound(lambda t: t.documents.select(_DOC, T.after_trigger(F.col("text"), "USER:").alias("rest")).filter("rest IS NOT NULL")),
    "T21_formats": bound(lambda t: t.drawers.select("id", T.compact_number(F.octet_length("body") * 37).alias("size"), T.age(F.col("id") * 97).alias("age"))),
    "T22_storage_key": bound(lambda t: t.files.select("id", T.storage_key(F.substring_index("path", "/", 1), F.when(F.col("id") % 3 > 0, F.col("path"))).alias("key"))),
    "T23_keys": bound(lambda t: t.drawers.select("id", T.idempotency_key(F.col("source_id")).alias("idem"), T.hashtag(F.col("source_id")).alias("tag"))),
    "W03_line_runs": bound(_line_windows),
    "W08_head_tail": bound(lambda t: t.documents.select(_DOC, F.md5(T.head_tail(F.col("text"), 2, 2)).alias("md5"))),
    "S05_jaccard": bound(
        lambda t: t.documents.alias("a").join(t.documents.alias("b"), F.expr("a.doc_id + 1 = b.doc_id"))
        .select(F.col("a.doc_id").alias("doc_id"), F.round(T.jaccard(F.array_distinct(T.words(F.col("a.text"))), F.array_distinct(T.words(F.col("b.text")))), 6).alias("similarity"))
    ),
}

_TRI = "CASE WHEN strlen({0}) < 3 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, strlen({0}) - 1), lambda i: substr(hex(encode({0})), 2 * i - 1, 6))) END"
_MEAN = "CASE WHEN len({0}) > 0 THEN list_sum(list_transform({0}, lambda x: strlen(x))) / len({0}) ELSE 0.0 END"
_ENT = """(SELECT coalesce(-sum(p * log2(p)), 0) FROM (SELECT count(*) / any_value(len(c)) AS p FROM (SELECT unnest(c) AS ch, c) GROUP BY ch))"""
_SQUEEZED = rf"""src AS (SELECT id, body, list_transform(string_split(regexp_replace(body, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '(?s)^.*\r', '')) AS l FROM drawers),
ln AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM src),
mk AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY id ORDER BY n) THEN 0 ELSE 1 END AS new FROM ln),
isl AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS g FROM mk),
run AS (SELECT id, g, any_value(line) AS line, count(*) AS k FROM isl GROUP BY id, g),
told AS (SELECT id, flatten(list(CASE WHEN k > 1 THEN [line, '[repeated ' || k || 'x]'] ELSE [line] END ORDER BY g)) AS l FROM run GROUP BY id)"""
_ERR = "|".join(T.ERROR_MARKS)

SQL = {
    "T01_token_count": f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "T02_byte_tokens": "SELECT id, CAST(strlen(body) // 4 AS BIGINT) AS tokens, strlen(body) // 4 > 500 AS above FROM drawers",
    "T03_repeated_lines": f"WITH {_RUNS} SELECT id, line, k AS times FROM run",
    "T03_repeated_tokens": f"WITH {_MARKED}, {_RUNS_MARKED} SELECT id, CAST(sum(strlen(line) * (k - 1) // 4) AS BIGINT) AS saved FROM run GROUP BY id HAVING saved > 0",
    "T04_trivial_conditions": f"WITH {_MARKED}, {_numbered('marked', 'body', 'id')} SELECT id, {_case(_S.format('line'), T.TRIVIAL_CONDITIONS)} AS condition FROM ln WHERE condition IS NOT NULL",
    "T05_dead_code": f"WITH {_MARKED}, {_numbered('marked', 'body', 'id')}, tr AS (SELECT id, {_S.format('line')} AS line FROM ln) SELECT id, line FROM tr WHERE starts_with(line, '// ') AND ("
    + " OR ".join(f"contains(substr(line, 4), '{w}')" for w in T.CODE_WORDS)
    + ")",
    "T06_foldable": f"WITH {_MARKED}, {_numbered('marked', 'body', 'id')} SELECT id, {_case('line', [a for a, _ in T.FOLDABLE])} AS expression FROM ln WHERE expression IS NOT NULL",
    "T07_blank_lines": rf"WITH {_MARKED}, {_numbered('marked', 'body', 'id')} SELECT id, CAST(count(*) AS INT) AS blank FROM ln WHERE regexp_full_match(line, '[ \t]+') GROUP BY id",
    "T08_drop_blank": f"SELECT id, md5(array_to_string(list_filter({_L.format('body')}, lambda x: {_S.format('x')} <> ''), chr(10))) AS md5 FROM drawers",
    "T08_drop_repeats": f"WITH {_EXACT}, r AS (SELECT id, string_agg(line, chr(10) ORDER BY n) AS s FROM mk WHERE new = 1 GROUP BY id) SELECT d.id, md5(coalesce(r.s, '')) AS md5 FROM drawers d LEFT JOIN r ON r.id = d.id",
    "T08_drop_dead_code": f"""WITH {_MARKED}, {_numbered('marked', 'body', 'id')}, dead AS (SELECT DISTINCT id, {_S.format('line')} AS d FROM ln WHERE starts_with({_S.format('line')}, '// ') AND ("""
    + " OR ".join(f"contains(substr({_S.format('line')}, 4), '{w}')" for w in T.CODE_WORDS)
    + """)), kept AS (SELECT id, string_agg(line, chr(10) ORDER BY n) AS s FROM ln WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.id = ln.id AND contains(ln.line, dead.d)) GROUP BY id)
SELECT m.id, md5(coalesce(kept.s, '')) AS md5 FROM marked m LEFT JOIN kept ON kept.id = m.id""",
    "T08_limit_blank_runs": f"""WITH {_MARKED}, {_numbered('marked', 'body', 'id')}, b AS (SELECT id, n, CASE WHEN {_S.format('line')} = '' THEN '' ELSE line END AS line FROM ln),
r AS (SELECT id, n, line FROM b WINDOW w AS (PARTITION BY id ORDER BY n) QUALIFY NOT (line = '' AND coalesce(lag(line, 1) OVER w, 'x') = '' AND coalesce(lag(line, 2) OVER w, 'x') = ''))
SELECT id, md5(string_agg(line, chr(10) ORDER BY n)) AS md5 FROM r GROUP BY id""",
    "T08_fold": f"WITH {_MARKED} SELECT id, md5(" + "replace(" * len(T.FOLDABLE) + "body" + "".join(f", '{a}', '{b}')" for a, b in T.FOLDABLE) + ") AS md5 FROM marked",
    "T09_compact": f"""WITH {_MARKED}, {_RUNS_MARKED}, f AS (SELECT id, body, {_L.format('body')} AS a, id IN (SELECT id FROM run WHERE strlen(line) * (k - 1) // 4 >= 1) AS rep FROM marked),
g AS (SELECT *, list_transform(a, lambda x: {_S.format('x')}) AS t FROM f),
h AS (SELECT *, len(list_filter(t, lambda x: {" OR ".join(f"contains(x, '{c}')" for c in T.TRIVIAL_CONDITIONS)})) > 0 AS cond, list_filter(t, lambda x: starts_with(x, '// ') AND ({" OR ".join(f"contains(substr(x, 4), '{w}')" for w in T.CODE_WORDS)})) AS dead,
  len(list_filter(a, lambda x: {" OR ".join(f"contains(x, '{c}')" for c, _ in T.FOLDABLE)})) > 0 AS folds, len(list_filter(a, lambda x: regexp_full_match(x, '[ \t]+') AND length(x) >= 4)) > 0 AS blanks FROM g),
o1 AS (SELECT *, CASE WHEN rep THEN array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), chr(10)) ELSE body END AS x1 FROM h),
o2 AS (SELECT *, CASE WHEN len(dead) > 0 THEN array_to_string(list_filter({_L.format('x1')}, lambda x: len(list_filter(dead, lambda d: contains(x, d))) = 0), chr(10)) ELSE x1 END AS x2 FROM o1),
o3 AS (SELECT *, CASE WHEN folds THEN {"replace(" * len(T.FOLDABLE)}x2{"".join(f", '{c}', '{d}')" for c, d in T.FOLDABLE)} ELSE x2 END AS x3 FROM o2),
o4 AS (SELECT *, CASE WHEN blanks THEN array_to_string(list_filter({_L.format('x3')}, lambda x: {_S.format('x')} <> ''), chr(10)) ELSE x3 END AS x4 FROM o3),
o5 AS (SELECT *, {_L.format('x4')} AS b, rep OR cond OR len(dead) > 0 OR folds OR blanks AS hit FROM o4),
o6 AS (SELECT *, CASE WHEN hit THEN 1 - len(list_filter(b, lambda x: list_contains(a, x))) / greatest(len(a), len(b), 1) ELSE 0 END AS far FROM o5),
o7 AS (SELECT id, body, far, hit AND far <= 0.5 AS kept, CASE WHEN far <= 0.5 THEN x4 ELSE body END AS text,
  concat_ws(',', CASE WHEN rep THEN 'repeats' END, CASE WHEN cond THEN 'conditions' END, CASE WHEN len(dead) > 0 THEN 'dead code' END, CASE WHEN folds THEN 'folds' END, CASE WHEN blanks THEN 'blanks' END) AS rules FROM o6)
SELECT id, {_TOKENS.format('body')} AS before, {_TOKENS.format('text')} AS after, CASE WHEN kept THEN rules ELSE '' END AS rules, round(CASE WHEN kept THEN far ELSE 0 END, 6) AS disruption FROM o7""",
    "T10_smoothness": f"""WITH c AS (SELECT id, {_L.format('body')} AS a, array_to_string(list_filter({_L.format('body')}, lambda x: {_S.format('x')} <> ''), chr(10)) AS after FROM drawers),
s AS (SELECT id, a, after, {_L.format('after')} AS b FROM c), m AS (SELECT *, len(list_filter(b, lambda x: list_contains(a, x))) AS common, list_filter(b, lambda x: x <> '') AS fb, {_W.format('after')} AS w FROM s),
v AS (SELECT *, {_MEAN.format('fb')} AS ml, {_MEAN.format('w')} AS mw FROM m)
SELECT id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE 1 - common / greatest(len(a), len(b)) END, 6) AS disruption,
round((greatest(0, least(1, 1 - greatest(ml - 40, 0) / 60)) + CASE WHEN mw < 25 THEN 1.0 ELSE 0.5 END) / 2, 6) AS readability,
CAST(CASE WHEN len(list_filter(a, lambda x: x <> '')) = len(fb) THEN 1.0 ELSE 0.8 END AS DOUBLE) AS compatibility, round(CASE WHEN len(a) = 0 THEN 1 ELSE common / len(a) END, 6) AS preservation FROM v""",
    "T11_trigram_jaccard": """WITH h AS (SELECT id, list_transform(range(1, strlen(body) + 1), lambda i: 0) AS z, string_split(hex(encode(body)), '') AS h FROM drawers),
d AS (SELECT id, CASE WHEN len(z) < 3 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, len(z) - 1), lambda i: h[2 * i - 1] || h[2 * i] || h[2 * i + 1] || h[2 * i + 2] || h[2 * i + 3] || h[2 * i + 4])) END AS t FROM h),
s AS (SELECT a.id, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 6) AS similarity FROM d a JOIN d b ON a.id + 1 = b.id)
SELECT id, similarity, similarity >= 0.85 AS near FROM s""",
    "T12_seen": "SELECT md5(body) AS hash, count(*) AS times, min(id) AS first_id FROM drawers GROUP BY 1 HAVING count(*) > 1",
    "T13_head_tail": f"WITH l AS (SELECT id, body, {_L.format('body')} AS l FROM drawers) SELECT id, md5(CASE WHEN len(l) <= 10 THEN body ELSE array_to_string(list_concat(list_concat(l[1:5], ['... [' || (len(l) - 10) || ' lines omitted] ...']), l[len(l) - 4:]), chr(10)) END) AS md5 FROM l",
    "T14_error_lines": f"WITH l AS (SELECT id, {_L.format('body')} AS l FROM drawers), e AS (SELECT id, l, list_filter(l, lambda x: regexp_matches(x, '{_ERR}')) AS e FROM l) SELECT id, md5(array_to_string(CASE WHEN len(e) > 0 THEN e ELSE l[1:20] END, chr(10))) AS md5 FROM e",
    "T15_squeeze": f"WITH {_SQUEEZED} SELECT s.id, md5(array_to_string(t.l, chr(10)) || CASE WHEN ends_with(s.body, chr(10)) THEN chr(10) ELSE '' END) AS md5 FROM src s JOIN told t ON t.id = s.id",
    "T15_squeeze_window": f"""WITH {_SQUEEZED}, m AS (SELECT id, l, l[11:len(l) - 10] AS mid FROM told), g AS (SELECT *, list_filter(mid, lambda x: regexp_matches(x, '{_ERR}')) AS sig FROM m),
w AS (SELECT id, CASE WHEN len(l) <= 20 THEN l ELSE list_concat(list_concat(list_concat(l[1:10], ['[... ' || len(mid) || ' lines elided; ' || len(sig) || ' error/warning line(s) surfaced ...]']), sig), l[len(l) - 9:]) END AS l FROM g)
SELECT s.id, md5(array_to_string(w.l, chr(10)) || CASE WHEN ends_with(s.body, chr(10)) THEN chr(10) ELSE '' END) AS md5 FROM src s JOIN w ON w.id = s.id""",
    "T16_economy": """WITH u AS (SELECT d.id, CAST(sum(strlen(body) // 4) OVER (PARTITION BY w.name ORDER BY d.created_at, d.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM drawers d JOIN wings w ON w.id = d.wing_id)
SELECT id, used, round(least(1.0, used / 100000.0), 6) AS pressure, CAST(CASE WHEN least(1.0, used / 100000.0) >= 0.8 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS ratio FROM u""",
    "A13_entropy": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2),
s AS (SELECT doc_id, -sum(k / t * log2(k / t)) AS b FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS t FROM n) GROUP BY 1) SELECT d.doc_id, round(coalesce(b, 0), 6) AS bits FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
    "T17_entropy_lines": f"""WITH {_numbered('documents', 'text', 'doc_id')}, c AS (SELECT doc_id, n, unnest(string_split(line, '')) AS ch FROM ln), k AS (SELECT doc_id, n, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL),
e AS (SELECT doc_id, n, -sum(k / t * log2(k / t)) AS b FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id, n) AS t FROM k) GROUP BY 1, 2)
SELECT ln.doc_id, CAST(count_if(coalesce(b, 0) >= 2.5) AS BIGINT) AS kept, CAST(count_if(coalesce(b, 0) < 2.5) AS BIGINT) AS dropped FROM ln LEFT JOIN e ON e.doc_id = ln.doc_id AND e.n = ln.n GROUP BY ln.doc_id""",
    "T19_cut_bytes": "SELECT doc_id, CASE WHEN strlen(text) <= 61 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 62), lambda n: strlen(left(text, n)) <= 61)) AS INT)) END AS head FROM documents",
    "T20_after_trigger": r"SELECT doc_id, regexp_replace(substr(text, 6), '^[ \t\r\n\f]+', '') AS rest FROM documents WHERE starts_with(text, 'USER:')",
    "T21_formats": """WITH v AS (SELECT id, strlen(body) * 37 AS n, id * 97 AS s FROM drawers) SELECT id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN (n * 10 + 500) // 10000 || '.' || (n * 10 + 500) // 1000 % 10 || 'k' ELSE (n * 10 + 500000) // 10000000 || '.' || (n * 10 + 500000) // 1000000 % 10 || 'M' END AS size,
CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age FROM v""",
    "T22_storage_key": r"""WITH s AS (SELECT id, path, regexp_replace(regexp_replace(lower(string_split(path, '/')[1]), '[^a-z0-9_-]', '-', 'g'), '^-+|-+\z', '', 'g') AS s FROM files)
SELECT id, CASE WHEN s = '' THEN 'unknown-repo' ELSE s END || CASE WHEN id % 3 > 0 THEN '-' || left(sha256(path), 6) ELSE '' END AS key FROM s""",
    "T23_keys": "SELECT id, regexp_replace(left(source_id, 128), '[^0-9A-Za-z_:.-]', '', 'g') AS idem, regexp_replace(source_id, '[^0-9A-Za-z_]', '', 'g') AS tag FROM drawers",
    "W03_line_runs": f"WITH {_RUNS} SELECT id, line, k AS times FROM run",
    "W08_head_tail": f"WITH l AS (SELECT doc_id, text, {_L.format('text')} AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 4 THEN text ELSE array_to_string(list_concat(list_concat(l[1:2], ['... [' || (len(l) - 4) || ' lines omitted] ...']), l[len(l) - 1:]), chr(10)) END) AS md5 FROM l",
    "S05_jaccard": f"""WITH w AS (SELECT doc_id, list_distinct({_W.format('text')}) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS similarity FROM w a JOIN w b ON a.doc_id + 1 = b.doc_id""",
}
