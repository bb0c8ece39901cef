"""Scan, snapshot and maintenance queries over files, symbols, documents and drawers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.operators import cdc as C
from sparrowdex.operators.lookup import code_chunks, latest, real
from sparrowdex.plans.binding import DRAWER, SYM, Tables, bound
from sparrowdex.sources import formats, readers


def _old(t: Tables) -> DataFrame:
    return C.current(t.files.filter("lang <> '_unresolved'"))


def _new(t: Tables) -> DataFrame:
    """A later state of the files: an eleventh gone, a third touched, a sixth with other content, a seventeenth as new paths too."""
    own = _old(t).filter("id % 11 <> 0")
    kept = own.withColumn("mtime", F.expr("CASE WHEN id % 3 = 0 THEN mtime + 1 ELSE mtime END")).withColumn("sha256", F.expr("CASE WHEN id % 6 = 0 THEN md5(sha256) ELSE sha256 END"))
    return kept.unionByName(own.filter("id % 17 = 0").withColumn("path", F.concat("path", F.lit(".copy"))).withColumn("id", F.col("id") + 1_000_000))


_STATES = """old AS (SELECT * FROM files WHERE lang <> '_unresolved' QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) = 1),
new AS (SELECT id, path, CASE WHEN id % 6 = 0 THEN md5(sha256) ELSE sha256 END AS sha256, CASE WHEN id % 3 = 0 THEN mtime + 1 ELSE mtime END AS mtime, lang, indexed_at FROM old WHERE id % 11 <> 0
 UNION ALL SELECT id + 1000000, path || '.copy', sha256, mtime, lang, indexed_at FROM old WHERE id % 11 <> 0 AND id % 17 = 0)"""


def _named_edges(t: Tables) -> DataFrame:
    src = t.symbols.selectExpr("id AS src_symbol_id", "name AS src_name", "file_id AS src_file_id")
    dst = t.symbols.selectExpr("id AS dst_symbol_id", "name AS dst_name")
    return t.edges.join(src, "src_symbol_id").join(dst, "dst_symbol_id").select("src_file_id", "src_name", "dst_name", "kind", "line")


_RESOLVED = """named AS (SELECT s.file_id AS src_file_id, s.name AS src_name, d.name AS dst_name, e.kind, e.line FROM edges e JOIN symbols s ON s.id = e.src_symbol_id JOIN symbols d ON d.id = e.dst_symbol_id),
src AS (SELECT file_id, name, min(id) AS id FROM symbols GROUP BY ALL), dst AS (SELECT name, min(id) AS id FROM symbols WHERE kind <> 'sentinel' GROUP BY name),
res AS (SELECT DISTINCT src.id AS src_symbol_id, dst.id AS dst_symbol_id, n.dst_name, n.kind, n.line FROM named n JOIN src ON src.file_id = n.src_file_id AND src.name = n.src_name LEFT JOIN dst ON dst.name = n.dst_name)"""


def _replaced(t: Tables) -> DataFrame:
    """Symbols after files that were read again: those of every seventh file are replaced by their functions alone."""
    new = t.symbols.filter("file_id % 7 = 0 AND kind = 'function'").select("id", "file_id", "name")
    return C.replace_partition(t.symbols.select("id", "file_id", "name"), new.unionByName(t.symbols.filter("file_id % 7 = 0").limit(0).select("id", "file_id", "name")), "file_id")


def _deleted(t: Tables) -> DataFrame:
    f, s, e = C.delete_files(t.files, t.symbols, t.edges, t.files.filter("indexed_at < mtime").select("id"))
    return f.agg(F.count("*").alias("files")).crossJoin(s.agg(F.count("*").alias("symbols"))).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each


def _parents(t: Tables) -> DataFrame:
    return C.resolve_parents(real(t.sym).filter("parent IS NOT NULL").select("id", "file_id", "parent"), t.symbols)


def _data_symbols(t: Tables) -> DataFrame:
    """Every file as a CSV table, a YAML mapping or a Markdown text with its id in the names."""
    text = """CASE id % 3 WHEN 0 THEN concat('id,"a ""q"", ', id, '" ,\\n1,2,3') WHEN 1 THEN concat('name: x\\njobs:\\n  build_', id, ':\\n    steps: 1\\n# c: 1\\n"k ', id, '": 2') ELSE concat('# One ', id, ' #\\n\\nTwo\\n---\\n#### Three\\n```\\n') END"""
    rows = t.files.select(F.col("id").cast("string").alias("path"), F.expr("element_at(array('csv', 'yaml', 'markdown'), cast(id % 3 + 1 as int))").alias("lang"), F.expr(text).alias("text"))
    return formats.data_symbols(rows)


def _chunks(t: Tables) -> DataFrame:
    """A chunk of every symbol, whose file's text is the document of the same number."""
    own = real(t.symbols).withColumn("file", F.col("file_id").cast("string"))
    return code_chunks(own, t.documents.select(F.col("doc_id").cast("string").alias("file"), "text")).select("source_id", F.md5("body").alias("md5"), F.length("body").alias("chars"))


QUERIES = {
    "SC02_languages": bound(lambda t: t.files.select("id", C.detect_language(F.col("path")).alias("lang"))),
    "SC04_refresh_delta": bound(lambda t: C.refresh_delta(_old(t), _new(t))),
    "SC05_upsert": bound(lambda t: C.upsert(_old(t), _new(t), ["path"]).select("id", "path", "sha256", "mtime")),
    "SC05_current": bound(lambda t: C.current(t.files).select("id", "path")),
    "SC06_replace_symbols": bound(_replaced),
    "SC06_delete_files": bound(_deleted),
    "SC07_symbol_scan": bound(lambda t: real(t.sym).select("id", "file", "name", "kind", "parent")),
    "SC07_names": bound(lambda t: real(t.symbols).select("name", "kind").distinct()),
    "SC08_files": bound(lambda t: t.files.filter("lang = 'rust' AND path LIKE 't%' AND path LIKE '%.rs'").select("path").distinct().orderBy("path").limit(30)),
    "SC12_chunks": bound(_chunks),
    "SC13_data_symbols": bound(_data_symbols),
    "SC13_headings": bound(lambda t: formats.markdown_headings(t.pages, "page_id", "content_markdown")),
    "SC14_stats": bound(lambda t: t.lineitem.select("l_quantity", "l_extendedprice", "l_discount").unpivot([], ["l_quantity", "l_extendedprice", "l_discount"], "field", "value").groupBy("field").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))),
    "SC14_sample": bound(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").orderBy(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey")),
    "SC17_prune": bound(lambda t: C.prune(t.files.withColumn("repo", F.substring_index("path", "/", 1)), ["repo"], [F.desc("mtime"), F.desc("id")], 5).select("repo", "id")),
    "A09_signature_stats": bound(lambda t: t.symbols.agg(F.count_if(F.col("signature_enc") == 1).alias("encoded"), F.count_if((F.col("signature_enc") == 0) & F.col("signature").isNotNull()).alias("plain"), F.count_if(F.col("signature").isNull()).alias("missing"), F.sum(F.octet_length("signature")).alias("bytes"))),
    "SC10_text_documents": bound(lambda t: readers.text_documents(t.drawers.select("source_id", F.col("body").cast("binary").alias("content")))),
    "SC18_codec_stats": bound(lambda t: t.symbols.select(F.explode(F.array(F.struct(F.lit("signature").alias("field"), F.col("signature").alias("v")), F.struct(F.lit("name").alias("field"), F.col("name").alias("v")))).alias("x")).select("x.*").groupBy("field").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.countDistinct("v").alias("different"), F.sum(F.octet_length("v")).alias("bytes"))),
    "E12_retention": bound(lambda t: C.prune(t.events.select(F.lit("repo").alias("repo"), F.date_format("ts", "yyyyMMdd").cast("long").alias("stamp")).distinct(), ["repo"], [F.desc("stamp")], 7)),
    "X07_resolve_edges": bound(lambda t: C.resolve_edges(_named_edges(t), t.symbols)[0]),
    "X07_unresolved": bound(lambda t: C.resolve_edges(_named_edges(t), t.symbols)[1]),
    "X08_resolve_parents": bound(_parents),
    "W02_top_per_file": bound(lambda t: latest(real(t.sym), ["file"], [F.desc(F.expr("line_end - line_start")), F.col("id")]).select("file", "id", "name")),
    "W06_prune_runs": bound(lambda t: C.prune(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 40).groupBy("user_id").agg(F.count("*").alias("pruned"))),
    "S01_multi_sort": bound(lambda t: real(t.sym).orderBy("file", "line_start", "id").limit(200).select("file", "line_start", "id")),
    "S02_limit": bound(lambda t: t.files.orderBy("path", "id").limit(25).select("path", "id")),
    "S03_distinct_first_seen": bound(lambda t: t.symbols.groupBy("name").agg(F.min("id").alias("first_id"))),
    "S04_union": bound(lambda t: t.symbols.select("name").union(t.symbols.select("kind")).distinct()),
    "S06_difference": bound(lambda t: t.symbols.select("id").exceptAll(t.edges.select(F.col("dst_symbol_id")).distinct())),
}

_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items())

SQL = {
    "SC02_languages": rf"SELECT id, CASE regexp_extract(path, '(?:^|/)[^/]+\.([^./]+)\z', 1) {_LANG} END AS lang FROM files",
    "SC04_refresh_delta": f"""WITH {_STATES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.mtime = n.mtime THEN 'unchanged' WHEN o.sha256 = n.sha256 THEN 'touched' ELSE 'modified' END AS change
FROM old o FULL JOIN new n ON o.path = n.path""",
    "SC05_upsert": f"WITH {_STATES} SELECT id, path, sha256, mtime FROM new UNION ALL SELECT id, path, sha256, mtime FROM old WHERE path NOT IN (SELECT path FROM new)",
    "SC05_current": "SELECT id, path FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) = 1",
    "SC06_replace_symbols": "SELECT id, file_id, name FROM symbols s WHERE file_id NOT IN (SELECT file_id FROM symbols WHERE file_id % 7 = 0 AND kind = 'function') OR kind = 'function'",
    "SC06_delete_files": """WITH gone AS (SELECT id FROM files WHERE indexed_at < mtime), lost AS (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM gone))
SELECT (SELECT count(*) FROM files WHERE id NOT IN (SELECT id FROM gone)) AS files, (SELECT count(*) FROM symbols WHERE file_id NOT IN (SELECT id FROM gone)) AS symbols, (SELECT count(*) FROM edges WHERE src_symbol_id NOT IN (SELECT id FROM lost) AND dst_symbol_id NOT IN (SELECT id FROM lost)) AS edges""",
    "SC07_symbol_scan": f"WITH {SYM} SELECT id, file, name, kind, parent FROM sym WHERE kind <> 'sentinel'",
    "SC07_names": "SELECT DISTINCT name, kind FROM symbols WHERE kind <> 'sentinel'",
    "SC08_files": "SELECT DISTINCT path FROM files WHERE lang = 'rust' AND path LIKE 't%' AND path LIKE '%.rs' ORDER BY path LIMIT 30",
    "SC12_chunks": r"""WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\r\z', '')) AS l FROM documents),
c AS (SELECT s.*, array_to_string(l[greatest(line_start, 1) : greatest(line_end, line_start, 1)], chr(10)) AS span FROM symbols s JOIN l ON l.doc_id = s.file_id WHERE kind <> 'sentinel'),
b AS (SELECT *, substr(file_id || ':' || name || ' [' || kind || ']' || chr(10) || coalesce(signature, '') || chr(10) || span, 1, 6000) AS body FROM c WHERE regexp_matches(span, '[^ \t\r\n\f]'))
SELECT 'code:' || file_id || '#' || name || '@' || line_start AS source_id, md5(body) AS md5, CAST(length(body) AS INT) AS chars FROM b""",
    "SC13_data_symbols": """SELECT CAST(id AS VARCHAR) AS path, u.name, u.kind, u.parent, CAST(u.line AS INT) AS line FROM (SELECT id, unnest(CASE id % 3
WHEN 0 THEN [{'name': 'id', 'kind': 'var', 'parent': CAST(NULL AS VARCHAR), 'line': 1}, {'name': 'a "q", ' || id, 'kind': 'var', 'parent': NULL, 'line': 1}]
WHEN 1 THEN [{'name': 'name', 'kind': 'var', 'parent': NULL, 'line': 1}, {'name': 'jobs', 'kind': 'var', 'parent': NULL, 'line': 2}, {'name': 'build_' || id, 'kind': 'var', 'parent': 'jobs', 'line': 3}, {'name': 'k ' || id, 'kind': 'var', 'parent': NULL, 'line': 6}]
ELSE [{'name': 'One ' || id, 'kind': 'class', 'parent': NULL, 'line': 1}, {'name': 'Two', 'kind': 'type', 'parent': NULL, 'line': 3}, {'name': 'Three', 'kind': 'function', 'parent': NULL, 'line': 5}] END) AS u FROM files)""",
    "SC13_headings": r"""WITH l AS (SELECT page_id, unnest(string_split(content_markdown, chr(10))) AS line, generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM pages)
SELECT page_id, CAST(n AS INT) AS line, CAST(length(regexp_extract(line, '^ {0,3}(#{1,6})[ \t]', 1)) AS INT) AS level, CASE length(regexp_extract(line, '^ {0,3}(#{1,6})[ \t]', 1)) WHEN 1 THEN 'class' WHEN 2 THEN 'type' ELSE 'function' END AS kind,
regexp_replace(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*)\z', 1), '[ \t\r#]+\z', '') AS name FROM l WHERE regexp_matches(line, '^ {0,3}#{1,6}[ \t]+[^ \t\r]')""",
    "SC14_stats": "SELECT field, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME field VALUE value) GROUP BY field",
    "SC14_sample": "SELECT l_orderkey FROM lineitem ORDER BY md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey, l_linenumber LIMIT 100",
    "SC17_prune": "SELECT repo, id FROM (SELECT string_split(path, '/')[1] AS repo, id, row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY mtime DESC, id DESC) AS n FROM files) WHERE n > 5",
    "A09_signature_stats": "SELECT count(*) FILTER (WHERE signature_enc = 1) AS encoded, count(*) FILTER (WHERE signature_enc = 0 AND signature IS NOT NULL) AS plain, count(*) FILTER (WHERE signature IS NULL) AS missing, CAST(sum(strlen(signature)) AS BIGINT) AS bytes FROM symbols",
    "SC10_text_documents": r"SELECT source_id, body, sha256(body) AS sha256 FROM drawers WHERE strlen(body) BETWEEN 1 AND 1000000 AND NOT contains(left(body, 8192), chr(0)) AND regexp_matches(body, '[^ \t\r\n\f]')",
    "SC18_codec_stats": """SELECT field, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS missing, count(DISTINCT v) AS different, CAST(sum(strlen(v)) AS BIGINT) AS bytes
FROM (SELECT 'signature' AS field, signature AS v FROM symbols UNION ALL SELECT 'name', name FROM symbols) GROUP BY field""",
    "E12_retention": "SELECT repo, stamp FROM (SELECT 'repo' AS repo, stamp, row_number() OVER (ORDER BY stamp DESC) AS n FROM (SELECT DISTINCT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS stamp FROM events)) WHERE n > 7",
    "X07_resolve_edges": f"WITH {_RESOLVED} SELECT src_symbol_id, dst_symbol_id, dst_name, kind, line FROM res",
    "X07_unresolved": f"WITH {_RESOLVED} SELECT DISTINCT dst_name FROM res WHERE dst_symbol_id IS NULL",
    "X08_resolve_parents": f"""WITH {SYM}, p AS (SELECT file_id, name, arg_max(id, (line_start, id)) AS id FROM symbols WHERE kind <> 'sentinel' GROUP BY ALL)
SELECT s.id, p.id AS parent_id FROM sym s LEFT JOIN p ON p.file_id = s.file_id AND p.name = s.parent WHERE s.kind <> 'sentinel' AND s.parent IS NOT NULL""",
    "W02_top_per_file": f"WITH {SYM} SELECT file, id, name FROM sym WHERE kind <> 'sentinel' QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_end - line_start DESC, id) = 1",
    "W06_prune_runs": "SELECT user_id, count(*) AS pruned FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 40 GROUP BY user_id",
    "S01_multi_sort": f"WITH {SYM} SELECT file, line_start, id FROM sym WHERE kind <> 'sentinel' ORDER BY file, line_start, id LIMIT 200",
    "S02_limit": "SELECT path, id FROM files ORDER BY path, id LIMIT 25",
    "S03_distinct_first_seen": "SELECT name, min(id) AS first_id FROM symbols GROUP BY name",
    "S04_union": "SELECT name FROM symbols UNION SELECT kind FROM symbols",
    "S06_difference": "SELECT id FROM symbols EXCEPT ALL SELECT DISTINCT dst_symbol_id FROM edges",
}
