"""Lookup, join and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.operators import graph as G
from sparrowdex.operators import lookup as L
from sparrowdex.plans.binding import HITS, NAME, SYM, Tables, bound

_COLS = ["id", "name", "kind", "file", "parent", "line_start", "line_end", "visibility"]
_COLSQL = ", ".join(_COLS)


def _calls(t: Tables, names=(NAME,)) -> DataFrame:
    return L.callers(t.edges, t.symbols, t.files, names)


def _refs(t: Tables, names=(NAME,)) -> DataFrame:
    return L.references(t.edges, t.symbols, t.files, names)


def _unresolved(t: Tables) -> DataFrame:
    return t.symbols.filter("kind = 'sentinel'").select("name")


def _stale(t: Tables) -> DataFrame:
    return t.files.filter("indexed_at < mtime").select("path")


def _before(t: Tables) -> DataFrame:
    return L.real(t.sym).select("id", "file", "name", "signature", "line_start", "line_end")


def _after(t: Tables) -> DataFrame:
    """A later snapshot: a thirteenth gone, a seventh with another signature, a fifth moved, a nineteenth renamed."""
    own = _before(t).filter("id % 13 <> 0")
    return own.select(
        "id", "file", F.expr("CASE WHEN id % 19 = 0 THEN name || '_v2' ELSE name END").alias("name"), F.expr("CASE WHEN id % 7 = 0 THEN coalesce(signature, '') || ' -> x' ELSE signature END").alias("signature"),
        F.expr("CASE WHEN id % 5 = 0 THEN line_start + 1 ELSE line_start END").alias("line_start"), "line_end",
    )


_SNAPSHOTS = f"""{SYM}, before AS (SELECT id, file, name, signature, line_start, line_end FROM sym WHERE kind <> 'sentinel'),
after AS (SELECT id, file, CASE WHEN id % 19 = 0 THEN name || '_v2' ELSE name END AS name, CASE WHEN id % 7 = 0 THEN coalesce(signature, '') || ' -> x' ELSE signature END AS signature,
  CASE WHEN id % 5 = 0 THEN line_start + 1 ELSE line_start END AS line_start, line_end FROM before WHERE id % 13 <> 0),
b AS (SELECT * FROM before QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY line_start DESC, id DESC) = 1),
a AS (SELECT * FROM after QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY line_start DESC, id DESC) = 1),
changes AS (SELECT * FROM (SELECT coalesce(a.file, b.file) AS file, coalesce(a.name, b.name) AS name,
  CASE WHEN a.id IS NULL THEN 'removed' WHEN b.id IS NULL THEN 'added' WHEN a.signature IS DISTINCT FROM b.signature THEN 'signature_changed'
       WHEN a.line_start <> b.line_start OR a.line_end <> b.line_end THEN 'body_moved' END AS change
  FROM b FULL JOIN a ON a.file = b.file AND a.name = b.name) WHERE change IS NOT NULL)"""

_ENCLOSED = f"""{HITS}, inner_sym AS (SELECT h.file_id, h.line, arg_min(struct_pack(id := s.id, name := s.name, kind := s.kind), (s.line_end - s.line_start, s.line_start, s.id)) AS m
  FROM (SELECT DISTINCT file_id, line FROM hits) h JOIN symbols s ON s.file_id = h.file_id AND s.kind <> 'sentinel' AND h.line BETWEEN s.line_start AND s.line_end
  GROUP BY h.file_id, h.line)"""


def _bundle(t: Tables) -> DataFrame:
    """What a change of the first symbol of the name touches, as far as two calls away."""
    seed = L.find_symbols(t.sym, [NAME]).orderBy("id").limit(1).select(F.col("id").alias("node"))
    near = G.walk(G.call_graph(t.edges, None), seed, 2, incoming=True)
    return L.bundle(t.sym, _calls(t), _refs(t), near, NAME)


QUERIES = {
    "L01_find_symbol": bound(lambda t: L.find_symbols(t.sym, [NAME]).select(*_COLS)),
    "L02_find_symbols": bound(lambda t: L.find_symbols(t.sym, _unresolved(t)).select(*_COLS)),
    "L03_find_in_changed_files": bound(lambda t: L.in_files(L.find_symbols(t.sym, [NAME]), _stale(t)).select(*_COLS)),
    "L04_callers": bound(lambda t: _calls(t).select("file", "line", "src_symbol_id", "src_name")),
    "L04_caller_counts": bound(lambda t: L.callers(t.edges, t.symbols, t.files).groupBy("name").agg(F.count("*").alias("callers"), F.countDistinct("file").alias("files"))),
    "L05_references": bound(lambda t: _refs(t).select("file", "line", "src_symbol_id", "src_name", "kind")),
    "L06_hits": bound(lambda t: L.first_hits(_refs(t), 50).select("file", "line", "src_symbol_id")),
    "L06_files_only": bound(lambda t: L.files_only(_refs(t), 40)),
    "L06_count": bound(lambda t: _refs(t).agg(F.count("*").alias("hits"))),
    "L07_bare_names": bound(lambda t: t.symbols.select("id", L.bare_name(F.col("qualified")).alias("bare"), L.safe_identifier(F.col("name")).alias("safe"))),
    "L08_enclosing_symbol": bound(lambda t: L.enclosing(L.references(t.edges, t.symbols, t.files), t.symbols).select("file", "line", "src_symbol_id", "name", "kind", "sym_id", "sym_name")),
    "L09_outline": bound(lambda t: L.real(t.sym).select("file", "line_start", "line_end", "name", "kind", "parent", "signature")),
    "L10_snippets": bound(lambda t: t.documents.select("doc_id", L.compact_snippet(F.col("text")).alias("snippet"))),
    "L11_lines_at": bound(lambda t: L.lines_at(t.documents, t.documents.selectExpr("doc_id", "CAST(1 + doc_id % 5 AS INT) AS line"), "doc_id", "text")),
    "L12_selectors": bound(lambda t: L.selectors(t.sym)),
    "L13_splice": bound(lambda t: t.documents.select("doc_id", L.splice(F.col("text"), 2, 3, "REPLACED\nBY THIS\n").alias("text"))),
    "L14_changed_symbols": bound(lambda t: L.in_files(L.real(t.sym), _stale(t)).select("id", "file", "name")),
    "L15_fingerprints": bound(lambda t: t.drawers.select("id", L.fingerprint(F.col("body"), F.col("sha256")).alias("state"), F.sha2(F.col("body").cast("binary"), 256).alias("fingerprint"))),
    "L16_diff_symbols": bound(lambda t: L.diff_symbols(_before(t), _after(t))),
    "L17_broken_callers": bound(lambda t: L.broken_callers(L.diff_symbols(_before(t), _after(t)), L.callers(t.edges, t.symbols, t.files))),
    "L18_symbol_bundle": bound(_bundle),
    "L19_by_repo": bound(lambda t: L.by_repo(L.find_symbols(t.sym, [NAME])).groupBy("repo").agg(F.count("*").alias("hits"))),
    "A01_top_files": bound(lambda t: L.summary(_refs(t), t.symbols)[1]),
    "A01_top_symbols": bound(lambda t: L.summary(_refs(t), t.symbols)[2]),
    "A01_by_file": bound(lambda t: L.summary(_refs(t), t.symbols)[0]),
    "A02_hot_symbols": bound(lambda t: L.hot_symbols(t.edges, t.sym, 20)),
    "A02_hot_called": bound(lambda t: L.hot_symbols(t.edges, t.sym, 20, ["call"])),
    "A03_popular_symbols": bound(lambda t: L.real(t.symbols).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(6)),
    "A03_dense_files": bound(lambda t: L.real(t.sym).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(4)),
    "A10_counts": bound(lambda t: t.symbols.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))),
    "A11_by_directory": bound(
        lambda t: t.files.filter("lang <> '_unresolved'")
        .select(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("dir"), F.substring_index("path", "/", -1).alias("base"))
        .groupBy("dir").agg(F.array_join(F.sort_array(F.collect_list("base")), ",").alias("files"))
    ),
    "J01_edge_symbol_file": bound(lambda t: L.hits(t.edges, t.symbols, t.files, None, ["call", "ref", "import", "inherit", "impl"]).groupBy("file", "kind").agg(F.count("*").alias("n"))),
    "J02_left_parent_room": bound(lambda t: t.drawer.groupBy("wing", "room").agg(F.count("*").alias("n"))),
    "J03_semi": bound(lambda t: t.symbols.join(t.edges.select(F.col("src_symbol_id").alias("id")), "id", "left_semi").select("id", "name")),
    "J04_anti": bound(lambda t: t.symbols.join(t.edges.select(F.col("dst_symbol_id").alias("id")), "id", "left_anti").select("id", "name")),
    "J05_self_parent": bound(lambda t: t.sym.select("id", "name", "parent")),
    "J06_interval": bound(lambda t: L.enclosing(_calls(t), t.symbols).groupBy("sym_name").agg(F.count("*").alias("n"))),
    "J07_full_outer": bound(lambda t: L.diff_symbols(_before(t), _after(t)).groupBy("change").agg(F.count("*").alias("n"))),
    "J10_file_pairs": bound(
        lambda t: t.edges.join(t.symbols.selectExpr("id AS src_symbol_id", "file_id AS src_file"), "src_symbol_id").join(t.symbols.selectExpr("id AS dst_symbol_id", "file_id AS dst_file"), "dst_symbol_id")
        .filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("weight"))
    ),
}

SQL = {
    "L01_find_symbol": f"WITH {SYM} SELECT {_COLSQL} FROM sym WHERE name = '{NAME}' AND kind <> 'sentinel'",
    "L02_find_symbols": f"WITH {SYM} SELECT {_COLSQL} FROM sym WHERE kind <> 'sentinel' AND name IN (SELECT name FROM symbols WHERE kind = 'sentinel')",
    "L03_find_in_changed_files": f"WITH {SYM} SELECT {_COLSQL} FROM sym WHERE name = '{NAME}' AND kind <> 'sentinel' AND file IN (SELECT path FROM files WHERE indexed_at < mtime)",
    "L04_callers": f"WITH {HITS} SELECT file, line, src_symbol_id, src_name FROM hits WHERE name = '{NAME}' AND kind = 'call'",
    "L04_caller_counts": f"WITH {HITS} SELECT name, count(*) AS callers, count(DISTINCT file) AS files FROM hits WHERE kind = 'call' GROUP BY name",
    "L05_references": f"WITH {HITS} SELECT file, line, src_symbol_id, src_name, kind FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref')",
    "L06_hits": f"WITH {HITS} SELECT file, line, src_symbol_id FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref') ORDER BY file, line, src_symbol_id LIMIT 50",
    "L06_files_only": f"WITH {HITS} SELECT DISTINCT file FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref') ORDER BY file LIMIT 40",
    "L06_count": f"WITH {HITS} SELECT count(*) AS hits FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref')",
    "L07_bare_names": r"SELECT id, list_last(string_split(qualified, '::')) AS bare, regexp_full_match(name, '[\p{L}_][\p{L}\p{N}_]*') AS safe FROM symbols",
    "L08_enclosing_symbol": f"WITH {_ENCLOSED} SELECT h.file, h.line, h.src_symbol_id, h.name, h.kind, i.m.id AS sym_id, i.m.name AS sym_name FROM hits h LEFT JOIN inner_sym i ON i.file_id = h.file_id AND i.line = h.line WHERE h.kind IN ('call', 'ref')",
    "L09_outline": f"WITH {SYM} SELECT file, line_start, line_end, name, kind, parent, signature FROM sym WHERE kind <> 'sentinel'",
    "L10_snippets": r"""WITH flat AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'), '^ | \z', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 80 THEN left(s, 80) || '…' ELSE s END AS snippet FROM flat""",
    "L11_lines_at": "WITH placed AS (SELECT doc_id, CAST(1 + doc_id % 5 AS INT) AS line, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, line, l[line] AS snippet FROM placed WHERE line <= len(l)",
    "L12_selectors": f"""WITH {SYM} SELECT file || '#' || CASE WHEN parent IS NOT NULL THEN parent || '::' || name ELSE name END AS selector, count(*) AS candidates,
string_agg(CAST(line_start AS VARCHAR), ',' ORDER BY line_start) AS lines FROM sym WHERE kind <> 'sentinel' GROUP BY 1""",
    "L13_splice": r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, CASE WHEN contains(text, chr(13) || chr(10)) THEN chr(13) ELSE '' END AS cr FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 3 THEN array_to_string(list_concat(list_concat(l[1:1], ['REPLACED' || cr, 'BY THIS' || cr]), l[4:]), chr(10)) ELSE text END AS text FROM l""",
    "L14_changed_symbols": f"WITH {SYM} SELECT id, file, name FROM sym WHERE kind <> 'sentinel' AND file IN (SELECT path FROM files WHERE indexed_at < mtime)",
    "L15_fingerprints": "SELECT id, CASE WHEN sha256(body) = drawers.sha256 THEN 'unchanged' ELSE 'result' END AS state, sha256(body) AS fingerprint FROM drawers",
    "L16_diff_symbols": f"WITH {_SNAPSHOTS} SELECT file, name, change FROM changes",
    "L17_broken_callers": f"WITH {_SNAPSHOTS}, {HITS} SELECT DISTINCT file FROM hits WHERE kind = 'call' AND name IN (SELECT name FROM changes WHERE change = 'removed')",
    "L18_symbol_bundle": f"""WITH RECURSIVE {SYM}, {HITS}, own AS (SELECT * FROM sym WHERE name = '{NAME}' AND kind <> 'sentinel' ORDER BY id LIMIT 1),
w AS (SELECT id AS node, 0 AS depth FROM own UNION SELECT e.src_symbol_id, w.depth + 1 FROM w JOIN edges e ON e.dst_symbol_id = w.node WHERE w.depth < 2),
near AS (SELECT node, min(depth) AS depth FROM w GROUP BY node HAVING min(depth) > 0),
c AS (SELECT src_name, file, line, row_number() OVER (ORDER BY file, line, src_symbol_id) AS n FROM hits WHERE name = '{NAME}' AND kind = 'call' QUALIFY n <= 50),
r AS (SELECT src_name, file, line, row_number() OVER (ORDER BY file, line, src_symbol_id) AS n FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref') QUALIFY n <= 50)
SELECT 'symbol' AS part, 1 AS place, name, file, line_start AS line FROM own
UNION ALL SELECT 'caller', n, src_name, file, line FROM c UNION ALL SELECT 'ref', n, src_name, file, line FROM r
UNION ALL SELECT 'outline', 0, name, file, line_start FROM sym WHERE kind <> 'sentinel' AND file = (SELECT file FROM own)
UNION ALL SELECT 'blast', depth, name, file, line_start FROM near JOIN sym ON id = node""",
    "L19_by_repo": f"WITH {SYM} SELECT string_split(file, '/')[1] AS repo, count(*) AS hits FROM sym WHERE name = '{NAME}' AND kind <> 'sentinel' GROUP BY 1",
    "A01_top_files": f"WITH {HITS} SELECT file, count(*) AS hits FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref') GROUP BY file ORDER BY hits DESC, file LIMIT 5",
    "A01_top_symbols": f"""WITH {_ENCLOSED} SELECT i.m.name AS symbol, h.file, count(*) AS hits FROM hits h JOIN inner_sym i ON i.file_id = h.file_id AND i.line = h.line
WHERE h.name = '{NAME}' AND h.kind IN ('call', 'ref') GROUP BY 1, 2 ORDER BY hits DESC, file, symbol LIMIT 5""",
    "A01_by_file": f"WITH {HITS} SELECT file, count(*) AS hits FROM hits WHERE name = '{NAME}' AND kind IN ('call', 'ref') GROUP BY file",
    "A02_hot_symbols": f"WITH {SYM}, deg AS (SELECT dst_symbol_id AS id, count(*) AS in_degree FROM edges GROUP BY 1) SELECT id, name, kind, file, in_degree FROM deg JOIN sym USING (id) ORDER BY in_degree DESC, id LIMIT 20",
    "A02_hot_called": f"WITH {SYM}, deg AS (SELECT dst_symbol_id AS id, count(*) AS in_degree FROM edges WHERE kind = 'call' GROUP BY 1) SELECT id, name, kind, file, in_degree FROM deg JOIN sym USING (id) ORDER BY in_degree DESC, id LIMIT 20",
    "A03_popular_symbols": "SELECT name, count(*) AS n FROM symbols WHERE kind <> 'sentinel' GROUP BY name ORDER BY n DESC, name LIMIT 6",
    "A03_dense_files": f"WITH {SYM} SELECT file, count(*) AS n FROM sym WHERE kind <> 'sentinel' GROUP BY file ORDER BY n DESC, file LIMIT 4",
    "A10_counts": "SELECT kind, count(*) AS n, count(DISTINCT file_id) AS files FROM symbols GROUP BY kind",
    "A11_by_directory": r"SELECT regexp_extract(path, '^(.*)/[^/]*\z', 1) AS dir, string_agg(base, ',' ORDER BY base) AS files FROM (SELECT path, list_last(string_split(path, '/')) AS base FROM files WHERE lang <> '_unresolved') GROUP BY 1",
    "J01_edge_symbol_file": f"WITH {HITS} SELECT file, kind, count(*) AS n FROM hits WHERE kind IN ('call', 'ref', 'import', 'inherit', 'impl') GROUP BY file, kind",
    "J02_left_parent_room": "SELECT w.name AS wing, r.name AS room, count(*) AS n FROM drawers d JOIN wings w ON w.id = d.wing_id LEFT JOIN rooms r ON r.id = d.room_id GROUP BY 1, 2",
    "J03_semi": "SELECT id, name FROM symbols WHERE id IN (SELECT src_symbol_id FROM edges)",
    "J04_anti": "SELECT id, name FROM symbols WHERE id NOT IN (SELECT dst_symbol_id FROM edges WHERE dst_symbol_id IS NOT NULL)",
    "J05_self_parent": f"WITH {SYM} SELECT id, name, parent FROM sym",
    "J06_interval": f"WITH {_ENCLOSED} SELECT i.m.name AS sym_name, count(*) AS n FROM hits h LEFT JOIN inner_sym i ON i.file_id = h.file_id AND i.line = h.line WHERE h.name = '{NAME}' AND h.kind = 'call' GROUP BY 1",
    "J07_full_outer": f"WITH {_SNAPSHOTS} SELECT change, count(*) AS n FROM changes GROUP BY change",
    "J10_file_pairs": "SELECT s.file_id AS src_file, d.file_id AS dst_file, count(*) AS weight FROM edges e JOIN symbols s ON s.id = e.src_symbol_id JOIN symbols d ON d.id = e.dst_symbol_id WHERE s.file_id <> d.file_id GROUP BY 1, 2",
}
