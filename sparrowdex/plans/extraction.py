"""Extraction queries: code drawers as source texts, names over lines, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.operators.cdc import detect_language
from sparrowdex.plans.binding import SYM, Tables, bound
from sparrowdex.sources import extract as X


def _sources(t: Tables) -> DataFrame:
    path = F.regexp_extract("source_id", r"^code:([^#]*)", 1)
    return t.drawer.filter("wing = 'code'").select(F.concat_ws("@", path, "id").alias("path"), detect_language(path).alias("lang"), F.col("body").alias("text"))


def _refs(t: Tables) -> DataFrame:
    src = t.symbols.selectExpr("id AS src_symbol_id", "file_id")
    dst = t.symbols.selectExpr("id AS dst_symbol_id", "name")
    return t.edges.join(src, "src_symbol_id").join(dst, "dst_symbol_id").select("file_id", "name").distinct()


def _imports(t: Tables) -> DataFrame:
    """Every third reference across files as an import of its qualified name."""
    src = t.symbols.selectExpr("id AS src_symbol_id", "file_id")
    dst = t.symbols.selectExpr("id AS dst_symbol_id", "name AS local", "coalesce(qualified, name) AS qualified", "file_id AS other")
    return t.edges.join(src, "src_symbol_id").join(dst, "dst_symbol_id").filter("file_id <> other AND (src_symbol_id + dst_symbol_id) % 3 = 0").select("file_id", "local", "qualified").distinct()


def _importing(t: Tables) -> DataFrame:
    """Every file as a source that imports names with its id."""
    text = """CASE id % 3 WHEN 0 THEN concat('from .pkg.m', id, ' import a as b, c\\nimport os.path as p\\n') WHEN 1 THEN concat('import d, {x as y} from "./lib/m', id, '.ts"') ELSE concat('use crate::m', id, '::{A, B as C};') END"""
    return t.files.select(F.concat_ws("#", "path", "id").alias("path"), F.expr("element_at(array('python', 'typescript', 'rust'), cast(id % 3 + 1 as int))").alias("lang"), F.expr(text).alias("text"))


def _declared(t: Tables) -> DataFrame:
    """Symbols with their modifier before their signature, as it stands in a source."""
    return t.sym.filter("kind <> 'sentinel'").withColumn("text", F.concat(F.expr("CASE WHEN visibility IN ('pub', 'pub(crate)', 'export') THEN concat(' ', visibility, ' ') ELSE '' END"), F.coalesce("signature", F.lit(""))))


QUERIES = {
    "X01_symbols": bound(lambda t: X.extract_symbols(_sources(t)).select("path", "name", "kind", "parent", "line_start", "line_end")),
    "X02_signatures": bound(lambda t: t.symbols.filter("signature IS NOT NULL").select("id", X.compact_signature(F.col("signature")).alias("signature"))),
    "X03_visibility": bound(lambda t: _declared(t).select("id", X.declared_visibility(F.col("lang"), F.col("name"), F.col("text")).alias("visibility"))),
    "X04_calls": bound(lambda t: X.extract_edges(_sources(t)).filter("kind = 'call'")),
    "X05_references": bound(lambda t: X.extract_edges(_sources(t)).filter("kind = 'ref'")),
    "X06_imports": bound(lambda t: X.extract_imports(_importing(t))),
    "X06_scoped": bound(lambda t: X.resolve_scoped(_refs(t), t.symbols, _imports(t))),
    "X09_references": bound(lambda t: X.scan_name(t.drawers, "id", "body", "budget").select("id", "line")),
    "X10_calls": bound(lambda t: X.scan_name(t.drawers, "id", "body", "entry", calls=True).select("id", "line")),
}

_LINES = "ln AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM drawers)"

SQL = {
    "X02_signatures": r"SELECT id, regexp_replace(regexp_replace(regexp_replace(signature, '[ \t\r\n\f]+', ' ', 'g'), '^ | \z', '', 'g'), '[ {=]+\z', '') AS signature FROM symbols WHERE signature IS NOT NULL",
    "X03_visibility": f"""WITH {SYM} SELECT id, CASE WHEN lang = 'go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'pub' ELSE 'priv' END
WHEN lang = 'python' THEN CASE WHEN starts_with(name, '_') AND NOT (starts_with(name, '__') AND ends_with(name, '__') AND length(name) >= 4) THEN 'priv' ELSE 'pub' END
WHEN lang = 'rust' THEN CASE WHEN visibility IN ('pub', 'pub(crate)') THEN visibility END WHEN lang IN ('typescript', 'tsx') THEN CASE WHEN visibility = 'export' THEN 'pub' END END AS visibility FROM sym WHERE kind <> 'sentinel'""",
    "X06_imports": """SELECT path || '#' || id AS path, u.local, u.qualified FROM (SELECT path, id, unnest(CASE id % 3
WHEN 0 THEN [{'local': 'b', 'qualified': 'pkg::m' || id || '::a'}, {'local': 'c', 'qualified': 'pkg::m' || id || '::c'}, {'local': 'p', 'qualified': 'os::path'}]
WHEN 1 THEN [{'local': 'd', 'qualified': 'lib::m' || id || '::default'}, {'local': 'y', 'qualified': 'lib::m' || id || '::x'}]
ELSE [{'local': 'A', 'qualified': 'crate::m' || id || '::A'}, {'local': 'C', 'qualified': 'crate::m' || id || '::B'}] END) AS u FROM files)""",
    "X06_scoped": """WITH ref AS (SELECT DISTINCT s.file_id, d.name FROM edges e JOIN symbols s ON s.id = e.src_symbol_id JOIN symbols d ON d.id = e.dst_symbol_id),
imp AS (SELECT DISTINCT s.file_id, d.name, coalesce(d.qualified, d.name) AS qualified FROM edges e JOIN symbols s ON s.id = e.src_symbol_id JOIN symbols d ON d.id = e.dst_symbol_id WHERE s.file_id <> d.file_id AND (s.id + d.id) % 3 = 0),
real AS (SELECT * FROM symbols WHERE kind <> 'sentinel')
SELECT r.file_id, r.name, coalesce((SELECT min(id) FROM real WHERE real.file_id = r.file_id AND real.name = r.name),
  (SELECT min(real.id) FROM imp JOIN real ON real.qualified = imp.qualified WHERE imp.file_id = r.file_id AND imp.name = r.name),
  (SELECT CASE WHEN count(*) = 1 OR EXISTS (SELECT 1 FROM imp WHERE imp.file_id = r.file_id AND imp.name = r.name) THEN min(id) END FROM real WHERE real.name = r.name)) AS target FROM ref r""",
    "X09_references": rf"WITH {_LINES} SELECT id, CAST(n AS INT) AS line FROM ln WHERE regexp_matches(line, '(?:^|[^\w$])budget(?:[^\w$]|\z)')",
    "X10_calls": rf"WITH {_LINES} SELECT id, CAST(n AS INT) AS line FROM ln WHERE regexp_matches(line, '(?:^|[^\w$])entry[ \t]*\(')",
}
