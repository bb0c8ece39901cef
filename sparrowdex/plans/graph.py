"""Call-graph, impact and crawl queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.operators import graph as G
from sparrowdex.plans.binding import NAME, SYM, Tables, bound


def _hub(t: Tables) -> DataFrame:
    """The real symbol with most edges in."""
    deg = t.edges.groupBy(F.col("dst_symbol_id").alias("id")).agg(F.count("*").alias("n"))
    return deg.join(t.symbols.filter("kind <> 'sentinel'").select("id"), "id").orderBy(F.desc("n"), "id").limit(1).select(F.col("id").alias("node"))


_HUB = "hub AS (SELECT dst_symbol_id AS node FROM edges JOIN symbols ON id = dst_symbol_id WHERE symbols.kind <> 'sentinel' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _named(t: Tables) -> DataFrame:
    return t.symbols.filter((F.col("name") == NAME) & (F.col("kind") != "sentinel")).select(F.col("id").alias("node"))


def _stale_symbols(t: Tables) -> DataFrame:
    return t.symbols.join(t.files.filter("indexed_at < mtime").select(F.col("id").alias("file_id")), "file_id", "left_semi").filter("kind <> 'sentinel'").select(F.col("id").alias("node"))


def _walk_sql(seeds: str, depth: int, kinds: str, incoming: bool, with_seeds: bool = False) -> str:
    a, b = ("dst_symbol_id", "src_symbol_id") if incoming else ("src_symbol_id", "dst_symbol_id")
    return f"""seed AS ({seeds}), w AS (SELECT node, 0 AS depth FROM seed UNION SELECT e.{b}, w.depth + 1 FROM w JOIN edges e ON e.{a} = w.node WHERE w.depth < {depth} {kinds}),
near AS (SELECT node, min(depth) AS depth FROM w GROUP BY node {"" if with_seeds else "HAVING min(depth) > 0"})"""


_CALL, _BOTH = "AND e.kind = 'call'", "AND e.kind IN ('call', 'ref')"
_NEW = f"SELECT id AS node FROM symbols WHERE name = '{NAME}' AND kind <> 'sentinel'"
_STALE = "SELECT s.id AS node FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.indexed_at < f.mtime AND s.kind <> 'sentinel'"
_TEST = r"""(kind IN ('function', 'method') AND (regexp_matches(file, '(?:^|/)(?:tests?)/|(?:^|/)(?:[^/]*_test\.(?:rs|go|py)|test_[^/]*\.py|[^/]*\.test\.(?:ts|tsx|js|jsx)|[^/]*\.spec\.(?:ts|js))\z')
  OR starts_with(name, 'test_') OR (ends_with(file, '_test.go') AND (starts_with(name, 'Test') OR starts_with(name, 'Benchmark'))) OR coalesce(regexp_matches(lower(parent), '^(?:tests?|.*_tests?)\z'), false)))"""


def _tests_by_repo(t: Tables) -> DataFrame:
    """The command for the affected tests of each repository, whose language decides the runner."""
    tests = G.affected(t.edges, t.sym, _stale_symbols(t)).join(t.sym.select("id", "lang"), "id").withColumn("repo", F.substring_index("file", "/", 1))
    runner = F.when(F.col("lang") == "rust", "cargo").when(F.col("lang") == "go", "go").when(F.col("lang") == "python", "pytest").when(F.col("lang").isin("typescript", "tsx", "javascript"), "npm")
    rows = tests.withColumn("runner", runner).filter("runner IS NOT NULL").groupBy("repo", "runner").agg(F.collect_set("name").alias("names"))
    return rows.select("repo", "runner", G.command_for(F.col("runner"), F.col("names")).alias("command"))


def _importers(t: Tables) -> DataFrame:
    target = t.symbols.filter("kind <> 'sentinel'").groupBy("file_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_id").limit(1)
    return G.importers(t.edges, t.symbols, t.files, target.select("file_id"), 2)


def _why(t: Tables) -> DataFrame:
    """From the farthest symbol that leads to the hub, of several the smallest, to the hub."""
    hub = _hub(t)
    dst = hub.first()
    far = G.walk(G.call_graph(t.edges, None), hub, 12, incoming=True).orderBy(F.desc("depth"), "node").first()
    return G.why(t.edges, far["node"] if far else 0, dst["node"] if dst else 0, 12)


def _site_links(t: Tables) -> tuple[DataFrame, DataFrame]:
    clean = F.regexp_replace("url", r"[?#].*\z", "")
    pages = t.pages.select(clean.alias("url"), "content_markdown")
    found = F.explode(F.array_distinct(F.regexp_extract_all("content_markdown", F.lit(r"\]\((/[^)\s#?]*)\)"), F.lit(1))))
    links = pages.select("url", found.alias("path")).select("url", F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), "path").alias("target")).distinct()
    return pages.select("url").distinct(), links


def _crawl(t: Tables) -> DataFrame:
    pages, links = _site_links(t)
    seeds = t.pages.filter("page_id % 20 = 0").select(F.regexp_replace("url", r"[?#].*\z", "").alias("url"))
    return G.crawl(pages, links, seeds, 2)


QUERIES = {
    "G01_call_graph": bound(lambda t: G.call_graph(t.edges)),
    "G02_callees": bound(lambda t: G.reached(G.call_graph(t.edges), _named(t), 3).select("node", "depth")),
    "G03_callers": bound(lambda t: G.reached(G.call_graph(t.edges), _hub(t), 2, incoming=True).select("node", "depth")),
    "G04_cycles": bound(lambda t: G.cycles(G.call_graph(t.edges))),
    "G05_blast_radius": bound(lambda t: G.blast_radius(t.edges, t.sym, _hub(t), 4)),
    "G06_orphans": bound(lambda t: G.orphans(G.call_graph(t.edges))),
    "G07_why_path": bound(_why),
    "G08_importers": bound(_importers),
    "G09_affected_tests": bound(lambda t: G.affected(t.edges, t.sym, _stale_symbols(t))),
    "G10_test_symbols": bound(lambda t: t.sym.filter(G.is_test(F.col("kind"), F.col("file"), F.col("name"), F.col("parent"))).select("id", "name", "file")),
    "G11_test_commands": bound(_tests_by_repo),
    "G11_runners": bound(lambda t: G.runners(t.files.select(F.concat(F.regexp_extract("path", r"^(.*/)", 1), F.expr("element_at(array('Cargo.toml', 'go.mod', 'setup.cfg', 'package.json', 'README.md', 'tox.ini'), cast(id % 6 + 1 as int))")).alias("path")), F.regexp_extract("path", r"^(.*)/", 1))),
    "G13_crawl": bound(_crawl),
    "G14_claim": bound(lambda t: G.claim(t.pages.selectExpr("url", "depth", "page_id AS seq", "CASE WHEN status IS NULL THEN 'queued' ELSE 'done' END AS state"), 50).select("url", "depth", "seq", "state")),
    "J09_recursive": bound(lambda t: G.walk(G.call_graph(t.edges, ("call", "ref")), _named(t), 3, incoming=True).groupBy("depth").agg(F.count("*").alias("n"))),
}

SQL = {
    "G01_call_graph": "SELECT DISTINCT src_symbol_id AS src, dst_symbol_id AS dst FROM edges WHERE kind = 'call'",
    "G02_callees": f"WITH RECURSIVE {_walk_sql(_NEW, 3, _CALL, False)} SELECT node, depth FROM near",
    "G03_callers": f"WITH RECURSIVE {_HUB}, {_walk_sql('SELECT node FROM hub', 2, _CALL, True)} SELECT node, depth FROM near",
    "G04_cycles": """WITH RECURSIVE pair AS (SELECT DISTINCT src_symbol_id AS src, dst_symbol_id AS dst FROM edges WHERE kind = 'call' AND src_symbol_id <> dst_symbol_id),
one AS (SELECT * FROM pair WHERE src IN (SELECT dst FROM pair) AND dst IN (SELECT src FROM pair)),
two AS (SELECT * FROM one WHERE src IN (SELECT dst FROM one) AND dst IN (SELECT src FROM one)),
core AS (SELECT * FROM two WHERE src IN (SELECT dst FROM two) AND dst IN (SELECT src FROM two)),
r AS (SELECT src AS a, dst AS b FROM core UNION SELECT r.a, c.dst FROM r JOIN core c ON c.src = r.b)
SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""",
    "G05_blast_radius": f"WITH RECURSIVE {SYM}, {_HUB}, {_walk_sql('SELECT node FROM hub', 4, '', True)} SELECT id, name, kind, file, depth FROM near JOIN sym ON id = node",
    "G06_orphans": "SELECT DISTINCT src_symbol_id AS node FROM edges WHERE kind = 'call' AND src_symbol_id NOT IN (SELECT dst_symbol_id FROM edges WHERE kind = 'call')",
    "G07_why_path": f"""WITH RECURSIVE {_HUB}, {_walk_sql('SELECT node FROM hub', 12, '', True, True)},
pair AS (SELECT DISTINCT e.src_symbol_id AS src, e.dst_symbol_id AS dst, b.depth AS rest FROM edges e JOIN near a ON a.node = e.src_symbol_id JOIN near b ON b.node = e.dst_symbol_id WHERE b.depth = a.depth - 1),
step AS (SELECT src, min(dst) AS dst FROM pair GROUP BY src),
far AS (SELECT node FROM near WHERE depth > 0 ORDER BY depth DESC, node LIMIT 1),
path AS (SELECT 1 AS hop, src, dst FROM step WHERE src = (SELECT node FROM far) UNION ALL SELECT p.hop + 1, n.src, n.dst FROM path p JOIN step n ON n.src = p.dst)
SELECT p.hop, p.src, p.dst, m.kind, m.line FROM path p JOIN (SELECT src_symbol_id AS src, dst_symbol_id AS dst, min(struct_pack(kind := kind, line := line)) AS m FROM edges GROUP BY 1, 2) USING (src, dst)""",
    "G08_importers": """WITH target AS (SELECT file_id FROM symbols WHERE kind <> 'sentinel' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
p AS (SELECT s.file_id AS a, d.file_id AS b, count(*) AS n FROM edges e JOIN symbols s ON s.id = e.src_symbol_id JOIN symbols d ON d.id = e.dst_symbol_id WHERE s.file_id <> d.file_id GROUP BY 1, 2),
one AS (SELECT a, sum(n) AS n FROM p WHERE b IN (SELECT file_id FROM target) GROUP BY 1),
seen AS (SELECT file_id FROM target UNION SELECT a FROM one),
two AS (SELECT a, sum(n) AS n FROM p WHERE b IN (SELECT file_id FROM seen) AND a NOT IN (SELECT file_id FROM seen) GROUP BY 1)
SELECT f.path AS file, CAST(n AS BIGINT) AS edges, depth FROM (SELECT a, n, 1 AS depth FROM one UNION ALL SELECT a, n, 2 FROM two) JOIN files f ON f.id = a""",
    "G09_affected_tests": f"WITH RECURSIVE {SYM}, {_walk_sql(_STALE, 3, _BOTH, True, True)} SELECT id, name, file, line_start, depth FROM near JOIN sym ON id = node WHERE {_TEST}",
    "G10_test_symbols": f"WITH {SYM} SELECT id, name, file FROM sym WHERE {_TEST}",
    "G11_test_commands": f"""WITH RECURSIVE {SYM}, {_walk_sql(_STALE, 3, _BOTH, True, True)},
tests AS (SELECT string_split(file, '/')[1] AS repo, CASE WHEN lang = 'rust' THEN 'cargo' WHEN lang = 'go' THEN 'go' WHEN lang = 'python' THEN 'pytest' WHEN lang IN ('typescript', 'tsx', 'javascript') THEN 'npm' END AS runner, name
  FROM near JOIN sym ON id = node WHERE {_TEST}),
one AS (SELECT DISTINCT repo, runner, name FROM tests WHERE runner IS NOT NULL)
SELECT repo, runner, CASE runner WHEN 'cargo' THEN 'cargo test -- ' || string_agg(name, ' ' ORDER BY name) WHEN 'go' THEN 'go test ./... -run ''^(' || string_agg(name, '|' ORDER BY name) || ')$'''
  WHEN 'pytest' THEN 'pytest -k "' || string_agg(name, ' or ' ORDER BY name) || '"' ELSE 'npm test -- -t "' || string_agg(name, '|' ORDER BY name) || '"' END AS command FROM one GROUP BY repo, runner""",
    "G11_runners": """WITH f AS (SELECT regexp_extract(path, '^(.*)/', 1) AS place, ['cargo', 'go', 'pytest', 'npm', NULL, 'pytest'][id % 6 + 1] AS runner FROM files)
SELECT place, arg_min(runner, list_position(['cargo', 'go', 'pytest', 'npm'], runner)) AS runner FROM f WHERE runner IS NOT NULL GROUP BY place""",
    "G13_crawl": r"""WITH RECURSIVE page AS (SELECT DISTINCT regexp_replace(url, '[?#].*\z', '') AS url, content_markdown FROM pages),
link AS (SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/]+)', 1) || unnest(regexp_extract_all(content_markdown, '\]\((/[^)\s#?]*)\)', 1)) AS target FROM page),
seed AS (SELECT DISTINCT regexp_replace(url, '[?#].*\z', '') AS url FROM pages WHERE page_id % 20 = 0),
w AS (SELECT url AS seed, url, 0 AS depth FROM seed UNION SELECT w.seed, l.target, w.depth + 1 FROM w JOIN link l ON l.url = w.url WHERE w.depth < 2)
SELECT seed, url, min(depth) AS depth FROM w GROUP BY seed, url""",
    "G14_claim": "SELECT url, depth, page_id AS seq, 'inflight' AS state FROM pages WHERE status IS NULL ORDER BY depth, page_id LIMIT 50",
    "J09_recursive": f"WITH RECURSIVE {_walk_sql(_NEW, 3, _BOTH, True, True)} SELECT depth, count(*) AS n FROM near GROUP BY depth",
}
