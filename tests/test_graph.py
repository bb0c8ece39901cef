from pyspark.sql import functions as F

from sparrowdex.operators import graph as G
from sparrowdex.operators.lookup import diff_symbols, enclosing, hot_symbols, symbol_view

FILES = "id long, path string, lang string"
SYMBOLS = "id long, file_id long, name string, kind string, parent_id long, line_start int, line_end int"
EDGES = "src_symbol_id long, dst_symbol_id long, kind string, line int"


def index(spark, names, edges, files=None):
    s = [(i, (files or {}).get(i, 1), n, "function", None, i * 10, i * 10 + 5) for i, n in names.items()]
    f = sorted({r[1] for r in s})
    return spark.createDataFrame([(i, f"f{i}.rs", "rust") for i in f], FILES), spark.createDataFrame(s, SYMBOLS), spark.createDataFrame([(a, b, k, 1) for a, b, k in edges], EDGES)


def test_blast_radius(spark):
    files, symbols, edges = index(spark, {1: "a", 2: "b", 3: "c", 4: "d"}, [(3, 2, "call"), (2, 1, "call"), (4, 1, "ref")])
    view = symbol_view(symbols, files)

    def run(root, depth, kinds=None):
        return {r["id"]: r["depth"] for r in G.blast_radius(edges, view, spark.createDataFrame([(root,)], "node long"), depth, kinds).collect()}

    assert run(1, 1) == {2: 1, 4: 1}
    assert run(1, 2) == {2: 1, 4: 1, 3: 2}
    assert run(1, 5, ["call"]) == {2: 1, 3: 2}
    assert run(1, 0) == {} and run(999, 3) == {}


def test_hot_symbols(spark):
    files, symbols, edges = index(spark, {1: "a", 2: "b", 3: "c", 4: "d"}, [(2, 1, "call"), (3, 1, "call"), (4, 1, "ref"), (3, 2, "call"), (4, 2, "call"), (4, 3, "call")])
    view = symbol_view(symbols, files)
    assert [(r["name"], r["in_degree"]) for r in hot_symbols(edges, view, 3).collect()] == [("a", 3), ("b", 2), ("c", 1)]
    assert [(r["name"], r["in_degree"]) for r in hot_symbols(edges, view, 5, ["call"]).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert hot_symbols(edges, view, 0).count() == 0


def test_importers(spark):
    files, symbols, edges = index(spark, {1: "t1", 2: "t2", 3: "a", 4: "b", 5: "x"}, [(3, 1, "call"), (3, 2, "ref"), (4, 1, "call"), (5, 3, "call")], {1: 1, 2: 1, 3: 2, 4: 3, 5: 4})

    def run(target, depth):
        t = spark.createDataFrame([(target,)], "file_id long")
        return {(r["file"], r["edges"], r["depth"]) for r in G.importers(edges, symbols, files, t, depth).collect()}

    assert run(1, 1) == {("f2.rs", 2, 1), ("f3.rs", 1, 1)}
    assert run(1, 2) == {("f2.rs", 2, 1), ("f3.rs", 1, 1), ("f4.rs", 1, 2)}
    assert run(77, 3) == set() and run(1, 0) == set()


def test_why(spark):
    _, _, edges = index(spark, {i: "abcde"[i - 1] for i in range(1, 6)}, [(1, 2, "call"), (2, 3, "call"), (3, 4, "call"), (2, 3, "ref")])

    def run(a, b, d):
        return [(r["src"], r["dst"], r["kind"]) for r in G.why(edges, a, b, d).orderBy("hop").collect()]

    assert run(1, 4, 3) == [(1, 2, "call"), (2, 3, "call"), (3, 4, "call")]
    assert run(1, 4, 2) == [] and run(1, 5, 9) == [] and run(2, 2, 3) == []


def test_cycles_and_orphans(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6), (7, 8), (9, 1)], "src long, dst long")
    assert {(r["node"], r["component"]) for r in G.cycles(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    assert {r["node"] for r in G.orphans(pairs).collect()} == {9}
    assert G.cycles(pairs.limit(0)).count() == 0


def test_crawl(spark):
    pages = spark.createDataFrame([(f"http://s{p}",) for p in ("/", "/a", "/b", "/c")], "url string")
    links = spark.createDataFrame([("http://s/", "http://s/a"), ("http://s/", "http://s/b"), ("http://s/", "http://x/"), ("http://s/a", "http://s/c")], "url string, target string")
    seeds = spark.createDataFrame([("http://s/",)], "url string")
    assert {r["url"] for r in G.crawl(pages, links, seeds, 1).collect()} == {"http://s/", "http://s/a", "http://s/b"}
    assert len(G.crawl(pages, links, seeds, 3, max_pages=2).collect()) == 2


def test_frontier(spark):
    f = spark.createDataFrame([("u1", 1, 1, "queued"), ("u2", 0, 2, "queued"), ("u3", 0, 3, "inflight"), ("u4", 0, 4, "done")], "url string, depth int, seq int, state string")
    assert [r["url"] for r in G.claim(f, 1).collect()] == ["u2"]
    assert {r["url"] for r in G.reopen(f).filter("state = 'queued'").collect()} == {"u1", "u2", "u3"}


def test_affected(spark):
    files = spark.createDataFrame([(1, "src/lib.rs", "rust"), (2, "tests/it.rs", "rust")], FILES)
    symbols = spark.createDataFrame([(1, 1, "core", "function", None, 1, 9), (2, 1, "tests", "module", None, 10, 30), (3, 1, "unit", "function", 2, 11, 15), (4, 2, "integration", "function", None, 1, 5), (5, 1, "plain", "function", None, 40, 45)], SYMBOLS)
    edges = spark.createDataFrame([(3, 1, "call", 12), (4, 1, "ref", 2), (5, 1, "call", 41)], EDGES)
    got = G.affected(edges, symbol_view(symbols, files), spark.createDataFrame([(1,)], "node long"))
    assert {(r["name"], r["depth"]) for r in got.collect()} == {("unit", 1), ("integration", 1)}
    row = spark.range(1).select(G.command_for(F.lit("cargo"), F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("c"), G.command_for(F.lit("go"), F.array().cast("array<string>")).alias("n"), G.runner_of(F.lit("x/go.mod")).alias("r")).first()
    assert (row["c"], row["n"], row["r"]) == ("cargo test -- a b", None, "go")


def test_enclosing(spark):
    symbols = spark.createDataFrame([(1, 1, "outer", "class", None, 1, 400), (2, 1, "inner", "method", 1, 60, 70), (3, 1, "same", "method", 1, 60, 70)], SYMBOLS)
    places = spark.createDataFrame([(1, 64), (1, 300), (1, 500), (2, 3)], "file_id long, line int")
    assert {(r["file_id"], r["line"], r["sym_name"]) for r in enclosing(places, symbols).collect()} == {(1, 64, "inner"), (1, 300, "outer"), (1, 500, None), (2, 3, None)}


def test_diff(spark):
    cols = "file string, name string, signature string, line_start int, line_end int, id long"
    a = spark.createDataFrame([("f", "gone", None, 1, 2, 1), ("f", "sig", "a", 1, 2, 2), ("f", "moved", "a", 1, 2, 3), ("f", "same", None, 5, 6, 4)], cols)
    b = spark.createDataFrame([("f", "sig", None, 9, 9, 2), ("f", "moved", "a", 2, 3, 3), ("f", "same", None, 5, 6, 4), ("f", "more", "x", 1, 1, 9)], cols)
    assert {(r["name"], r["change"]) for r in diff_symbols(a, b).collect()} == {("gone", "removed"), ("sig", "signature_changed"), ("moved", "body_moved"), ("more", "added")}
