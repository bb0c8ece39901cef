import pytest
from pyspark.sql import functions as F

from sparrowdex.sources import extract as X


@pytest.mark.parametrize(
    "lang,source,expected",
    [
        ("python", "import os, a.b as c, x.y\nfrom .m.n import (p,\n  q as r)\nfrom z import *\n# import no\n", {("os", "os"), ("c", "a::b"), ("x", "x"), ("p", "m::n::p"), ("r", "m::n::q")}),
        ("typescript", "import d, {a as b, type c} from '../lib/m.ts';\nimport * as ns from \"pkg\"\nimport './side'\n", {("d", "lib::m::default"), ("b", "lib::m::a"), ("c", "lib::m::c"), ("ns", "pkg")}),
        ("rust", "use std::{fmt, io::{self, Read as R}, vec::*};\npub(crate) use a::b::C;\nuse x as y;\n", {("fmt", "std::fmt"), ("io", "std::io"), ("R", "std::io::Read"), ("C", "a::b::C"), ("y", "x")}),
        ("go", 'import "fmt"', set()),
        ("python", "", set()),
        (None, "import a", set()),
    ],
)
def test_imports(lang, source, expected):
    assert set(X.harvest_imports(source, lang)) == expected


def test_order_of_resolution(spark):
    symbols = spark.createDataFrame([(1, 10, "f", "m::f", "function"), (2, 20, "f", "n::f", "function"), (3, 20, "g", None, "function"), (4, 30, "h", "k::h", "function"), (5, 30, "h", "j::h", "function"), (6, 40, "s", None, "sentinel")], "id long, file_id long, name string, qualified string, kind string")
    imports = spark.createDataFrame([(50, "f", "n::f"), (50, "h", "nowhere::h"), (10, "f", "n::f"), (50, "k", "j::h")], "file_id long, local string, qualified string")
    refs = spark.createDataFrame([(10, "f"), (50, "f"), (50, "g"), (50, "h"), (60, "h"), (60, "s"), (50, "k"), (60, "none")], "file_id long, name string")
    got = {(r["file_id"], r["name"]): r["target"] for r in X.resolve_scoped(refs, symbols, imports).collect()}
    assert got == {(10, "f"): 1, (50, "f"): 2, (50, "g"): 3, (50, "h"): 4, (60, "h"): None, (60, "s"): None, (50, "k"): 5, (60, "none"): None}


def test_visibility_in_columns(spark):
    rows = [
        ("rust", "f", " pub (crate) fn f()"), ("rust", "f", "fn f()"), ("go", "Run", "func Run()"), ("go", "run", "func run()"), ("python", "__init__", "def"), ("python", "_x", "def"), ("python", "x", "def"),
        ("typescript", "a", "export class a"), ("tsx", "a", "class a"), ("java", "m", "protected static void m(private int x)"), ("java", "m", "void m()"), ("java", "m", "private public int m()"), ("swift", "f", "fileprivate func f()"), ("swift", "f", "func f(public: Int)"),
        ("c", "f", "static int f("), ("c", "f", "int f("), ("zig", "f", "pub fn f"), ("zig", "f", "fn f"), ("bash", "f", "f() {"), ("ruby", "f", "def f"),
    ]
    df = spark.createDataFrame(rows, "lang string, name string, text string")
    got = [r[0] for r in df.select(X.declared_visibility(F.col("lang"), F.col("name"), F.col("text"))).collect()]
    assert got == [X.visibility(g, t, n) for g, n, t in rows]


def test_long_definitions_and_sizes():
    body = "\n".join("    x();" for _ in range(30_000))
    symbols, edges = X.extract(f"fn long() {{\n{body}\n}}\nfn next() {{ }}\n", "rust")
    assert [(s["name"], s["line_start"], s["line_end"]) for s in symbols] == [("long", 1, 30_002), ("next", 30_003, 30_003)] and len(edges) == 30_000
    assert X.extract("é" * (X.MAX_BYTES // 2 + 1), "python") == ([], [])
