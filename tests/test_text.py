import math

from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.functions import udfs as P
from sparrowdex.operators import ledger as E
from sparrowdex.operators.lookup import compact_snippet


def one(spark, value, *cols):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_squeeze(spark):
    assert one(spark, "10%\r45%\r100%\ndone\n", T.squeeze) == ("100%\ndone\n",)
    assert one(spark, "a\na\na\nb", T.squeeze) == ("a\n[repeated 3x]\nb",)
    text = "\n".join(f"l{i}" for i in range(9)) + "\nbad error\n" + "\n".join(f"m{i}" for i in range(9))
    assert one(spark, text, lambda c: T.squeeze(c, 4)) == ("l0\nl1\n[... 15 lines elided; 1 error/warning line(s) surfaced ...]\nbad error\nm7\nm8",)


def test_snippet(spark):
    assert one(spark, "€" * 100, compact_snippet) == ("€" * 80 + "…",)
    assert one(spark, " a \t b\n", compact_snippet) == ("a b",)


def test_rules(spark):
    code = "let x = 1;\nlet x = 1;\n// let y = 2;\nif true {\nlet z = x + 0;\n   \n"
    row = one(spark, code, lambda c: F.size(T.repeated_lines(c)), lambda c: F.size(T.dead_code(c)), lambda c: F.size(T.trivial_conditions(c)), lambda c: F.size(T.foldable(c)), lambda c: F.size(T.blank_lines(c)), lambda c: P.compact()(c)["text"])
    assert row[:5] == (1, 1, 1, 1, 1)
    assert row[5] == "let x = 1;\nif true {\nlet z = x;"


def test_compaction():
    code = "let x = 1;\nlet x = 1;\n// let y = 2;\nkeep // let y = 2; too\nif true {\n"
    assert P.compact_text(code) == ("let x = 1;\nif true {", ["repeats", "conditions", "dead code"], 1 - 2 / 5)
    assert P.compact_text(code, least=3) == ("let x = 1;\nlet x = 1;\nif true {", ["dead code"], 1 - 3 / 5)  # repeats and the condition save two tokens each
    assert P.compact_text(code, most_disruption=0.5) == (code, [], 0.0)
    assert P.compact_text("plain\n") == ("plain\n", [], 0.0) and P.compact_text("") == ("", [], 0.0)
    assert P.compact_text("x = 1 * x + 1 + 0\n") == ("x = x + 1\n", ["folds"], 1.0)


def test_trigram_similarity(spark):
    rows = spark.createDataFrame([("abcd", "abce", 1 / 3), ("", "ab", 1.0), ("abc", "", 0.0), ("é€", "é€", 1.0), (None, "a", None)], "a string, b string, want double")
    for r in rows.select("want", P.trigram_similarity("a", "b").alias("got"), T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b"))).alias("expression")).collect():
        assert r["got"] == r["want"] and (r["want"] is None or r["expression"] == r["want"])


def test_diff_only_if_shorter(spark):
    old = "\n".join(f"line {i} of a text" for i in range(60))
    rows = spark.createDataFrame([(old, old.replace("line 7 of", "row 7 of")), ("a", "b"), (None, "b")], "a string, b string")
    got = [r[0] for r in rows.select(P.diff_of("a", "b")).collect()]
    assert got[0].startswith("--- a/text") and len(got[0]) < len(old) and got[1:] == ["b", None]


def test_empty_and_null(spark):
    for value in ("", None):
        one(spark, value, T.token_count, T.squeeze, P.compact(), T.strip, T.entropy, lambda c: T.cut_bytes(c, 3), T.error_lines, lambda c: T.head_tail(c, 1, 1), lambda c: F.size(T.trigrams(c)), T.plain_markdown, T.limit_blank_runs, T.slug)


def test_cut_bytes(spark):
    assert one(spark, "aé€😀", *[(lambda c, n=n: T.cut_bytes(c, n)) for n in range(0, 12)]) == ("", "a", "a", "aé", "aé", "aé", "aé€", "aé€", "aé€", "aé€", "aé€😀", "aé€😀")


def test_entropy(spark):
    assert abs(one(spark, "aabb", T.entropy)[0] - 1) < 1e-12 and one(spark, "aaaa", T.entropy)[0] == 0
    assert abs(one(spark, "abcd", T.entropy)[0] - math.log2(4)) < 1e-12


def test_blank_runs(spark):
    assert one(spark, "a\n\n\n\n\nb\nb", T.limit_blank_runs) == ("a\n\n\nb\nb",)


def test_waste(spark):
    lines = spark.createDataFrame([("s", "abcd")] * 3 + [("s", "x" * 50_000)], "session string, line string")
    assert {(r["kind"], r["tokens"]) for r in E.waste(lines).collect()} == {("duplicate_read", 2), ("huge_tool_output", 12_500)}


def test_pairs(spark):
    turns = spark.createDataFrame([("c", 0, "system", "s"), ("c", 1, "user", "a"), ("c", 2, "user", "b"), ("c", 3, "assistant", "x"), ("c", 4, "assistant", "y"), ("c", 5, "user", "z")], "conv string, turn int, role string, text string")
    assert [r["body"] for r in E.turn_pairs(turns).orderBy("turn").collect()] == ["USER: b\n\nASSISTANT: x", "USER: \n\nASSISTANT: y"]


def test_proxies(spark):
    rows = [("p", t, t, ok) for t, ok in enumerate([False, False, True, False, False])] + [("q", t, t, False) for t in range(3)]
    assert [r["proxy"] for r in E.proxies_left(spark.createDataFrame(rows, "proxy string, ts int, seq int, ok boolean")).collect()] == ["p"]
