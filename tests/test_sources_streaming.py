import json

from pyspark.sql import functions as F

from sparrowdex.operators.ledger import rate_limit, turn_pairs
from sparrowdex.plans.binding import Tables
from sparrowdex.sources import formats, readers, sinks
from sparrowdex.sources.extract import extract
from sparrowdex.streaming import ledgers


def test_tree(spark, tmp_path):
    files = {"a.py": "def f():\n    g()\n", "b.rs": "pub fn h(x: T) -> U {\n    f(x);\n}\n", "skip/c.py": "x = 1\n", "keep/skip.py": "y = 1\n", "d.bin": "z", "e.py": "\x00bad", ".hid/f.py": "a = 1", "__pycache__/g.py": "b = 1"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = {r["path"]: r["outcome"] for r in readers.read_tree(spark, str(tmp_path), ["skip/", "# note", "!keep/skip.py"]).collect()}
    assert tree["a.py"] == tree["b.rs"] == tree["keep/skip.py"] == "indexed"
    assert tree["skip/c.py"] == "ignored" and tree["d.bin"] == "unsupported" and tree["e.py"] == "binary"
    assert all(v == "ignored" for k, v in tree.items() if k.startswith((".hid", "__pyc")))
    _, symbols, edges, _ = readers.index_tree(spark, str(tmp_path))
    assert {r["name"] for r in symbols.collect()} >= {"f", "h"}
    assert {(r["src_name"], r["dst_name"], r["kind"]) for r in edges.collect()} >= {("f", "g", "call"), ("h", "f", "call"), ("h", "T", "ref")}
    bodies = {r["source_id"]: r["body"] for r in readers.mine_project(spark, str(tmp_path)).collect()}
    assert bodies["proj:a.py"] == files["a.py"] and not any("e.py" in k for k in bodies)


def test_extract():
    symbols, edges = extract("class A:\n    def m(self):\n        return helper(1)\n\ndef _p():\n    A().m()\n", "python")
    assert [(s["name"], s["kind"], s["parent"], s["visibility"]) for s in symbols] == [("A", "class", None, "pub"), ("m", "method", "A", "pub"), ("_p", "function", None, "priv")]
    assert ("m", "helper") in {(e["src_name"], e["dst_name"]) for e in edges}
    symbols, edges = extract('impl Foo {\n  pub fn bar(&self) -> u8 {\n    // baz()\n    qux("zip()")\n  }\n}\n', "rust")
    assert [(s["name"], s["kind"]) for s in symbols] == [("bar", "method")]
    assert {e["dst_name"] for e in edges if e["kind"] == "call"} == {"qux"}
    assert extract("def broken(:", "python") == ([], []) and extract("", "go") == ([], []) and extract("x", None) == ([], [])
    assert [s["visibility"] for s in extract("func Big() {}\nfunc small() {}\n", "go")[0]] == ["pub", "priv"]


def test_formats(spark):
    assert formats.csv_header('a,"b, c",d\n1,2,3') == ["a", "b, c", "d"] and formats.csv_header("") == []
    assert formats.yaml_keys("a:\n  b: 1\n  c:\n    d: 2\n# e: 3\nf: x") == [(1, "a", None), (2, "b", "a"), (3, "c", "a"), (6, "f", None)]
    assert formats.setext_headings("T\n===\nx\n\nS\n---\n") == [(2 - 1, 1, "T"), (5, 2, "S")]
    rows = spark.createDataFrame([("t.csv", "csv", "x,y"), ("d.md", "markdown", "# H\n\n## S #\n"), ("n", None, None)], "path string, lang string, text string")
    assert {(r["name"], r["kind"]) for r in formats.data_symbols(rows).collect()} == {("x", "var"), ("y", "var"), ("H", "class"), ("S", "type")}


def test_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"ts": 1, "op": "sym", "used_tokens": 5, "saved_tokens": 7}\nnot json\n\n{"ts": 2, "op": "refs"}\n')
    assert sorted(r["op"] for r in readers.read_log(spark, str(path)).collect()) == ["refs", "sym"]


def test_transcripts(spark, tmp_path):
    lines = [{"type": "user", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}}, {"type": "user", "message": {"role": "user", "content": "dangling"}}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken{\n")
    turns, skipped = readers.read_transcripts(spark, str(tmp_path))
    assert [r["body"] for r in turn_pairs(turns).collect()] == ["USER: hi\n\nASSISTANT: a\nb"]
    assert [r["skipped"] for r in skipped.collect()] == [1]


def test_fetched(spark):
    pages = spark.createDataFrame([("u1", 200, "t", "old", None, 1, 1), ("u1", 200, "t", "new", None, 2, 2)], "url string, status int, title string, content_markdown string, error string, fetched_at long, page_id long")
    got = readers.fetched(spark.createDataFrame([(1, "u2"), (2, "u1")], "n int, url string"), pages).collect()
    assert [(r["url"], r["content"], r["error"]) for r in got] == [("u2", None, "not fetched"), ("u1", "new", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string")
    for stamp in (1, 2, 3):
        sinks.snapshot({"t": df}, str(tmp_path / "s"), stamp)
    assert sinks.prune_snapshots(spark, str(tmp_path / "s"), 2) == [1] and sinks.snapshots(spark, str(tmp_path / "s")) == [3, 2]
    assert sinks.restore(spark, str(tmp_path / "s"), 3, "t").count() == 2
    assert sorted(r["line"] for r in sinks.as_markdown(df).collect()) == ["| 1 | a\\|b |", "| 2 |  |"]
    sinks.write_ndjson(df, str(tmp_path / "j"), gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.as_json(df).count() == sinks.event_frames(df).count() == 2
    assert sinks.cached_graph(spark, str(tmp_path / "g"), lambda: df).count() == sinks.cached_graph(spark, str(tmp_path / "g"), lambda: df.limit(0)).count() == 2


def _stream(spark, small, tmp_path):
    rows = Tables(spark, small).events
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, ledgers.read_events(spark, str(tmp_path / "in"))


def test_stream_loops(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    ledgers.run_to_end(ledgers.loop_counts(stream), "loops_out", "complete")
    got = {(r["event_type"], r["user_id"]): r["times"] for r in spark.table("loops_out").collect()}
    assert got == {(r["event_type"], r["user_id"]): r["count"] for r in rows.groupBy("event_type", "user_id").count().collect()}


def test_stream_usage(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    ledgers.run_to_end(ledgers.windowed_usage(stream), "usage_out", "complete")
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("usage_out").collect()}
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_rate_limit(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    ledgers.run_to_end(ledgers.rate_limited(stream), "rate_out")
    got = {r["event_id"]: r["used"] for r in spark.table("rate_out").collect()}
    batch = rate_limit(rows.select("event_id", F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts")))
    assert got == {r["event_id"]: r["used"] for r in batch.collect()}


def test_stream_watch_and_egress(spark, tmp_path):
    spark.createDataFrame([(1, "a.site.example"), (2, "evil.test")], "ts long, host string").write.json(str(tmp_path / "log"))
    log = spark.readStream.schema("ts long, host string").json(str(tmp_path / "log"))
    rules = spark.createDataFrame([("*.site.example",)], "rule string")
    seen = []
    q = ledgers.watch(ledgers.egress_verdicts(log, rules), lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {(r["host"], r["ok"]) for r in seen} == {("a.site.example", True), ("evil.test", False)}
    spark.createDataFrame([(1, 5, "m"), (2, 50, "n")], "id long, due_at long, message string").write.parquet(str(tmp_path / "rem"))
    stream = spark.readStream.schema("id long, due_at long, message string").parquet(str(tmp_path / "rem"))
    ledgers.deliver_once(stream, 10, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
