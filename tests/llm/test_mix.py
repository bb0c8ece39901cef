from pathlib import Path

import pytest

from sparrowdex.llm.mix import VOCABULARY, copies, count_tokens, report, sized_documents, solve_rates

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no tokenizer vocabulary here")


def sized(spark, spec):
    rows, i = [], 0
    for source, sizes in spec.items():
        for n in sizes:
            rows.append((i, source, n))
            i += 1
    return spark.createDataFrame(rows, "id long, source string, tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int").selectExpr("*", "1 AS own", "2 AS tokens")


def test_tokens():
    assert count_tokens(None) == 0 and count_tokens("") == 0 and count_tokens("hello world") == 2
    assert count_tokens("a\ud800b") > 0 and count_tokens("x" * 200_000) > 1000


def test_shares(spark):
    rows = sized(spark, {"a": list(range(50, 450)), "b": [200] * 300, "c": [10, 20, 30] * 30, "d": [1000] * 5})
    goal = targets(spark, [("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.05, 6), ("d", 0.1, 1), ("none", 0.05, 2)])
    solved = solve_rates(rows, goal)
    state = {r["source"]: r for r in solved.collect()}
    total = sum(r["own"] for r in state.values())
    assert {s for s, r in state.items() if not r["reachable"]} == {s for s, r in state.items() if r["share"] * total > r["repeats"] * r["own"] or not r["documents"]}
    mixed = copies(rows, solved)
    caps = {"a": 2, "b": 3, "c": 6, "d": 1}
    assert all(0 <= r["copies"] <= caps[r["source"]] for r in mixed.collect()) and mixed.count() == rows.count()
    for r in report(mixed, solved).collect():
        s = state[r["source"]]
        if s["reachable"]:
            assert abs(r["mixed_tokens"] - s["wanted"]) <= 0.01 * s["wanted"]
            assert abs(r["reached_share"] - r["promised_share"]) <= 0.01 * r["promised_share"]
        else:
            assert r["mixed_tokens"] == s["repeats"] * s["own"]
    assert abs(sum(s["wanted"] for s in state.values()) - total) <= 1e-6 * total
    free = [s for s in state.values() if s["reachable"] and s["wanted"] < s["repeats"] * s["own"]]
    assert max(s["wanted"] / s["share"] for s in free) - min(s["wanted"] / s["share"] for s in free) <= 1e-6 * total


def test_second_source_runs_out(spark):
    """b takes over from a, runs out itself, and c takes the rest; a is the only one that misses its own share."""
    rows = sized(spark, {"a": [100] * 10, "b": [100] * 45, "c": [90, 110] * 30})
    state = {r["source"]: r for r in solve_rates(rows, targets(spark, [("a", 0.4, 2), ("b", 0.38, 1), ("c", 0.22, 5)])).collect()}
    assert {s: r["reachable"] for s, r in state.items()} == {"a": False, "b": True, "c": True}
    assert state["a"]["wanted"] == 2000 and state["b"]["wanted"] == 4500 and abs(state["c"]["wanted"] - 5000) < 1


def test_rounding_groups(spark):
    rows = sized(spark, {"a": [100] * 500, "b": [100] * 500})
    solved = solve_rates(rows, targets(spark, [("a", 0.25, 2), ("b", 0.75, 2)]))
    got = report(copies(rows, solved, group_rows=60), solved).collect()
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 for r in got)


def test_edges(spark):
    goal = targets(spark, [("a", 1.0, 1), (None, 0.5, 1), ("a", 0.2, 1), ("z", 0.0, 3), ("n", None, None)])
    docs = spark.createDataFrame([(1, "one two", "a"), (2, None, "a"), (None, "three", "a"), (4, "x", None), (5, "y", "unlisted"), (1, "one two", "a")], "doc_id long, text string, source string").selectExpr("*", "1 AS tokens", "2 AS id")
    own = sized_documents(docs, goal, "doc_id", "text", "source")
    assert sorted(r["tokens"] for r in own.collect()) == [0, 1, 2, 2]
    solved = {r["source"]: r["reachable"] for r in solve_rates(own, goal).collect()}
    assert solved == {"a": True, "z": False, "n": False}
    assert copies(own, solve_rates(own, goal)).count() == 4
    empty = solve_rates(own.limit(0), goal)
    assert {r["source"] for r in empty.filter("not reachable").collect()} == {"a", "z", "n"}
    assert solve_rates(own, goal.limit(0)).count() == 0
