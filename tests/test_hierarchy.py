import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparrowdex.operators.components import connected_components
from sparrowdex.operators.hierarchy import descendants, full_paths, heavy_paths, path_segments, separate_cycles


def brute(rows):
    """path from the root of each node, or the smallest id of the closed chain above it."""
    ids = {i for i, _ in rows if i is not None}
    parent = {}
    for i, p in rows:
        if i is not None and p is not None:
            parent[i] = min(parent.get(i, p), p)
    up = {i: parent.get(i) if parent.get(i) in ids else None for i in ids}
    paths, cycles = {}, {}
    for i in ids:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is None:
            paths[i] = seen[::-1]
        else:
            cycles[i] = min(seen[seen.index(at) :])
    return paths, cycles


def check(spark, rows):
    df = spark.createDataFrame(rows, "id long, parent_id long").withColumnRenamed("id", "key")
    tree = heavy_paths(df, "key", "parent_id")
    paths, cycles = brute(rows)
    assert {r["id"]: r["path"] for r in full_paths(tree, block=4).collect()} == paths
    assert {r["id"]: r["cycle_id"] for r in tree.cycles.collect()} == cycles
    assert {r["id"]: r["cycle_id"] for r in separate_cycles(df, "key", "parent_id").collect()} == cycles
    labels = {r["id"]: r for r in tree.labels.collect()}
    below = {i: {j for j, p in paths.items() if i in p} for i in paths}
    for i, r in labels.items():
        assert (r["root"], r["depth"], r["size"]) == (paths[i][0], len(paths[i]) - 1, len(below[i]))
        inside = {j for j, q in labels.items() if q["root"] == r["root"] and r["pre"] <= q["pre"] < r["pre"] + r["size"]}
        assert inside == below[i]
        assert r["light"] <= max(1, len(rows)).bit_length()
    chains, put = {}, {}
    for i, r in labels.items():
        chains.setdefault(r["chain"], {})[r["pos"]] = i
    for r in path_segments(tree).collect():
        put.setdefault(r["id"], {})[r["step"]] = [chains[r["chain"]][k] for k in range(r["upto"] + 1)]
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in put.items()} == paths
    got = {(r["ancestor"], r["id"], r["distance"]) for r in descendants(tree, block=4).collect()}
    assert got == {(a, i, len(p) - 1 - k) for i, p in paths.items() for k, a in enumerate(p[:-1])}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None)],
        [(1, 1), (2, 1), (3, 99), (4, 3), (None, 3), (4, 3), (5, 4)],
        [(i, i - 1 if i else None) for i in range(70)],
        [(0, None)] + [(i, 0) for i in range(1, 60)],
        [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, None), (8, 7), (0, 5)],
    ],
)
def test_shapes(spark, rows):
    check(spark, rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.one_of(st.none(), st.integers(0, 16))), max_size=18))
def test_random(spark, rows):
    check(spark, rows)


def test_long_chain(spark):
    """A chain of 200,000 beside a parent of 50,000 children: labels and pieces of paths, no row of which grows with them."""
    n, wide = 200_000, 50_000
    rows = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id").union(spark.range(n, n + wide).selectExpr("id", "CASE WHEN id > " + str(n) + " THEN " + str(n) + " END AS parent_id"))
    tree = heavy_paths(rows, "id", "parent_id")
    got = tree.labels.selectExpr("count(*)", "max(depth)", "max(size)", "max(pos)", "count(distinct root, pre)", "max(light)").first()
    assert tuple(got) == (n + wide, n - 1, n, n - 1, n + wide, 1)
    assert path_segments(tree).groupBy("id").count().agg({"count": "max"}).first()[0] == 2
    assert tree.cycles.count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (3, 1), (None, 9), (10, 11), (11, 12), (12, 13)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 10: 10, 11: 10, 12: 10, 13: 10}
    assert connected_components(edges.limit(0)).count() == 0
