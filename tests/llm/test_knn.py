import struct

import numpy as np
import pytest

from sparrowdex.llm.knn import CentroidGraph, balanced_centroids, decode, decoded, exact_neighbours, nearest_neighbours


def test_decode():
    v = np.array([3.0, -4.0], "<f4")
    assert np.allclose(decode(v.tobytes(), 2, 0), [0.6, -0.8])
    assert np.allclose(decode(struct.pack("<f2b", -0.5, 6, -8), 2, 1), [-0.6, 0.8])
    for bad in ((v.tobytes(), 3, 0), (v.tobytes()[:7], 2, 0), (np.zeros(2, "<f4").tobytes(), 2, 0), (np.array([np.nan, 1], "<f4").tobytes(), 2, 0), (struct.pack("<f2b", float("inf"), 1, 1), 2, 1), (struct.pack("<f2b", 0.0, 1, 1), 2, 1), (v.tobytes(), 2, 7), (None, 2, 0), (b"", 0, 0), (v.tobytes(), None, 0)):
        assert decode(*bad) is None
    assert decode(np.array([1e38, 1e38], "<f4").tobytes(), 2, 0) is not None


def table(spark, x, extra=()):
    rows = [(i, x.shape[1], bytearray(v.astype("<f4").tobytes()), "m", 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), "drawer_id long, dim int, bytes binary, embedding_model string, quant int").selectExpr("*", "1 AS id", "2 AS model", "3 AS vec")


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 20, d))[rng.integers(0, n // 20, n)] + 0.35 * rng.normal(size=(n, d))


@pytest.mark.parametrize("task_rows", [16384, 50])
def test_recall(spark, task_rows):
    vectors = decoded(table(spark, clustered(1500, 24)), "drawer_id")
    got, want = {}, {}
    for r in nearest_neighbours(vectors, list_size=40, sample=700, task_rows=task_rows).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    queries = vectors.filter("id % 20 = 0")
    for r in exact_neighbours(vectors, queries).collect():
        want.setdefault(r["id"], set()).add(r["neighbour"])
    assert len(got) == 1500 and len(want) == 75
    assert sum(len(got[i] & w) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_models(spark):
    x = np.eye(8)[[0] * 15 + [1, 2]]
    extra = [(100, 8, bytearray(np.eye(8)[0].astype("<f4").tobytes()), "other", 0), (101, 8, bytearray(np.eye(8)[0].astype("<f4").tobytes()), None, 0), (102, 9, bytearray(b"xx"), "m", 0), (None, 8, bytearray(np.eye(8)[0].astype("<f4").tobytes()), "m", 0), (3, 8, bytearray(np.eye(8)[0].astype("<f4").tobytes()), "m", 0)]
    out = {}
    for r in nearest_neighbours(decoded(table(spark, x, extra), "drawer_id"), k=10).collect():
        out.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert [out[0][k] for k in range(1, 11)] == list(range(1, 11))
    assert [out[14][k] for k in range(1, 11)] == list(range(10))
    assert 100 not in out and 101 not in out and 102 not in out
    near = nearest_neighbours(decoded(table(spark, x), "drawer_id"), k=10, min_cosine=0.9).collect()
    assert {r["id"] for r in near} == set(range(15))


def test_empty(spark):
    empty = decoded(table(spark, np.eye(4)).limit(0), "drawer_id")
    assert nearest_neighbours(empty).count() == 0 and exact_neighbours(empty, empty).count() == 0


def test_graph_search():
    x = clustered(4000, 16, 3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = CentroidGraph.build(balanced_centroids(x, 600))
    ids, cos = graph.search(x[:200], 10)
    exact = np.argsort(-(x[:200] @ graph.cent.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact)]) > 0.9
    assert (np.diff(cos, axis=1) <= 1e-6).all() and all(len(set(r)) == 10 for r in ids)
