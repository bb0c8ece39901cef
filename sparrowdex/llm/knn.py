"""Most similar vectors for every vector, by balanced posting lists.

An index of posting lists is fitted on a bounded sample (balanced spherical
k-means); every vector is stored in the list of its nearest centroid and, near a
border, in those of further centroids; a query reads the lists whose centroids
lie within a ratio of the nearest one's distance.  Centroids are found through a
proximity graph in memory.  All vectors are indexed and all are queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.runtime import written


def decode(blob: bytes | None, dim, quant) -> np.ndarray | None:
    """Unit vector of a stored row; None if it does not decode to dim finite numbers, not all zero."""
    if blob is None or dim is None or quant is None or dim != dim or quant != quant or dim <= 0:
        return None
    dim, quant = int(dim), int(quant)
    if quant == 0 and len(blob) == 4 * dim:
        v = np.frombuffer(blob, "<f4").astype(np.float64)
    elif quant == 1 and len(blob) == 4 + dim:
        v = float(np.frombuffer(blob, "<f4", 1)[0]) * np.frombuffer(blob, np.int8, dim, 4).astype(np.float64)
    else:
        return None
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0 or not np.isfinite(v).all():
        return None
    v = v / top
    return (v / np.sqrt(v @ v)).astype(np.float32)


def decoded(rows: DataFrame, id_col: str, blob: str = "bytes", dim: str = "dim", quant: str = "quant", model: str = "embedding_model") -> DataFrame:
    """(id, model, vec, hi, lo): unit vectors as float32 bytes with a 128-bit key of them.

    A model holds vectors of one dimension: the dimension is part of its name
    here.  Rows without an id or model and rows that do not decode take no part;
    of repeated ids one row takes part.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(dim).alias("dim"), F.col(quant).alias("quant"), F.col(model).alias("model"), F.col(blob).alias("blob"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, d, q, m, b in pdf.itertuples(index=False):
                v = decode(b, d, q)
                if v is not None:
                    raw = v.tobytes()
                    key = xxhash.xxh3_128_intdigest(raw)
                    out.append((i, f"{int(d)}:{m}", raw, (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)))
            yield pd.DataFrame(out, columns=["id", "model", "vec", "hi", "lo"]).astype({"id": "int64", "hi": "int64", "lo": "int64"})

    return own.filter("id IS NOT NULL AND model IS NOT NULL").mapInPandas(run, "id long, model string, vec binary, hi long, lo long")


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means whose assignment is charged for the size a cluster already has."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    cent = x[rng.choice(len(x), lists, replace=False)].copy()
    charge = np.zeros(lists, dtype=np.float32)
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[lo : lo + 4096] @ cent.T - charge, axis=1) for lo in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=lists)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], np.cumsum(size)[:-1]]), len(x) - 1), axis=0)
        live = size > 0
        cent[live] = sums[live]
        if (~live).any():
            cent[~live] = x[rng.choice(len(x), int((~live).sum()))]
        cent /= np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-12)
        charge = (0.05 * (size / max(1.0, size.mean()) - 1).clip(0, 3)).astype(np.float32)
    return cent


@dataclass
class CentroidGraph:
    """Centroids with their nearest centroids, searched best first from some hubs."""

    cent: np.ndarray
    near: np.ndarray
    hubs: np.ndarray

    @classmethod
    def build(cls, cent: np.ndarray, degree: int = 24) -> CentroidGraph:
        n = len(cent)
        degree = min(degree, n - 1)
        near = np.zeros((n, degree), dtype=np.int32)
        for lo in range(0, n, 1024):
            s = cent[lo : lo + 1024] @ cent.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
            if degree:
                near[lo : lo + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        hubs = np.linspace(0, n - 1, min(n, max(64, int(4 * math.sqrt(n))))).astype(int)
        return cls(cent, near, np.unique(hubs))

    def search(self, q: np.ndarray, m: int, ratio: float = 1e9, expand: int = 4, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the m nearest centroids of each row, nearest first.

        Beyond the nearest few, only centroids within the ratio of the nearest one's distance are followed.
        """
        n = len(self.cent)
        m = min(m, n)
        if n <= 2 * m or n <= len(self.hubs):
            s = q @ self.cent.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :m]
            return best, np.take_along_axis(s, best, axis=1)
        s = q @ self.cent[self.hubs].T
        start = np.argsort(-s, axis=1, kind="stable")[:, : max(m, 8)]
        ids, val = self.hubs[start], np.take_along_axis(s, start, axis=1)
        open_ = np.ones(ids.shape, dtype=bool)
        for _ in range(rounds):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * val[:, :m]))
            follow = open_[:, :m] & ((d <= ratio * d[:, :1] + 1e-6) | (np.arange(d.shape[1]) < expand))
            busy = np.flatnonzero(follow.any(axis=1))  # the other rows have ended
            if not len(busy):
                break
            i, v, o = ids[busy], val[busy], open_[busy]
            pick = np.argsort(np.where(follow[busy], -v[:, :m], np.inf), axis=1, kind="stable")[:, :expand]
            live = np.take_along_axis(follow[busy], pick, axis=1)
            np.put_along_axis(o, pick, False, axis=1)
            new = self.near[np.take_along_axis(i, pick, axis=1)].reshape(len(busy), -1)
            known = np.zeros((len(busy), n), dtype=bool)
            r, c = np.nonzero(np.isfinite(v))
            known[r, i[r, c]] = True
            fresh = ~np.take_along_axis(known, new, axis=1) & np.repeat(live, self.near.shape[1], axis=1)
            r, c = np.nonzero(fresh)
            pair = np.unique(r * n + new[r, c])
            r, c = pair // n, pair % n
            at = np.arange(len(r)) - np.searchsorted(r, r)
            width = int(at.max()) + 1 if len(at) else 0
            new, sc = np.zeros((len(busy), width), dtype=ids.dtype), np.full((len(busy), width), -np.inf, dtype=val.dtype)
            new[r, at], sc[r, at] = c, np.einsum("pd,pd->p", q[busy[r]], self.cent[c])
            all_val = np.concatenate([v, sc], axis=1)
            keep = np.argsort(-all_val, axis=1, kind="stable")[:, : ids.shape[1]]
            for into, part in ((ids, np.concatenate([i, new], axis=1)), (val, all_val), (open_, np.concatenate([o, np.ones(new.shape, dtype=bool)], axis=1))):
                into[busy] = np.take_along_axis(part, keep, axis=1)
        return ids[:, :m], val[:, :m]


def _pruned(cent: np.ndarray, ids: np.ndarray, d: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Mask of the lists that boundary vectors go to: within the ratio, and not behind one already taken.

    ids, d: nearest lists of each vector, nearest first, and their distances.  A
    list is behind another one if the two are nearer to each other than the vector is.
    """
    n, m = ids.shape
    m = min(m, 4 * most)
    near = cent[ids[:, :m]]
    taken = np.zeros(ids.shape, dtype=bool)
    taken[:, 0] = True
    for j in range(1, m):
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", near[:, j], near[:, :j])))
        free = (np.where(taken[:, :j], gap, np.inf) > d[:, j : j + 1]).all(axis=1)
        taken[:, j] = free & (d[:, j] <= ratio * d[:, 0] + 1e-6) & (taken[:, :j].sum(axis=1) < most)
    return taken


def probes_for(lists: int, least: int, growth: float) -> int:
    """How many nearest lists the distance ratio chooses from: all of few, and a number that grows with their root."""
    return min(lists, max(least, math.ceil(growth * math.sqrt(lists))))


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 10,
    min_cosine: float | None = None,
    list_size: int = 512,
    sample: int = 32768,
    max_lists: int = 16384,
    store_ratio: float = 1.15,
    max_stored: int = 4,
    probe_ratio: float = 1.35,
    least_probes: int = 24,
    probe_growth: float = 3.0,
    together: int = 24,
    task_rows: int = 32768,
) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar vectors of the same model.

    vectors: the output of decoded().  Ties go to the smaller id; a vector is
    never its own neighbour.  With min_cosine only neighbours of at least that
    cosine come out, with the ranks they have among all.  The posting lists are
    fitted on at most `sample` vectors a model; `together` neighbouring lists
    travel as one group, to which a vector is sent once with the lists it is
    stored in and asks.  Groups beyond `task_rows` rows are searched in several
    tasks.  A vector asks the lists within probe_ratio of its nearest one's
    distance, of the probes_for() nearest lists.  Equal vectors are searched once
    and unfolded: a vector's equals rank first, by id, and no more than the k + 1
    smallest ids of equal vectors can be anyone's neighbours.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    own = written(vectors.select("id", "model", "hi", "lo"), "keys")
    heads = own.groupBy("model", "hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    multi = heads.filter("n > 1")
    members = written(own.distinct().join(multi.select("model", "hi", "lo", F.col("id").alias("head")), ["model", "hi", "lo"]).select("head", "id").distinct(), "members")
    again = written(own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    unique = vectors.select("id", "model", "vec").join(members.filter("id <> head").select("id").distinct(), "id", "left_anti")
    unique = unique.join(again, "id", "left_anti").unionByName(unique.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("model", F.struct("model", "vec")).alias("model"), F.min_by("vec", F.struct("model", "vec")).alias("vec")))

    counts = {r["model"]: r["n"] for r in own.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    rate = F.element_at(F.create_map(*[x for m, n in counts.items() for x in (F.lit(m), F.lit(math.ceil((1 << 20) * min(1.0, sample / n))))]), F.col("model"))
    got = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate).select("model", "vec").toPandas()
    index, parts, first_list, first_group = {}, {}, 0, 0
    for model, part in sorted(got.groupby("model")["vec"]):
        x = np.vstack([np.frombuffer(v, np.float32) for v in part])
        graph = CentroidGraph.build(balanced_centroids(x, min(max_lists, math.ceil(counts[model] / list_size))))
        hubs = balanced_centroids(graph.cent, math.ceil(len(graph.cent) / together))
        group = np.argmax(graph.cent @ hubs.T, axis=1)
        index[model] = (first_list, first_group + group, graph)
        # rows that a group will get, by the draw; this decides on the split over tasks alone
        held = np.concatenate([np.argmax(x[lo : lo + 4096] @ graph.cent.T, axis=1) for lo in range(0, len(x), 4096)])
        for g, m in enumerate(np.bincount(group[held], minlength=len(hubs))):
            parts[first_group + g] = math.ceil(1.5 * m / len(x) * counts[model] / task_rows)
        first_list += len(graph.cent)
        first_group += len(hubs)
    for model in set(counts) - set(index):  # too few rows for the draw: one list
        index[model] = (first_list, np.array([first_group]), None)
        first_list, first_group = first_list + 1, first_group + 1
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model", sort=False):
                first, group, graph = shared.value[model]
                for lo in range(0, len(part), 256):
                    rows = part.iloc[lo : lo + 256]
                    vec, n = rows["vec"].to_numpy(), len(rows)
                    if graph is None:
                        ids, probe, store = np.zeros((n, 1), int), np.ones((n, 1), bool), np.ones((n, 1), bool)
                    else:
                        q = np.vstack([np.frombuffer(v, np.float32) for v in vec])
                        ids, cos = graph.search(q, probes_for(len(graph.cent), least_probes, probe_growth), probe_ratio)
                        d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
                        probe = d <= probe_ratio * d[:, :1] + 1e-6
                        store = _pruned(graph.cent, ids, d, store_ratio, max_stored)
                    r, c = np.nonzero(probe | store)
                    to = group[ids[r, c]]
                    order = np.lexsort((to, r))
                    r, c, to = r[order], c[order], to[order]
                    at = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
                    lists = ((first + ids[r, c]) * 4 + 2 * store[r, c] + probe[r, c]).astype(np.int32)  # the list, whether stored there, whether asked
                    ends = np.append(at[1:], len(r))
                    yield pd.DataFrame({"grp": to[at], "id": rows["id"].to_numpy()[r[at]], "vec": vec[r[at]], "lists": [lists[x:y].tobytes() for x, y in zip(at, ends)]})

    placing = "grp long, id long, vec binary, lists binary"
    placed = unique.mapInPandas(place, placing)
    large = {g: n for g, n in parts.items() if n > 1}

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.frombuffer(v, np.float32) for v in pdf["vec"]])
        ids = pdf["id"].to_numpy()
        lists = [np.frombuffer(b, np.int32) for b in pdf["lists"]]
        row, flat = np.repeat(np.arange(len(ids)), [len(b) for b in lists]), np.concatenate(lists)
        as_post, as_ask = (pdf[c].to_numpy()[row] if c in pdf else np.ones(len(row), bool) for c in ("posts", "asks"))
        best_v, best_i = np.full((len(ids), k), -np.inf, np.float32), np.full((len(ids), k), np.iinfo(np.int64).max)
        order = np.argsort(flat >> 2, kind="stable")
        for here in np.split(order, np.flatnonzero(np.diff(flat[order] >> 2)) + 1):
            post, ask = row[here[(flat[here] & 2 > 0) & as_post[here]]], row[here[(flat[here] & 1 > 0) & as_ask[here]]]
            post = post[np.argsort(ids[post], kind="stable")]
            for lo in range(0, len(ask) if len(post) else 0, 1024):
                rows = ask[lo : lo + 1024]
                s = x[rows] @ x[post].T
                s[ids[rows][:, None] == ids[post][None, :]] = -np.inf
                if min_cosine is not None:
                    s[s < min_cosine - 1e-6] = -np.inf
                kk = min(k, s.shape[1])
                cutoff = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk][:, None]
                r, c = np.nonzero((s >= np.maximum(cutoff, best_v[rows, -1:])) & np.isfinite(s))
                if not len(r):
                    continue
                # candidates of this list and the best so far, each neighbour once, by cosine and id
                changed = np.unique(r)
                old = np.repeat(changed, k)
                cand_r = np.concatenate([old, r])
                cand_v = np.concatenate([best_v[rows[changed]].ravel(), s[r, c]])
                cand_i = np.concatenate([best_i[rows[changed]].ravel(), ids[post[c]]])
                sort = np.lexsort((-cand_v, cand_i, cand_r))
                cand_r, cand_v, cand_i = cand_r[sort], cand_v[sort], cand_i[sort]
                once = np.append(True, (cand_r[1:] != cand_r[:-1]) | (cand_i[1:] != cand_i[:-1])) & np.isfinite(cand_v)
                cand_r, cand_v, cand_i = cand_r[once], cand_v[once], cand_i[once]
                sort = np.lexsort((cand_i, -cand_v, cand_r))
                cand_r, cand_v, cand_i = cand_r[sort], cand_v[sort], cand_i[sort]
                starts = np.flatnonzero(np.append(True, cand_r[1:] != cand_r[:-1]))
                rank = np.arange(len(cand_r)) - np.repeat(starts, np.diff(np.append(starts, len(cand_r))))
                ok = rank < k
                best_v[rows[changed]], best_i[rows[changed]] = -np.inf, np.iinfo(np.int64).max
                best_v[rows[cand_r[ok]], rank[ok]], best_i[rows[cand_r[ok]], rank[ok]] = cand_v[ok], cand_i[ok]
        r, c = np.nonzero(np.isfinite(best_v))
        if not len(r):
            return pd.DataFrame({"id": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "cosine": np.empty(0)})
        by_id = np.argsort(ids, kind="stable")
        other = by_id[np.searchsorted(ids[by_id], best_i[r, c])]
        exact = np.concatenate([np.einsum("ij,ij->i", x[r[lo : lo + 65536]].astype(np.float64), x[other[lo : lo + 65536]].astype(np.float64)) for lo in range(0, len(r), 65536)])
        return pd.DataFrame({"id": ids[r], "neighbour": best_i[r, c], "cosine": exact})

    if not large:
        near = placed.groupBy("grp").applyInPandas(search, "id long, neighbour long, cosine double")
    else:  # stored rows of one part meet the askers of one part; a row serves as both where its two parts are the same
        n = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for item in large.items() for x in item]), F.col("grp")), F.lit(1).cast("long"))
        cell = placed.withColumn("parts", n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
        cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        as_post = cell.select("grp", F.col("own").alias("p"), F.col("other").alias("q"), "id", "vec", "lists", F.lit(True).alias("posts"), (F.col("own") == F.col("other")).alias("asks"))
        as_ask = cell.filter("own <> other").select("grp", F.col("other").alias("p"), F.col("own").alias("q"), "id", "vec", "lists", F.lit(False).alias("posts"), F.lit(True).alias("asks"))
        near = as_post.unionByName(as_ask).groupBy("grp", "p", "q").applyInPandas(search, "id long, neighbour long, cosine double")
    near = near.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = [F.desc("cosine"), "neighbour"]
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    return _unfold(near, members, order, k)


def _unfold(near: DataFrame, members: DataFrame, order: list, k: int) -> DataFrame:
    """Give every member of a class of equal vectors its neighbours: its equals and the classes' near their head."""
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
    equals = members.alias("m").join(least.alias("l"), F.expr("m.head = l.head AND m.id <> l.id")).select(F.col("m.id").alias("id"), F.col("l.id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    wide = near.join(least.select(F.col("head").alias("neighbour"), F.col("id").alias("other")), "neighbour", "left")
    wide = wide.select("id", F.coalesce("other", "neighbour").alias("neighbour"), "cosine")
    wide = wide.join(members.select(F.col("head").alias("id"), F.col("id").alias("self")), "id", "left").select(F.coalesce("self", "id").alias("id"), "neighbour", "cosine")
    out = wide.unionByName(equals).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return out.filter(F.col("rank") <= k)


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(id, neighbour, cosine, rank): brute force of a stated query set against all rows.

    Both tables are outputs of decoded().  The queries pass in blocks of bounded
    size, each against every partition of the vectors, so that recall can be
    measured on any table.
    """
    spark = vectors.sparkSession
    out = None
    for model in [r[0] for r in queries.select("model").distinct().collect()]:
        own = queries.filter(F.col("model") == model).select("id", "vec")
        n = own.count()
        for part in range(math.ceil(n / block)):
            got = own.filter(F.pmod(F.xxhash64("id"), F.lit(math.ceil(n / block))) == part).toPandas()
            shared = spark.sparkContext.broadcast((got["id"].to_numpy(), np.vstack([np.frombuffer(v, np.float32) for v in got["vec"]]) if len(got) else None))

            def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                ids, q = shared.value
                for pdf in batches:
                    if not len(pdf) or q is None:
                        continue
                    pid = pdf["id"].to_numpy()
                    s = q @ np.vstack([np.frombuffer(v, np.float32) for v in pdf["vec"]]).T
                    s[ids[:, None] == pid[None, :]] = -np.inf
                    kk = min(k + 1, s.shape[1])
                    c = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                    r = np.repeat(np.arange(len(ids)), kk)
                    c = c.ravel()
                    ok = np.isfinite(s[r, c])
                    yield pd.DataFrame({"id": ids[r[ok]], "neighbour": pid[c[ok]], "cosine": s[r[ok], c[ok]].astype(np.float64)})

            near = vectors.filter(F.col("model") == model).mapInPandas(scan, "id long, neighbour long, cosine double")
            out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("rank") <= k)
