"""Document store and retrieval: deduplication, BM25, exact vector search, fusion, quantisation, deletes.

Ranked lists are top-k plans that keep ids and scores; bodies are joined to the
survivors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.functions.text import cut_bytes

K1, B = 1.2, 0.75
RRF_K = 60
# Fixed value: Latin letters with marks and the letters they fold to.
MARKED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


class SearchMode(Enum):
    """How a search ranks, with the other names of each way."""

    HYBRID = ("hybrid", "rrf", "fusion")
    LEXICAL = ("lexical", "fts", "bm25", "text")
    VECTOR = ("vector", "knn", "ann", "embed")

    @classmethod
    def parse(cls, name: str | None, default: str = "lexical") -> SearchMode:
        """The mode of a name in any case; the default without a name; a ValueError for an unknown one."""
        wanted = (name or default).strip().lower()
        for mode in cls:
            if wanted in mode.value:
                return mode
        raise ValueError(f"unknown search mode {name!r}")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without marks."""
    return F.filter(F.split(F.translate(F.lower(text), MARKED, FOLDED), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", text.lower().translate(str.maketrans(MARKED, FOLDED))) if w]


def bm25(docs: DataFrame, query: str, limit: int | None = None, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """(id, score): documents with a term of the query; a term given twice counts twice; ties by id.

    Only query terms leave the scan, with the length of their document; corpus
    statistics are one row.  An idf that is not positive becomes 1e-6.  A query
    without terms finds nothing.
    """
    asked = query_terms(query)
    own = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    stats = own.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg"))
    weight = {q: asked.count(q) for q in asked}
    kept = own.select("id", F.size("t").alias("len"), F.explode(F.filter("t", lambda x: x.isin(*weight) if weight else F.lit(False))).alias("term"))
    tf = kept.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    times = F.coalesce(*[F.when(F.col("term") == q, F.lit(c)) for q, c in weight.items()], F.lit(0))
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    rows = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    out = rows.select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), "id").limit(limit) if limit is not None else out


def overlap_score(docs: DataFrame, query: str, limit: int | None = None, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """(id, score): share of the query's terms, repeated ones counted each time, that a document holds; above 0 only."""
    asked = query_terms(query)
    have = terms(F.coalesce(F.col(text_col), F.lit("")))
    hit = sum((F.array_contains(have, q).cast("int") for q in asked), F.lit(0))
    out = docs.select(F.col(id_col).alias("id"), (hit / F.lit(max(1, len(asked)))).alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for arrays of different length, empty ones and zeros."""
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), _dot(a, b) / n).otherwise(0.0)


def _scores(kind: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(rows of x, rows of q) scores of vectors of one length."""
    if kind == "hamming":
        return (np.where(x >= 0, 1.0, -1.0) @ np.where(q >= 0, 1.0, -1.0).T) / x.shape[1]
    dots = np.einsum("id,jd->ij", x, q)  # one order of additions for every pair, so that equal vectors tie
    nx, nq = np.einsum("id,id->i", x, x), np.einsum("jd,jd->j", q, q)
    if kind == "l2":
        return np.maximum(0.0, 1 - np.maximum(nx[:, None] + nq[None, :] - 2 * dots, 0) / 2)
    norm = np.sqrt(nx)[:, None] * np.sqrt(nq)[None, :]
    return np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, score: str = "cosine", id_col: str = "id", vec_col: str = "vec", block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of a stated set of queries(query_id, query_vec), exactly.

    score: cosine, l2 (max(0, 1 - d^2 / 2)) or hamming (1 - 2 h / dim of the signs).
    Queries travel in blocks of bounded size; every batch of vectors gives no more
    than its own k best a query.  Scores count to twelve digits, ties go to the
    smaller id; null, empty and other-length vectors score 0.  No queries, no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("q"))
    blocks, out = math.ceil(asked.count() / block), None
    for n in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas()
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), [np.array([] if v is None else v, dtype=np.float64) for v in part["q"]]))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, qs = shared.value
            lengths = np.array([len(q) for q in qs])
            for pdf in batches:
                if not len(pdf) or not len(qid):
                    continue
                ids, own = pdf["id"].to_numpy(), np.array([0 if v is None else len(v) for v in pdf["v"]])
                s = np.zeros((len(ids), len(qid)))
                for d in set(lengths.tolist()) & set(own.tolist()) - {0}:
                    i, j = np.flatnonzero(own == d), np.flatnonzero(lengths == d)
                    s[np.ix_(i, j)] = _scores(score, np.vstack(pdf["v"].to_numpy()[i]), np.vstack([qs[x] for x in j]))
                s = np.round(s, 12)
                order = np.argsort(ids, kind="stable")
                top = order[np.argsort(-s[order], axis=0, kind="stable")[:k]]
                at = np.repeat(np.arange(len(qid)), len(top))
                i = top.T.ravel()
                yield pd.DataFrame({"query_id": qid[at], "id": ids[i], "score": s[i, at]})

        got = rows.mapInPandas(best, "query_id long, id long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(rankings: Sequence[DataFrame], limit: int) -> DataFrame:
    """(id, score): reciprocal-rank fusion of lists (id, rank), ties by id."""
    both = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def ranked(rows: DataFrame) -> DataFrame:
    """Number a short list (id, score) from 1, best first, ties by id."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vec: DataFrame, limit: int) -> DataFrame:
    """(id, score): fusion of twice the limit from BM25 and from the vectors."""
    lex = ranked(bm25(docs, query, 2 * limit))
    vec = vector_search(vectors, query_vec, 2 * limit).select("id", "rank")
    return fuse([lex, vec], limit)


def search(mode: SearchMode, docs: DataFrame, vectors: DataFrame, query: str, query_vec: DataFrame, limit: int) -> DataFrame:
    """(id, score) of a search in one of the modes."""
    if mode is SearchMode.LEXICAL:
        return bm25(docs, query, limit)
    if mode is SearchMode.VECTOR:
        return vector_search(vectors, query_vec, limit).select("id", "score")
    return hybrid(docs, vectors, query, query_vec, limit)


def dedup(drawers: DataFrame) -> DataFrame:
    """(id, kept_id): every drawer and the first one with its source and body.

    The first id of a key is aggregated and joined back, so that a key with a third
    of all rows is combined before it is shuffled.
    """
    own = drawers.select("id", F.col("source_id").isNull().alias("no_source"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"))
    own = own.withColumn("sha", F.coalesce("sha", F.lit("")))  # a null body has no hash
    keys = ["no_source", "source_id", "sha"]
    return own.join(own.groupBy(*keys).agg(F.min("id").alias("kept_id")), keys).select("id", "kept_id")


def add_documents(store: DataFrame, new: DataFrame) -> DataFrame:
    """A store (id, source_id, sha256, ...) with the new rows whose source and body it does not hold yet, the first of equal ones."""
    first = new.join(dedup(new).filter("id = kept_id").select("id"), "id", "left_semi")
    return store.unionByName(first.join(store.select("source_id", "sha256"), ["source_id", "sha256"], "left_anti").select(*store.columns))


def delete(store: DataFrame, ids: DataFrame | None = None, source: str | None = None, before: int | None = None, wing: str | None = None, everything: bool = False) -> DataFrame:
    """What stays: without the ids, a source, or a wing's rows from before a time (not at it)."""
    if everything:
        return store.limit(0)
    out = store
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_anti")
    if source is not None:
        out = out.filter(~F.col("source_id").eqNullSafe(F.lit(source)))
    if before is not None:
        hit = F.col("created_at") < before
        hit = hit if wing is None else hit & (F.col("wing") == wing)
        out = out.filter(~F.coalesce(hit, F.lit(False)))
    return out


def quantise(vec: Column) -> Column:
    """struct<scale, q>: one byte a component, rounded half away from zero."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    q = F.transform(vec, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))))
    return F.struct(scale.alias("scale"), q.alias("q"))


def dequantise(code: Column) -> Column:
    return F.transform(code["q"], lambda x: x * code["scale"])


def sign_bits(vec: Column) -> Column:
    return F.transform(vec, lambda x: x >= 0)


def capture(store: DataFrame, events: DataFrame, wing: str) -> DataFrame:
    """A store with query events(op, query) kept as documents, each once."""
    body = F.concat_ws(": ", "op", "query")
    new = events.select(F.concat(F.lit(f"{wing}:"), "op").alias("source_id"), body.alias("body")).distinct()
    return add_documents(store.select("source_id", "sha256", "body"), new.select(F.xxhash64("source_id", "body").alias("id"), "source_id", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), "body"))


def pick_context(hits: DataFrame, budget_tokens: int) -> DataFrame:
    """(place, id, block): the best hit and the best of another room, else the next one, as text within a budget.

    hits: (id, source_id, room, score, body, rank).  The first takes two thirds
    of four bytes a token, a hit that is alone takes all.
    """
    top = hits.filter("rank = 1").select(F.col("room").alias("top_room"))
    rest = hits.filter("rank > 1").crossJoin(F.broadcast(top)).withColumn("same", F.col("room").eqNullSafe(F.col("top_room")))  # one row
    second = rest.orderBy("same", "rank").limit(1).select(*hits.columns)
    both = hits.filter("rank = 1").withColumn("place", F.lit(1)).unionByName(second.withColumn("place", F.lit(2)))
    total = budget_tokens * 4
    n = F.count("*").over(Window.partitionBy())
    share = F.when(n == 1, total).when(F.col("place") == 1, total * 2 // 3).otherwise(total // 3)
    head = F.concat(F.lit("## "), "source_id", F.lit(" (room="), F.coalesce("room", F.lit("-")), F.lit(", score="), F.format_string("%.2f", "score"), F.lit(")\n"))
    room = F.greatest(share - F.octet_length(head), F.lit(0)).cast("int")
    body = cut_bytes(F.col("body"), room)
    return both.select("place", "id", F.concat(head, body, F.when(F.octet_length(body) < F.octet_length("body"), "\n…[truncated]").otherwise("")).alias("block"))
