"""Mixing sources to target shares of the tokens, by entropy balancing.

The rates of the documents are the ones closest to one copy each (in relative
entropy) under which every source has its share of the tokens and no document is
used more than its source's maximum of repeats.  The dual has one variable a
source: a document of t tokens gets  min(max_repeats, exp(lambda * t / mean)).
Newton steps, kept inside a bracket, solve it; every step is one aggregation over
the histogram of token counts, never over the driver.  A source whose dual is
unbounded cannot reach its share.  Rates become copies by carrying the rounding
error, in tokens, along documents ordered by their size.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.runtime import spread, written

#: Vocabulary of a public byte-level tokenizer; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound of the dual variables, far beyond any rate that matters.
_LOG_LIMIT = 60.0


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; lone surrogates count as replacement characters, null as none."""
    if not text:
        return 0
    return len(_encoding(vocabulary).encode_ordinary(re.sub("[\ud800-\udfff]", "�", text)))


def sized_documents(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of the documents of listed sources."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "tokens": [count_tokens(t, vocabulary) for t in pdf["text"]]})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    own = spread(own)
    listed = targets.select("source").distinct()
    return own.join(listed, "source", "left_semi").mapInPandas(run, "id long, source string, tokens long")


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, share, repeats): one row a source, null shares as 0, null or negative repeats as 0; a repeated source keeps its largest values."""
    own = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    return own.select("source", F.coalesce(F.greatest("share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce(F.greatest("repeats", F.lit(0)), F.lit(0)).alias("repeats"))


def solve_rates(sized: DataFrame, targets: DataFrame, tolerance: float = 1e-6, most_steps: int = 60) -> DataFrame:
    """(source, share, repeats, own, documents, wanted, mean, lam, reachable): the dual solution of every listed source.

    First the dual is solved for share * all tokens of listed sources.  Where it is
    unbounded (every document already takes part max_repeats times and tokens are
    still missing, or there is no document), the source is not reachable and gives
    all it can.  What is missing goes to the others in proportion to their shares,
    and the dual is solved again for these, until no further source runs out:
    `wanted` is the amount promised in the end.
    """
    hist = written(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    goal = clean_targets(targets)
    own = hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("own"), F.sum("n").alias("documents"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"))
    state = goal.join(own, "source", "left").fillna(0, ["own", "documents"]).fillna(1, ["least"])
    state = state.crossJoin(F.broadcast(own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("size"))))  # one row
    state = state.withColumn("mean", F.greatest(F.col("own") / F.greatest("documents", F.lit(1)), F.lit(1.0)))
    rows = {r["source"]: r.asDict() for r in state.collect()}  # as many rows as listed sources
    for r in rows.values():
        r |= {"wanted": r["share"] * r["size"], "lam": 0.0, "reachable": True, "capped": False}
    spark = sized.sparkSession

    def solve(some: list[dict]) -> None:
        """Newton steps for some sources; those whose dual is unbounded become capped."""
        for r in some:
            # beyond this bound even the shortest document has reached its repeats
            high = math.log(max(r["repeats"], 1)) * r["mean"] / r["least"] + 1.0
            r |= {"low": -_LOG_LIMIT, "high": high, "open": r["wanted"] > 0 and r["documents"] > 0}
            if not r["documents"]:
                r["capped"] = True
            elif r["wanted"] <= 0:
                r["lam"] = -math.inf
        for _ in range(most_steps):
            todo = [r for r in some if r["open"]]
            if not todo:
                break
            lam = spark.createDataFrame([(r["source"], r["lam"], float(r["mean"]), float(r["repeats"])) for r in todo], "source string, lam double, mean double, repeats double")
            at = hist.join(lam, "source").withColumn("z", F.col("tokens") / F.col("mean"))
            at = at.withColumn("w", F.least("repeats", F.exp(F.least(F.col("lam") * F.col("z"), F.lit(700.0)))))
            free = F.when(F.col("w") < F.col("repeats"), F.col("w") * F.col("z") * F.col("tokens") * F.col("n")).otherwise(0.0)
            for s in at.groupBy("source").agg(F.sum(F.col("w") * F.col("tokens") * F.col("n")).alias("got"), F.sum(free).alias("slope")).collect():
                r = rows[s["source"]]
                gap = s["got"] - r["wanted"]
                if abs(gap) <= tolerance * r["wanted"]:
                    r["open"] = False
                    continue
                if gap < 0 and s["slope"] <= 0:
                    r |= {"open": False, "capped": True}
                    continue
                r["low" if gap < 0 else "high"] = r["lam"]
                step = r["lam"] - gap / s["slope"] if s["slope"] > 0 else math.nan
                if gap < 0 and step >= r["high"]:
                    r["lam"] = r["high"]
                else:
                    r["lam"] = step if r["low"] < step < r["high"] else (r["low"] + r["high"]) / 2

    some = list(rows.values())
    solve(some)
    for r in rows.values():
        r["reachable"] = not r["capped"]
    while any(r["capped"] for r in some):
        missing = sum(r["size"] for r in list(rows.values())[:1])
        for r in rows.values():
            if r["capped"]:
                r |= {"lam": math.inf, "wanted": float(r["repeats"] * r["own"])}
                missing -= r["wanted"]
        some = [r for r in rows.values() if not r["capped"] and r["share"] > 0]
        shares = sum(r["share"] for r in some)
        for r in some:
            r["wanted"] = max(0.0, missing) * r["share"] / shares
        solve(some)
    cols = ["source", "share", "repeats", "own", "documents", "size", "wanted", "mean", "lam", "reachable"]
    kinds = "source string, share double, repeats int, own long, documents long, size long, wanted double, mean double, lam double, reachable boolean"
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows.values()], kinds)


def copies(sized: DataFrame, solved: DataFrame, group_rows: int = 100_000) -> DataFrame:
    """(id, source, tokens, copies): whole copies whose tokens add up to the rates' within each source.

    Whole parts of the rates are taken as they are; of the remaining parts a
    document gets one copy more where the tokens given so far lag by half its own
    behind those the rates ask for, longest documents first, so that a group ends
    within half of its shortest documents of the amount asked for.  Documents of a
    source are rounded in groups of about group_rows, so that a source with a third
    of all rows is no single task.
    """
    rates = sized.join(solved.select("source", "repeats", "documents", "mean", "lam"), "source")
    z = F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0))
    rate = F.when(F.col("lam") == F.lit(float("inf")), F.col("repeats")).when(F.col("lam") == F.lit(float("-inf")), 0.0).otherwise(F.least(F.col("repeats").cast("double"), F.exp(z)))
    rates = rates.withColumn("rate", rate).withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("documents") / group_rows), F.lit(1)).cast("long")))

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
        rate, tokens = pdf["rate"].to_numpy(), pdf["tokens"].to_numpy()
        whole = np.floor(rate + 1e-9)
        part = np.maximum(rate - whole, 0)
        asked, given, extra = np.cumsum(part * tokens).tolist(), 0, np.zeros(len(pdf), dtype=np.int32)
        for i in np.flatnonzero((part > 1e-9) & (tokens > 0)).tolist():
            if asked[i] - given >= tokens[i] / 2:
                extra[i] = 1
                given += int(tokens[i])
        return pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "tokens": tokens, "copies": (whole + extra).astype(np.int32)})

    own = rates.select("id", "source", "tokens", "rate", "salt")
    return own.groupBy("source", "salt").applyInPandas(rounded, "id long, source string, tokens long, copies int")


def report(mixture: DataFrame, solved: DataFrame) -> DataFrame:
    """(source, target_share, promised_share, reached_share, own_tokens, mixed_tokens, reachable) for every listed source.

    promised_share is the target where every source can reach it; else what a
    source can give, and for the others their targets in proportion.
    """
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    out = solved.join(got, "source", "left").fillna(0, ["mixed"])
    whole = out.agg(F.sum("mixed").alias("whole"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.select("source", F.col("share").alias("target_share"), F.when(F.col("size") > 0, F.col("wanted") / F.col("size")).otherwise(0.0).alias("promised_share"), F.when(F.col("whole") > 0, F.col("mixed") / F.col("whole")).otherwise(0.0).alias("reached_share"), F.col("own").alias("own_tokens"), F.col("mixed").alias("mixed_tokens"), "reachable")
