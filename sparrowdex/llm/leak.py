"""Evaluation passages inside a corpus, by greedy string tiling.

The items are a stated query set: they travel in blocks of bounded size to every
document, each document is read once a block and nothing of it is shuffled.
Runs of `min_match` words that a document shares with an item (Karp-Rabin hashes)
are the seeds; along a diagonal they grow into maximal matches, and the longest
match of words not yet marked on either side becomes a tile until none is left.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.hashing import TokenHasher, runs
from sparrowdex.runtime import spread

# Invisible characters, which join what stands on both sides.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_WORD = re.compile(r"[^\W_]+")
_hasher = TokenHasher()


def folded_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case, compatibility forms and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKC", text.translate(_DROP)).translate(_DROP)
    return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))


class ItemIndex:
    """Word hashes of a block of items and the places of all their runs of min_match words."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int):
        self.ids, self.min_match = [i for i, _ in items], min_match
        hasher = TokenHasher()
        self.words = [hasher(w) if w else np.empty(0, np.uint64) for _, w in items]
        grams = [runs(w, min_match) for w in self.words]
        gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, int)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], item[order], at[order]

    def tiles(self, words: list[str]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) for every item with a tile; a tile is (length, place in the text, place in the item)."""
        if len(words) < self.min_match or not len(self.gram):
            return []
        text = _hasher(words)
        gram = runs(text, self.min_match)
        lo = np.searchsorted(self.gram, gram, side="left")
        hit = np.flatnonzero(self.gram[np.minimum(lo, len(self.gram) - 1)] == gram)
        if not len(hit):
            return []
        many = np.searchsorted(self.gram, gram[hit], side="right") - lo[hit]
        i = np.repeat(hit, many)
        pos = np.repeat(lo[hit], many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        item, j = self.item[pos], self.at[pos]
        order = np.lexsort((i, i - j, item))
        item, i, j = item[order], i[order], j[order]
        start = np.append(True, (item[1:] != item[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1))
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(i))) + self.min_match - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        for x, n in zip(at, length):
            found.setdefault(int(item[x]), []).append((int(n), int(i[x]), int(j[x])))
        return [(self.ids[p], _tile(m, len(text), len(self.words[p]), self.min_match)) for p, m in sorted(found.items())]


def _tile(matches: list[tuple[int, int, int]], n: int, m: int, least: int) -> list[tuple[int, int, int]]:
    """Longest matches first; what earlier tiles cover is cut away, and what stays of at least `least` words waits its turn."""
    heap = [(-length, i, j) for length, i, j in matches]
    heapq.heapify(heap)
    in_text, in_item, tiles = np.zeros(n, bool), np.zeros(m, bool), []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        marked = in_text[i : i + length] | in_item[j : j + length]
        if not marked.any():
            in_text[i : i + length] = True
            in_item[j : j + length] = True
            tiles.append((length, i, j))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return tiles


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most about block_words words; an item is never cut."""
    block, n = [], 0
    for i, text in items.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        words = folded_words(text)
        if words:
            block.append((i, words))
            n += len(words)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame,
    doc_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    passage_col: str,
    min_match: int = 5,
    longest: int = 12,
    coverage: float | None = 0.5,
    block_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, longest, tiles, covered): texts that give an item away.

    A text leaks an item when a tile has at least `longest` words or, with a
    coverage, when all tiles of at least min_match words together cover that
    share of the item's words (reordered passages).  Null and empty texts and
    items leak nothing; rows without an id take no part; of repeated ids the
    widest leak comes out.  Items beyond block_words words pass in further blocks
    over the documents.
    """
    spark, out = docs.sparkSession, None
    own = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    own = spread(own)
    for block in item_blocks(items, item_col, passage_col, block_words):
        shared = spark.sparkContext.broadcast(ItemIndex(block, min_match))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            size = {i: len(w) for i, w in zip(index.ids, index.words)}
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    for item, tiles in index.tiles(folded_words(text)):
                        if tiles:
                            covered = sum(t[0] for t in tiles) / size[item]
                            top = max(t[0] for t in tiles)
                            if top >= longest or (coverage is not None and covered >= coverage):
                                rows.append((doc, item, top, len(tiles), covered))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "tiles", "covered"]).astype({"doc_id": "int64", "item_id": "int64", "longest": "int32", "tiles": "int32", "covered": "float64"})

        got = own.mapInPandas(scan, "doc_id long, item_id long, longest int, tiles int, covered double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, longest int, tiles int, covered double")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "longest", "tiles")).alias("m"), F.max("longest").alias("longest"))
    return best.select("doc_id", "item_id", "longest", "m.tiles", "m.covered")
