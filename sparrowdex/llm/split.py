"""Splitting oversized texts at natural boundaries, with overlap.

Every place between two characters has a strength: a section or paragraph end is
stronger than a line end, this stronger than a sentence, a clause, a word, a
character.  The places with a strength of at least a word form an index with a
sparse table for range-maximum queries: the strongest cut in the window of
permissible lengths is one look-up, of equally strong cuts the rightmost counts.
Where a window holds none, the last place within the limit that breaks no
character (nor a cluster of combining ones) is the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION, PARAGRAPH, BLOCK, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 8, 7, 6, 5, 4, 3, 2, 1

#: Places after a match, with the strength they have; a stronger match at the same place wins.
_PLACES = (
    (WORD, re.compile(rb"[ \t]+(?=[^ \t\r\n])")),
    (CLAUSE, re.compile(rb"[,;:)\]}][\"'\xe2\x80\x9d\xc2\xbb]*[ \t]+(?=[^ \t\r\n])|\xe3\x80\x81|\xef\xbc\x8c")),
    (SENTENCE, re.compile(rb"[.!?\xe2\x80\xa6]+[\"')\]\xe2\x80\x9d\xc2\xbb]*[ \t]+(?=[^ \t\r\n])|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")),
    (LINE, re.compile(rb"\r\n|\n|\r(?!\n)")),
    (BLOCK, re.compile(rb"(?:\r?\n)(?=(?:[-*+] |\d{1,3}[.)] |USER:|ASSISTANT:|```|~~~|> ))")),
    (PARAGRAPH, re.compile(rb"(?:\r?\n|\r)(?:[ \t]*(?:\r?\n|\r))+")),
    (SECTION, re.compile(rb"(?:(?:\r?\n|\r)[ \t]*)*(?:\r?\n|\r)(?=#{1,6} |={3,}|diff --git )")),
)


class CutIndex:
    """Places of a UTF-8 text by strength, with a sparse table of range maxima."""

    def __init__(self, raw: bytes):
        self.raw = raw
        best: dict[int, int] = {}
        for strength, form in _PLACES:
            for m in form.finditer(raw):
                best[m.end()] = strength
        best.pop(len(raw), None)
        self.at = np.array(sorted(best), dtype=np.int64)
        self.strength = np.array([best[int(x)] for x in self.at], dtype=np.int64)
        n = len(self.at)
        # strength first, then position: the maximum of a range is its strongest, rightmost place
        level = self.strength * (n + 1) + np.arange(n)
        self.levels = [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int] | None:
        """(place, strength) of the strongest, then rightmost place in [low, high]; None without one."""
        a, b = int(np.searchsorted(self.at, low, "left")), int(np.searchsorted(self.at, high, "right"))
        if a >= b:
            return None
        k = (b - a).bit_length() - 1
        top = int(max(self.levels[k][a], self.levels[k][b - (1 << k)]))
        n = len(self.at) + 1
        return int(self.at[top % n]), top // n

    def whole(self, place: int, low: int) -> int:
        """The last place at or before `place`, but after `low`, that breaks no character, CRLF or combining cluster."""
        raw, back = self.raw, place
        while back > low and back < len(raw) and (raw[back] & 0xC0) == 0x80:
            back -= 1
        if back <= low:
            return low
        best = back
        for _ in range(32):  # look for the start of a cluster; a longer run of combining characters may be cut
            if back >= len(raw):
                return back
            head = raw[back : back + 4].decode("utf-8", "ignore")[:1]
            joined = _joins(head) or raw[back - 1 : back + 1] == b"\r\n" or raw[max(0, back - 3) : back] == b"\xe2\x80\x8d"
            if not joined:
                return back
            back -= 1
            while back > low and (raw[back] & 0xC0) == 0x80:
                back -= 1
            if back <= low:
                return best
        return best


def _joins(c: str) -> bool:
    o = ord(c) if c else 0
    return 0x300 <= o <= 0x36F or o == 0x200D or 0xFE00 <= o <= 0xFE0F or 0x1F3FB <= o <= 0x1F3FF or 0x20D0 <= o <= 0x20FF or 0x0900 <= o <= 0x0DFF and _combining(c)


def _combining(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c) in ("Mn", "Mc")


@dataclass
class Piece:
    first: int
    last: int
    strength: int


def pieces(text: str, limit: int, overlap: int, least: float = 0.5) -> list[Piece]:
    """Byte ranges of a text: each of at most `limit` bytes, together all of the text, neighbours overlapping.

    The strongest place in the upper part (from `least` of the limit on) ends a
    piece; the next one begins `overlap` bytes before it, moved to the strongest
    place within a quarter of the overlap around that, and always after the begin
    of the piece before, so that pieces advance; for this an overlap counts up to
    three quarters of the limit.  A limit smaller than a character lets this one
    character exceed it.
    """
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - max(1, limit // 4)))
    if n <= limit:
        return [Piece(0, n, SECTION)] if n else []
    index, out, start, reached = CutIndex(raw), [], 0, 0
    while True:
        if n - start <= limit:
            out.append(Piece(start, n, SECTION))
            return out
        high = start + limit
        found = index.strongest(max(start + max(1, int(limit * least), overlap + 1), reached + 1), high) or index.strongest(max(start, reached) + 1, high)
        if found is None:
            place = index.whole(high, start)
            if start < place <= reached:  # nothing new fits beside the overlap
                start = reached
                continue
            if place <= start:  # a character longer than the limit
                place = start + 1
                while place < n and (raw[place] & 0xC0) == 0x80:
                    place += 1
            found = place, CHARACTER
        end, strength = found
        out.append(Piece(start, end, strength))
        reached = end
        if end == n:
            return out
        if not overlap or end - overlap <= start:
            start = end
            continue
        wish, slack = end - overlap, max(1, overlap // 4)
        near = index.strongest(max(start + 1, wish - slack), min(end - 1, wish + slack))
        begin = near[0] if near else index.whole(wish, start)
        start = begin if start < begin < end else end


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id, piece_no, pieces, first_byte, last_byte, strength, piece) of items above their limit.

    items: (item_kind, item_id, scope, body); limits: (scope, max_bytes,
    overlap_bytes).  Items of a scope without a limit (null or below 1 counts as
    none), null bodies, null ids and items within the limit give nothing; of a
    repeated scope the smallest limit and its smallest overlap hold; a repeated
    id gives the pieces of each of its bodies.  The limits are a small table whose
    size decides how it is joined; bodies are filtered before they reach Python.
    """
    rule = limits.filter("scope IS NOT NULL AND max_bytes >= 1").groupBy("scope").agg(F.min(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("overlap"))).alias("r"))
    own = items.select("item_kind", "item_id", "scope", "body").join(rule, "scope").filter("item_id IS NOT NULL AND octet_length(body) > r.max_bytes")
    own = own.select("item_kind", F.col("item_id").cast("long").alias("item_id"), "body", F.col("r.max_bytes").alias("most"), F.col("r.overlap").alias("overlap"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_kind", "item_id", "piece_no", "pieces", "first_byte", "last_byte", "strength", "piece"]
        for pdf in batches:
            out = []
            for kind, i, body, most, overlap in pdf.itertuples(index=False):
                raw = body.encode("utf-8", "surrogatepass")
                cut = pieces(body, int(most), int(overlap))
                out += [(kind, i, k, len(cut), p.first, p.last, p.strength, raw[p.first : p.last].decode("utf-8", "surrogatepass")) for k, p in enumerate(cut, 1)]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=names).astype(_KINDS)
                    out = []
            yield pd.DataFrame(out, columns=names).astype(_KINDS)

    return own.mapInPandas(run, "item_kind string, item_id long, piece_no int, pieces int, first_byte int, last_byte int, strength int, piece string")


_KINDS = {"item_id": "int64", "piece_no": "int32", "pieces": "int32", "first_byte": "int32", "last_byte": "int32", "strength": "int32"}
