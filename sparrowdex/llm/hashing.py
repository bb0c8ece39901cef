"""64-bit hashing of tokens and token runs, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class TokenHasher:
    """Hash tokens through a table that is emptied when it grows beyond its bound."""

    def __init__(self, bound: int = 1 << 20):
        self.bound, self.known = bound, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter([known[t] for t in tokens], dtype=np.uint64, count=len(tokens))
        except KeyError:
            pass
        if len(known) > self.bound:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter([known[t] for t in tokens], dtype=np.uint64, count=len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD[3]
    return h ^ (h >> np.uint64(29))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive token hashes (Karp-Rabin polynomial)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = out * _ODD[0] + h[j : j + n]
        return mixed(out)
