"""Words, as all operators here count them: maximal runs of Unicode letters and digits, lower case."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered per worker up to ``most`` words, then begun anew."""

    def __init__(self, most: int = 2_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h
