"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingled(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of every window of width words, in order; a text with fewer words is one shingle, one without words none.

    Words are what blanks (\\x20, \\x09-\\x0D) part.
    """
    known: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode().split()
        sizes[i] = len(words)
        for w in words:
            h = known.get(w)
            if h is None:
                known[w] = h = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
    values = np.array(flat, np.uint64)
    ends = np.cumsum(sizes)
    padded = np.concatenate([values, np.zeros(width, np.uint64)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(values))  # words from here to the text's end
    total = np.zeros(len(values), np.uint64)
    for j in range(width):
        total = total * _ODD + np.where(left > j, mixed(padded[j : len(values) + j] + np.uint64(j + 1)), np.uint64(0))
    first = np.arange(len(values)) == np.repeat(ends - sizes, sizes)
    keep = (left >= width) | first
    return owner[keep], mixed(total[keep])
