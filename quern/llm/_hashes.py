"""Scrambled 64-bit numbers, and runs of texts that are hashed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The increment and the two factors of splitmix64 (fixed values).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, an invertible scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def parcels(texts: list[bytes], most: int) -> Iterator[slice]:
    """Runs of texts that reach ``most`` bytes with their last, or end the list."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
