"""Hashes of runs of code points, for all places of an array at once."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n code points that end at each place (places before n - 1 are of no use)."""
    out = np.full(len(codes), n, dtype=np.uint64)
    for back in reversed(range(n)):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[back:] = codes[: max(0, len(codes) - back)]
        out = (out ^ (shifted + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out
