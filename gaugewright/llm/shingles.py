"""Word shingles of texts as 64-bit hashes, vectorised over code points.

Words are runs of letters, digits and underscores of the lower-cased text; a shingle is WIDTH words in a row, and the
whole text if it has fewer.  A text without words has no shingles.
"""

from __future__ import annotations

import sys
import types

import numpy as np

WIDTH = 5
_cache = sys.modules.setdefault("_shingle_tables", types.ModuleType("_shingle_tables")).__dict__
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.array([chr(i).isalnum() or i == 95 for i in range(0x110000)])
    return _cache["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_cache.get("powers", ((),))[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE, _BACK):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, p * np.uint64(pow(b, len(p), 1 << 64))))
            out.append(p)
        _cache["powers"] = tuple(out)
    up, down = _cache["powers"]
    return up[:n], down[:n]


def words(text: str) -> np.ndarray:
    """Hashes of the words in order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], _letters()[points], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _powers(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    w = words(text)
    if not len(w):
        return w
    if len(w) < width:
        out = np.full(1, len(w), np.uint64)
        for x in w:
            out = mix(out * _C + x)
        return out
    out = w[: len(w) - width + 1].copy()
    for i in range(1, width):
        out = out * _C + w[i : len(w) - width + 1 + i]
    return np.unique(mix(out))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common)
