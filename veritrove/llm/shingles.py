"""Sets of word runs as hashed integers, and their MinHash signatures, in vector form."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Code points that are hashed in one go.
TOGETHER = 200_000
#: MinHash values per set.
SIGNATURE = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    multiply, add = np.random.default_rng(20240229).integers(0, 1 << 63, (count, 2), np.uint64).T
    return multiply * np.uint64(2) + np.uint64(1), add.copy()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def lowered(text: str) -> str:
    """Lower case that keeps every code point's being a letter or not (U+0130 would fall apart)."""
    return text.lower() if "İ" not in text else "İ".join(part.lower() for part in text.split("İ"))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of all runs of ``words`` consecutive words.

    Words are maximal runs of letters and digits, lower-cased. Fewer words than
    ``words`` give an empty set. Texts are taken together up to ``TOGETHER``
    code points, so that the arrays stay small.
    """
    out: list[np.ndarray] = []
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(lowered(text) if text else "")
        size += len(group[-1])
        if size > TOGETHER:
            out += _sets(group, words)
            group, size = [], 0
    return out + _sets(group, words)


def _sets(clean: list[str], words: int) -> list[np.ndarray]:
    points = np.frombuffer("\n".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return [np.zeros(0, np.uint64) for _ in clean]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in clean])))
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _alphanumeric()[points]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(16, int(len(points)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])))
        word = mixed((total[end] - total[start]) * down[start])
        runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            runs = mixed(runs * np.uint64(3) + word[k : k + len(runs)])
    document = np.searchsorted(begins, start, "right") - 1
    limits = np.searchsorted(document, np.arange(len(clean) + 1))
    return [np.unique(runs[a : max(a, b - words + 1)]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]


def signatures(sets: list[np.ndarray], count: int = SIGNATURE) -> np.ndarray:
    """``count`` MinHash values, one row per set; every set must hold something. Fewer values are the first of more."""
    out = np.empty((len(sets), count), np.uint64)
    if not sets:
        return out
    multiply, add = _coefficients(count)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets)
    # cache-sized parts, cut between sets
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        base = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, base + 30_000, "right")))
        part, offsets = values[base : ends[last - 1]], ends[first:last] - sizes[first:last] - base
        with np.errstate(over="ignore"):
            for k in range(count):
                out[first:last, k] = np.minimum.reduceat((part * multiply[k] + add[k]) >> np.uint64(32), offsets)
        first = last
    return out
