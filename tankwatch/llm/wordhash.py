"""Word hashes for the operators that work on word windows: the same in every process and on every machine.

All words of many texts are hashed at once, as polynomials in their bytes, so nothing is remembered between calls and
memory is bounded by the texts at hand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are hashed at once, unless a word is longer.
PIECE = 1 << 16
_STEP = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (longest runs without ASCII white space), and words by text."""
    flat = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)  # every text ends with a space
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    space = _IS_SPACE[flat]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[0::2], edges[1::2]
    until = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1))
    counts = np.diff(until, prepend=0)
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        size = int(ends[upto - 1]) - base
        up, down = _powers(1 << max(PIECE, size).bit_length())
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(np.take(_LETTER, flat[base : base + size], mode="clip") * up[:size], out=total[1:])
        first, last = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
        at = upto
    return mixed(out), counts


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last ``size`` - 1 places are not of use."""
    out = np.zeros(len(h), dtype=np.uint64)
    n = len(h) - size + 1
    if n > 0:
        for k in range(size):
            out[:n] *= np.uint64(_STEP)
            out[:n] += h[k : k + n]
    return mixed(out)


def lots(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of texts whose sizes add up to about ``most``."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            out.append((begin, k))
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
