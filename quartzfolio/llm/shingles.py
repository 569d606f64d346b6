"""Words and word shingles of texts as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import string_bytes

_BASE, _STEP, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_TABLE = _powers(1 << 16)


def forget() -> None:
    """Gives up the powers of long batches; they are worked out again when needed."""
    global _TABLE
    if len(_TABLE[0]) > 1 << 17:
        _TABLE = _powers(1 << 16)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs without space, tab, line feed, vertical tab,
    form feed or return, within one text."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[raw], out=word[1 : n + 1])
    edge = word[1:] != word[:-1]  # [i]: a border before byte i
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = np.unique(inner[word[inner] & word[inner + 1]])  # a word ends where the next text starts with one
    spots = np.flatnonzero(edge)
    start, end = spots[::2], spots[1::2]
    if len(cut):
        start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    return start, end


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True, spans: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lowered if asked, and the first word of each text."""
    global _TABLE
    n = len(raw)
    if n >= len(_TABLE[0]):
        _TABLE = _powers(n | (1 << 18) - 1)
    up, down = _TABLE
    start, end = spans or word_spans(raw, off)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    return h, np.searchsorted(start, off)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words, or all words of
    a shorter text as one, or none where there is no word."""
    raw, off = string_bytes(column)
    h, first = word_hashes(raw, off)
    out = []
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            s = s * _END + h[i : len(h) - size + 1 + i]
        s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = x * _END + w
            out.append(mix(np.array([x ^ _STEP], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
