"""Distinct word shingles of whole texts as sorted 64-bit hashes, in numpy, some texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
CHUNK_BYTES = 1 << 17

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run without white space, ASCII capitals lower-cased."""
    b = np.frombuffer(data.translate(_LOWER), np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    p, inverse = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=sums[1:])
    return start, mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words, the whole sequence as one; none without words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) < CHUNK_BYTES):
            size += len(raw[stop]) + 1
            stop += 1
        lengths = np.array([len(t) + 1 for t in raw[at:stop]])
        start, words = word_hashes(b"\n".join(raw[at:stop]))
        bound = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
        h = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for i in range(width):
            h += words[i : i + len(h)] * _Q[i]
        h = mixed(h)
        for i in range(stop - at):
            low, high = bound[i], bound[i + 1]
            if high - low >= width:
                yield np.unique(h[low : high - width + 1])
            elif high > low:
                yield mixed((words[low:high] * _Q[: high - low]).sum(keepdims=True) + np.uint64(high - low))
            else:
                yield np.zeros(0, np.uint64)
        at = stop
