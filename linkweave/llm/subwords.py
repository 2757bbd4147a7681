"""Hashed byte n-gram counts of whole texts, in numpy, some texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are gathered up to this many bytes and rows before they are counted together; a longer text is counted in pieces.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 128

PRIME = np.uint32(2654435761)


def grams(data: np.ndarray, n: int, bits: int, within_words: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of all byte n-grams (n of 4 at most); with ``within_words`` also a mask without inner spaces."""
    m = len(data) - n + 1
    code = np.zeros(max(m, 0), np.uint32)
    if m <= 0:
        return code, None
    wide = data.astype(np.uint32)
    for i in range(n):
        code |= wide[i : i + m] << np.uint32(8 * i)
    code ^= code >> np.uint32(15)
    code += np.uint32(n * 40503)
    code *= PRIME
    code ^= code >> np.uint32(13)
    code *= PRIME
    keep = None
    if within_words:
        for i in range(1, n - 1):
            inner = data[i : i + m] != 32
            keep = inner if keep is None else keep & inner
    return code >> np.uint32(32 - bits), keep


def chunks(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        if held and (size + len(text) > CHUNK_BYTES or len(held) >= CHUNK_ROWS):
            yield held
            held, size = [], 0
        held.append((i, text))
        size += len(text)
    if held:
        yield held


def counts(texts: list[bytes], sizes: tuple[int, ...], bits: int, within_words: bool = False) -> np.ndarray:
    """(texts x 2**bits) counts of the n-grams of the given sizes; n-grams never cross texts."""
    width = 1 << bits
    out = np.zeros((len(texts), width), np.float32)
    for held in chunks(texts):
        first, rows = held[0][0], len(held)
        for low in range(0, max(len(b) for _, b in held) if rows == 1 else 1, CHUNK_BYTES):
            parts = [b[low : low + CHUNK_BYTES + max(sizes) - 1] if rows == 1 else b for _, b in held]
            data = np.frombuffer(b"".join(parts), np.uint8)
            lengths = np.array([len(b) for b in parts])
            row = np.repeat(np.arange(rows, dtype=np.int32), lengths)
            for n in sizes:
                code, keep = grams(data, n, bits, within_words)
                m = len(code)
                if m == 0:
                    continue
                same = row[:m] == row[n - 1 : n - 1 + m]
                if rows == 1:  # n-grams that start in the overlap belong to the next piece
                    same[CHUNK_BYTES:] = False
                keep = same if keep is None else keep & same
                at = row[:m][keep].astype(np.int64) * width + code[keep]
                out[first : first + rows] += np.bincount(at, minlength=rows * width).reshape(rows, width).astype(np.float32)
    return out
