"""Repeats of at least a given length by interval expansion over a Burrows-Wheeler transform, in numpy.

Texts are arrays of small integers: 0 ends the text and stands nowhere else, ``SEPARATOR`` parts its pieces.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 256


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One text of all pieces, each followed by a separator, and the start of each piece."""
    lengths = np.array([len(x) for x in pieces])
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8).astype(np.int16) + 1
    text[starts + lengths] = SEPARATOR
    return np.append(text, np.int16(0)), starts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first values, at least ``depth`` of them; ties stand by position.

    Ranks of 7 values are doubled until they cover the depth.
    """
    n = len(text)
    rank = np.zeros(n, np.uint64)
    ahead = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    for i in range(7):
        rank = rank * np.uint64(SEPARATOR + 1) + ahead[i : i + n]
    covered = 7
    while True:
        order = np.argsort(rank, kind="stable")
        if covered >= depth:
            return order
        found = rank[order]
        place = np.ones(n, np.uint64)
        place[1:] += np.cumsum(found[1:] != found[:-1]).astype(np.uint64)
        rank[order] = place
        second = np.zeros(n, np.uint64)
        second[: max(n - covered, 0)] = rank[covered:]
        rank = rank * np.uint64(n + 1) + second
        covered *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the order: whether its suffix shares ``least`` values or more with the one before.

    The intervals of all strings of length 0, 1, 2, ... are extended backward by every value that precedes them: the
    last-to-first mapping takes an interval's places to one range for each such value. The place after an extended interval,
    if its common prefix is still unknown, gets the length of the string that was extended, so prefixes come out by
    increasing length; an interval that tells nothing new is not followed. After ``least`` rounds only places with
    longer prefixes are unknown. Strings that hold a separator are not followed: what is said of suffixes with a separator
    among their first ``least`` values is void.
    """
    n = len(text)
    unknown = np.ones(n + 1, bool)
    unknown[0] = unknown[n] = False
    before = text[order - 1]
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    follow = (before != 0) & (before != SEPARATOR)
    lead = text[order]
    low, high = np.array([0]), np.array([n])  # half-open intervals of the order
    tag = np.full(n, -1, np.int64)
    for _ in range(least):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
        good = follow[at]
        image, owner = to[at[good]], owner[good]
        if len(image) > n // 8:  # many: mark them and read the marks in order
            tag[image] = owner
            image = np.flatnonzero(tag >= 0)
            owner = tag[image]
            tag[image] = -1
        else:
            by_place = np.argsort(image)
            image, owner = image[by_place], owner[by_place]
        if not len(image):
            break
        first = np.ones(len(image), bool)
        first[1:] = (image[1:] != image[:-1] + 1) | (owner[1:] != owner[:-1]) | (lead[image[1:]] != lead[image[:-1]])
        starts = np.flatnonzero(first)
        low, high = image[starts], image[np.append(starts[1:], len(image)) - 1] + 1
        fresh = unknown[high]
        unknown[high[fresh]] = False
        low, high = low[fresh], high[fresh]
    return unknown[:n]


def repeats(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, piece, offset) of all places where a string of ``least`` bytes starts that starts at another place too."""
    text, starts = joined(pieces)
    order = suffix_order(text, least)
    same = long_prefixes(text, order, least)
    member = same | np.append(same[1:], False)
    group = np.cumsum(~same)[member]
    at = order[member]
    piece = np.searchsorted(starts, at, side="right") - 1
    offset = at - starts[piece]
    lengths = np.array([len(x) for x in pieces])
    inside = (at < len(text) - 1) & (offset + least <= lengths[piece])
    return group[inside], piece[inside], offset[inside]
