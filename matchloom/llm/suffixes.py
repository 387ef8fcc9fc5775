"""Suffix arrays in numpy, their common prefixes, and binary search in them."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, depth: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first depth codes at least, and each suffix's rank.

    Larsson and Sadakane's refinement: suffixes sorted by their first h codes form groups; a group's
    members are sorted by the ranks of the suffixes h codes further on, which doubles h. Only groups of
    more than one member are sorted again. codes are integers from 0; width of them are taken at once at
    first (they must then be at least 1, and fit in 64 bits together). Suffixes that are equal over the depth share a rank, that
    of the first of them.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = 64 // width
    key = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: n - k] = codes[k:].astype(np.uint64) + np.uint64(width == 1)
        key |= part << np.uint64(bits * (width - 1 - k))
    order = np.argsort(key)
    ranks = np.empty(n, np.int64)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new)
    ranks[order] = first[np.cumsum(new) - 1]
    slots = _tied(new)
    done = width
    while len(slots) and done < depth:
        members = order[slots]
        further = members + done
        second = np.where(further < n, ranks[np.minimum(further, n - 1)] + 1, 0)
        own = ranks[members]
        key = own * np.int64(n + 1) + second
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[slots] = members
        new = np.r_[True, key[1:] != key[:-1]]
        ranks[members] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots = slots[_tied(new)]
        done *= 2
    return order, ranks


def _tied(new: np.ndarray) -> np.ndarray:
    """Places of members of groups of more than one; new marks each group's first member."""
    alone = new & np.r_[new[1:], True]
    return np.flatnonzero(~alone)


def common_prefixes(codes: np.ndarray, order: np.ndarray, places: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """The codes that each suffix shares with the one before it in order, up to most.

    Kasai's algorithm: going through suffixes by position, the shared length falls by one at most from one
    to the next. It runs in lanes of consecutive positions, all lanes a step at a time; a lane's first
    suffix is compared from the start. The suffixes must be in full order (a depth of len(codes)). places has the place of each suffix in order (its inverse).
    """
    n = len(codes)
    shared = np.zeros(n, np.int32)
    if n < 2:
        return shared
    span = np.arange(64)
    padded = np.concatenate([codes.astype(np.int32), np.full(len(span), -1, np.int32)])
    length = np.zeros(-(-n // lane), np.int64)
    heads = np.arange(0, n, lane)
    for step in range(lane):
        at = heads + step
        if at[-1] >= n:
            heads, length = heads[:-1], length[:-1]
            at = at[:-1]
            if not len(at):
                break
        place = places[at]
        before = order[place - 1]
        length = np.maximum(length - 1, 0)
        live = np.flatnonzero((place > 0) & (length < most))
        # most lanes end within a few codes; longer stretches are compared in rows
        width = 1
        while len(live):
            a, b = at[live] + length[live], before[live] + length[live]
            differs = padded[a[:, None] + span[:width]] != padded[b[:, None] + span[:width]]
            more = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
            length[live] = np.minimum(length[live] + more, most)
            live = live[(more == width) & (length[live] < most)]
            width = min(16 * width, len(span))
        length[place == 0] = 0
        shared[place] = length
    return shared


def search(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, after: bool) -> np.ndarray:
    """For each pattern, how many suffixes come before it in order (after: before or beginning with it).

    patterns has a row each, padded with -1 beyond its size. All patterns are searched at once.
    """
    width = patterns.shape[1]
    padded = np.concatenate([codes.astype(np.int64), np.full(width, -1)])
    low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order))
    inside = np.arange(width) < sizes[:, None]
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        seen = padded[order[mid][:, None] + np.arange(width)]
        differs = (seen != patterns[live]) & inside[live]
        where = differs.argmax(1)
        rows = np.arange(len(live))
        apart = differs[rows, where]
        less = np.where(apart, seen[rows, where] < patterns[live, where], after)
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    return low
