"""Enhanced suffix arrays of integer sequences in numpy: suffix array, common prefixes and their intervals."""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of x in the order of their suffixes, or of the first `depth` items (a power of two) of these, and the ranks by
    the first 1, 2, 4, ... items: two places have one rank where so many items are equal, and a sequence's end equals nothing.
    Groups of equal ranks are refined by the rank of the item h later, h doubling; groups of one are left alone."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:n] = x[order][1:] == x[order][:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(same[:n], 0, np.arange(n))) if n else 0
    levels, h = [rank], 1
    while depth is None or h < depth:
        open_ = np.flatnonzero(same[:n] | same[1:])
        if not len(open_):
            break
        place = order[open_]
        key = (rank[place].astype(np.int64) << 32) | (rank[np.minimum(place + h, n)] + 1)
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[open_] = place
        equal = np.zeros(len(open_), bool)
        equal[1:] = key[1:] == key[:-1]
        same[open_] = equal
        rank = rank.copy()
        rank[place] = np.maximum.accumulate(np.where(equal, 0, open_))
        levels.append(rank)
        h *= 2
    return order, levels


def prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each slot the items in common with the slot before, up to the depth of the last level; 0 at slot 0."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        equal &= (a < n) & (b < n)
        step = equal.astype(np.int64) << k
        a, b = a + step, b + step
    out[1:] = a - order[:-1]
    return out


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot k > 0 the first slot and the slot behind the last of the interval that k splits: all suffixes in it have at
    least common[k] items in common, and those before k have just so many with those from k on."""
    n = len(common)
    first, behind, values = [0] * n, [n] * n, common.tolist()
    stack: list[int] = []
    for k in range(1, n):
        v = values[k]
        while stack and values[stack[-1]] > v:
            behind[stack.pop()] = k
        first[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(first, np.int64), np.array(behind, np.int64)
