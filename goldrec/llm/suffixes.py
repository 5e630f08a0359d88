"""Suffix order, longest common prefixes and longest previous factors in numpy.

All functions work on many short sequences laid end to end: ``ends[i]`` is the end
of the sequence that holds position ``i``, and no suffix reaches past it.
"""

from __future__ import annotations

import numpy as np


def dense_ranks(values: np.ndarray) -> np.ndarray:
    """The group start of every value in sorted order (equal values, equal rank)."""
    order = np.argsort(values)
    ordered = values[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else order
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.repeat(starts, np.diff(np.r_[starts, len(values)]))
    return ranks


def suffix_order(
    symbols: np.ndarray, ends: np.ndarray, width: int = 1, depth: int | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in suffix order, and the ranks by their first 1, 2, 4, ... symbols.

    Prefix doubling that sorts only suffixes that still share their rank. A suffix
    that ends sorts before its extensions; equal suffixes keep their order. A symbol
    may stand for ``width`` units from its position on; past ``depth`` units suffixes
    count as equal.
    """
    n = len(symbols)
    ranks = dense_ranks(symbols)
    levels, step = [ranks.astype(np.int32)], width
    sizes = np.bincount(ranks, minlength=n) if n else ranks
    active = np.flatnonzero(sizes[ranks] > 1) if n else ranks
    while len(active) and step < (depth or n):
        after = active + step
        inside = after < ends[active]
        if not inside.any():
            break
        second = np.where(inside, ranks[np.minimum(after, n - 1)] + 1, 0)
        keys = ranks[active] * (n + 1) + second
        order = np.argsort(keys)
        active, keys = active[order], keys[order]
        group = keys // (n + 1)
        group_at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[at, len(keys)])
        # rank: start of the old group plus the place of the new one within it
        start_of_group = np.repeat(group_at, np.diff(np.r_[group_at, len(keys)]))[at]
        ranks = ranks.copy()
        ranks[active] = np.repeat(group[at] + at - start_of_group, sizes)
        levels.append(ranks.astype(np.int32))
        active = active[np.repeat(sizes, sizes) > 1]
        step *= 2
    return np.argsort(ranks, kind="stable"), levels


def neighbour_lcp(
    order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, width: int = 1
) -> np.ndarray:
    """``lcp[r]``: what the suffixes at ``r - 1`` and ``r`` share, in whole symbols of
    ``width`` units; ``lcp[0]`` is 0. ``order`` may leave suffixes out."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    last = len(levels[0]) - 1
    left, right = order[:-1], order[1:]
    room = np.minimum(ends[left] - left, ends[right] - right)
    same = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right, room = left[same], right[same], room[same]
    shared = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(left + shared, last), np.minimum(right + shared, last)
        more = (shared < room) & (levels[k][a] == levels[k][b])
        shared = np.where(more, shared + (width << k), shared)
    out[1:][same] = np.minimum(shared, room)
    return out


def longest_repeat_at(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Per position the length of its longest repeat: the value of the innermost
    longest-common-prefix interval that holds the suffix."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(order) else lcp
    return out


def longest_previous_factor(
    order: np.ndarray, lcp: np.ndarray, owner: np.ndarray, least: int
) -> np.ndarray:
    """Per position the longest prefix, if at least ``least``, that also starts at a
    position of a smaller ``owner``.

    Among suffixes in order, the best earlier match is the previous or the next one
    with a smaller owner. Runs of suffixes that share ``least`` symbols are taken
    apart, so both are searched within a run only; each round moves every suffix
    that has not met a smaller owner one link on, along links found so far.
    """
    n = len(order)
    out = np.zeros(len(owner), np.int64)
    if not n:
        return out
    own = owner[order]
    run = np.cumsum(lcp < least)
    for direction in (1, -1):
        who = own[::direction]
        runs = run[::direction]
        # shared[r]: what r shares with the neighbour before it in this direction
        shared = lcp if direction == 1 else np.r_[0, lcp[:0:-1]]
        link = np.arange(n) - 1
        reach = shared.copy()
        valid = np.r_[False, runs[1:] == runs[:-1]]
        open_ = np.flatnonzero(valid & (who[link] >= who))
        while len(open_):
            to = link[open_]
            reach[open_] = np.minimum(reach[open_], reach[to])
            link[open_] = link[to]
            valid[open_] = valid[to]
            open_ = open_[valid[open_] & (who[link[open_]] >= who[open_])]
        found = np.where(valid, reach, 0)[::direction]
        out[order] = np.maximum(out[order], found)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mark the union of spans over ``n`` positions."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def runs_of(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False]))
    return edge[::2], edge[1::2]


def sums_by(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the slices between neighbouring offsets; empty slices give 0."""
    total = np.r_[0, np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]
