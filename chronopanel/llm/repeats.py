"""Maximal repeats of byte strings: an enhanced suffix array whose common-prefix intervals are scanned with a stack."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Units in one number, and bits of each: bytes stand as 1 to 256, so that 0 can separate strings whatever they hold.
_PACK, _BITS = 7, 9


def _packed(data: np.ndarray) -> np.ndarray:
    """The units from each position on as one number, first unit highest; zeros after the end."""
    wide = np.zeros(len(data) + _PACK, np.uint64)
    wide[: len(data)] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(_PACK):
        out = out << np.uint64(_BITS) | wide[k : k + len(data)]
    return out


def _starts(changed: np.ndarray) -> np.ndarray:
    """Of each row, the row at which its run begins; changed: where runs begin."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def enhanced_suffix_array(data: np.ndarray, ends: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` units at least, and the common prefix of each with the one before.

    data: bytes plus one, and 0 after each string. ends: for each position, where its string ends; no common prefix goes beyond. Common prefixes below `least` may be
    given as 0. Prefix doubling sorts again only what still shares a rank.
    """
    n = len(data)
    packed = _packed(data)
    order = np.argsort(packed)
    changed = np.ones(n, bool)
    changed[1:] = packed[order][1:] != packed[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = _starts(changed)
    levels, h = [rank.astype(np.int32)], _PACK
    while h < depth and n:
        alone = changed & np.append(changed[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        mine = order[slots]
        key = rank[mine] * (n + 1)
        near = mine + h < n
        key[near] += rank[mine[near] + h] + 1
        by = np.argsort(key)
        order[slots], key = mine[by], key[by]
        changed[slots[1:]] = key[1:] != key[:-1]
        changed[slots[0]] = True
        rank[order] = _starts(changed)
        levels.append(rank.astype(np.int32))
        h *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        rows = np.arange(1, n)
        first = max((k for k in range(len(levels)) if _PACK << k <= least), default=-1)
        if first >= 0:
            rows = rows[levels[first][order[1:]] == levels[first][order[:-1]]]
        left, right = order[rows - 1], order[rows]
        a, b = left.copy(), right.copy()
        total = np.zeros(len(rows), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(rows), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            step = np.where(same, _PACK << k, 0)
            a, b, total = a + step, b + step, total + step
        inside = (a < n) & (b < n)
        differ = np.full(len(rows), np.uint64(1 << 63))
        differ[inside] = packed[a[inside]] ^ packed[b[inside]]
        lead = np.zeros(len(rows), np.int64)
        for k in range(_PACK):
            lead += (lead == k) & (differ >> np.uint64(_BITS * (_PACK - 1 - k)) == 0)
        total += np.minimum(lead, _PACK - 1)
        common[rows] = np.minimum(total, np.minimum(ends[left] - left, ends[right] - right))
    return order, common


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first row, last row) of each common-prefix interval of at least `least`, by one scan with a stack."""
    out: list[tuple[int, int, int]] = []
    rows = np.flatnonzero(common >= least)
    cuts = np.flatnonzero(np.diff(rows) > 1) + 1
    for run in np.split(rows, cuts) if len(rows) else []:
        first = int(run[0])
        stack: list[tuple[int, int]] = []
        for i, length in enumerate(common[run].tolist()):
            left = first + i - 1
            while stack and stack[-1][0] > length:
                top, left = stack.pop()
                out.append((top, left, first + i - 1))
            if not stack or stack[-1][0] < length:
                stack.append((length, left))
        last = int(run[-1])
        out += [(top, left, last) for top, left in stack]
    return out


def repeat_groups(strings: Sequence[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all occurrences of the maximal repeats of `least` bytes or more: number of the repeat (ascending), its length, string, offset.

    A repeat is maximal if its occurrences differ in what follows and in what goes before; the ends of a string differ
    from everything.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    none = np.zeros(0, np.int64)
    if not len(sizes):
        return none, none, none, none
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    data = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.uint16) + np.uint16(1)
    data[firsts + sizes] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = (firsts + sizes)[owner]
    order, common = enhanced_suffix_array(data, ends, max(least, int(sizes.max())) + 1, least)
    starts = np.zeros(len(data), bool)
    starts[firsts] = True
    left = np.where(starts[order], -1, data[order - 1].astype(np.int64))
    changes = np.ones(len(order), np.int64)
    changes[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    seen = np.cumsum(changes)
    found = np.array(intervals(common, least), np.int64).reshape(-1, 3)
    found = found[seen[found[:, 2]] > seen[found[:, 1]]]
    counts = found[:, 2] - found[:, 1] + 1
    group = np.repeat(np.arange(len(found)), counts)
    at = order[np.arange(counts.sum()) + np.repeat(found[:, 1] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts)]
    return group, found[group, 0], owner[at], at - firsts[owner[at]]


def maximal_repeats(strings: Sequence[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """repeat_groups() as lists of (string, offset)."""
    out: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    for group, length, who, at in zip(*(x.tolist() for x in repeat_groups(strings, least)), strict=True):
        out.setdefault(group, (length, []))[1].append((who, at))
    return list(out.values())
