"""Compressed FM-index over integer tokens: wavelet matrix of the Burrows-Wheeler transform, backward search in bulk.

Kept are the bit vectors of the transform, common prefixes of neighbouring rows in one byte or two, and the document of
each row; neither the text nor its suffix array or ranks.
"""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by prefix doubling, and their ranks by the first 1, 2, 4, ... tokens; a suffix that ends first comes first.

    depth: tokens that count at least, all by default; suffixes that agree on them stand together in any order.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, order, h = [rank.astype(np.int32)], np.argsort(rank), 1
    while n and rank.max() < n and (depth is None or h < depth):
        key = rank * (n + 1)
        key[: max(0, n - h)] += rank[h:]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank.astype(np.int32))
        h *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Tokens that each row shares with the row before, as far as the ranks tell them apart; 0 for the first row and after the last."""
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    a, b, total = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = np.zeros(len(a), np.int64)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a, b, total = a + (same << k), b + (same << k), total + (same << k)
    out[1:n] = total
    return out.astype(np.uint8 if out.max(initial=0) < 256 else np.uint16)


class BitVector:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)


class RangeLeast:
    """Least value of any range, by a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = np.empty((max(1, int(len(values)).bit_length()), len(values)), values.dtype)
        self.tables[0] = values
        for k in range(1, len(self.tables)):
            h = 1 << (k - 1)
            self.tables[k] = self.tables[k - 1]
            self.tables[k, :-h] = np.minimum(self.tables[k - 1, :-h], self.tables[k - 1, h:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low:high] for each pair; low < high."""
        level = np.frexp((high - low).astype(float))[1] - 1
        return np.minimum(self.tables[level, low], self.tables[level, high - (1 << level)])


class FMIndex:
    """tokens: positive integers; 0 separates what no match may cross, is put at the end if absent, and is never searched.

    documents: for each token the number of the document that it stands in, all the same by default; depth: more than the
    longest pattern that will be searched, suffixes need no order beyond it.
    """

    def __init__(self, tokens: np.ndarray, documents: np.ndarray | None = None, depth: int | None = None) -> None:
        documents = np.zeros(len(tokens), np.int32) if documents is None else documents
        if not len(tokens) or tokens[-1]:
            tokens, documents = np.append(tokens, 0), np.append(documents, documents[-1:] if len(documents) else 0)
        order, ranks = suffix_array(tokens, depth)
        self.n = len(order)
        self.common = RangeLeast(common_prefixes(order, ranks))
        self.earliest = RangeLeast(documents[order])
        last = tokens[order - 1]
        self.levels: list[tuple[BitVector, int]] = []
        self.depth = max(1, int(tokens.max(initial=1)).bit_length())
        counts = np.bincount(tokens, minlength=(1 << self.depth) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        for level in range(self.depth - 1, -1, -1):
            ones = (last >> level & 1).astype(bool)
            self.levels.append((BitVector(ones), int((~ones).sum())))
            last = np.concatenate([last[~ones], last[ones]])

    def rank(self, token: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each token stands before the position in the transform."""
        start = np.zeros_like(at)
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (token >> level & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def extend(self, token: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with token and go on as those in [low, high); none for a token beyond the alphabet."""
        known = token < 1 << self.depth
        token = np.where(known, token, 0)
        first, m = self.before[token], len(token)
        ranks = self.rank(np.concatenate([token, token]), np.concatenate([low, high]))
        a, b = first + ranks[:m], first + ranks[m:]
        return a, np.where(known, b, a)

    def parents(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent of each interval in the tree of common prefixes: tokens that its rows share, first row, row after the last."""
        least = self.common.tables[0]
        m = np.maximum(least[low], least[high])
        first, end = low + 1, high.copy()
        for k in range(len(self.common.tables) - 1, -1, -1):
            size, table = 1 << k, self.common.tables[k]
            far = np.maximum(first - size, 0)
            first = np.where((first >= size) & (table[far] >= m), far, first)
            fits = end + size <= self.n
            end = np.where(fits & (table[np.where(fits, end, 0)] >= m), end + size, end)
        return m.astype(np.int64), np.where(m > 0, first - 1, 0), np.where(m > 0, end, self.n)

    def matching_statistics(self, tokens: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, documents: np.ndarray | None = None) -> np.ndarray:
        """Of the texts tokens[firsts[i] : firsts[i] + sizes[i]], end to end: at each place the length of the longest match from there on
        with a document before documents[i] (with any, by default).

        Each text is streamed backward: a step extends the match to the left; where that leaves no row, or none of an earlier
        document, the match is shortened on the right to the parent interval, until it can be extended.
        """
        documents = np.full(len(sizes), np.iinfo(np.int64).max) if documents is None else documents
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        length = np.zeros(offsets[-1], np.int64)
        order = np.argsort(-sizes, kind="stable")
        live_at = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
        a, b, k = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)

        def refused(texts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            bad = x >= y
            some = np.flatnonzero(~bad)
            bad[some] = self.earliest(x[some], y[some]) >= documents[texts[some]]
            return bad

        for back, m in enumerate(live_at.tolist(), 1):
            now = order[:m]
            place = sizes[now] - back
            token = tokens[firsts[now] + place]
            x, y = self.extend(token, a[now], b[now])
            stuck = np.flatnonzero(refused(now, x, y))
            while len(stuck):
                none = k[now[stuck]] == 0
                gone, stuck = stuck[none], stuck[~none]
                k[now[gone]], x[gone], y[gone] = -1, 0, self.n
                texts = now[stuck]
                k[texts], a[texts], b[texts] = self.parents(a[texts], b[texts])
                x[stuck], y[stuck] = self.extend(token[stuck], a[texts], b[texts])
                stuck = stuck[refused(texts, x[stuck], y[stuck])]
            a[now], b[now] = x, y
            k[now] += 1
            length[offsets[now] + place] = k[now]
        return length
