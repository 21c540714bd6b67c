"""Vectorised word and n-gram arrays over Arrow batches of texts.

A batch is cut into blocks of some MB of UTF-8; each block is handled with NumPy as one byte array, so that
no Python object is made for a word. Hashes are 64-bit polynomials over the ring of integers modulo 2**64
with a random value for each byte, finished by a bit mixer; who needs certainty compares texts afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_SLICE = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLES: dict[str, np.ndarray] = {}

#: Bytes that separate words: ASCII white space, or all ASCII but digits and lower-case letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int, kind: str = "up") -> np.ndarray:
    """Powers 0..n of the multiplier, or of its inverse."""
    have = _TABLES.get(kind)
    if have is None or len(have) <= n:
        base = int(_MULTIPLIER) if kind == "up" else _inverse(int(_MULTIPLIER))
        step = np.full(max(n, _SLICE) + 2, base, np.uint64)
        step[0] = 1
        have = _TABLES[kind] = np.cumprod(step)
    return have


def byte_values() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    return _TABLES["bytes"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes; a longer text is alone."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and of each text the index of its first word (with one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over slices of bounded size."""
    out = np.empty(len(starts), np.uint64)
    values, at = byte_values(), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _SLICE)))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = powers(high - low), powers(high - low, "down")
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each index on; shorter by n - 1 than the input. Who cuts texts masks what crosses them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) - n + 1, np.uint64)
    for at in range(0, len(out), _SLICE):
        part = words[at : at + _SLICE + n - 1]
        m = len(part)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(part * powers(m)[:m], out=total[1:])
        out[at : at + m - n + 1] = mix((total[n:] - total[: m - n + 1]) * powers(m, "down")[: m - n + 1] + np.uint64(n))
    return out


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text of each word, from the first words of the texts."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def starts_of_windows(firsts: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which a window of n words of one text starts."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    return np.arange(counts.sum()) + np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` neighbours from each index on."""
    if len(values) < width:
        return values[:0]
    least, have = values, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(values) - width + 1], least[width - have : width - have + len(values) - width + 1])
    return least


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Of each window of `width` grams, the index of the one with the least hash (the leftmost on a tie of the leading 40 bits)."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    out = np.empty(len(grams) - width + 1, np.int64)
    for at in range(0, len(out), 1 << 23):
        part = grams[at : at + (1 << 23) + width - 1]
        packed = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_least(packed, width)
        out[at : at + len(least)] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return out


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in some [start, start + length)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0
