"""Numbers that describe the lines of texts, made with NumPy over blocks of bytes; no language and no source is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chronopanel.llm import textblocks as tb

BLOCK_BYTES = 1 << 20


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


# Classes of bytes.
UPPER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))
DIGIT = _table(b"0123456789")
SYMBOL = _table(b"#*$%&<>@^~=+_{}[]\\/")
BAR = _table(b"|")
BANG = _table(b"!?")
STOP = _table(b".!?\"')")
COMMA = _table(b",;:")

NAMES = (
    "words", "few_words", "word_length", "long_words", "upper", "much_upper", "digits", "symbols", "some_symbols", "many_symbols", "bars", "many_bars", "bangs", "many_bangs", "commas",
    "ends", "repeated_words", "repeated_grams", "many_repeated_grams", "same_line", "first", "last",
)


def _earlier(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which values stand before in the same owner's; owners ascend."""
    key = hashes ^ tb.mix(owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def lines_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, row after the last, features of the lines that have a word, first line of each text, and bytes in words of each line."""
    for a, b, data, offsets in tb.blocks(column, BLOCK_BYTES):
        breaks = np.flatnonzero(data == 0x0A) + 1
        bounds = np.unique(np.concatenate([offsets, breaks]))
        starts, ends, firsts = tb.word_spans(data, bounds, tb.SPACE)
        counts = np.diff(firsts)
        has = np.flatnonzero(counts)
        doc = np.searchsorted(offsets, bounds[has], "right") - 1
        first_lines = np.searchsorted(doc, np.arange(b - a + 1))
        if not len(has):
            yield a, b, np.zeros((0, len(NAMES)), np.float32), first_lines, np.zeros(0)
            continue
        low, high, n = bounds[has], bounds[has + 1], counts[has].astype(float)
        total = lambda marks: (lambda c: (c[high] - c[low]).astype(float))(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)]))
        size = np.maximum(total(~tb.SPACE[data]), 1)
        letters = np.maximum(total(LETTER[data]), 1)
        upper = total(UPPER[data]) / letters
        symbols, bars, bangs = total(SYMBOL[data]) / n, total(BAR[data]) / n, total(BANG[data]) / n
        at = firsts[has]
        lengths = (ends - starts).astype(float)
        hashes = tb.word_hashes(tb.LOWER[data], starts, ends)
        word_line = np.repeat(np.arange(len(has)), counts[has])
        word_doc = doc[word_line]
        per_word = lambda marks: np.add.reduceat(marks.astype(float), at) / n
        grams = np.full(len(hashes), False)
        windows = tb.starts_of_windows(np.append(np.searchsorted(word_doc, np.arange(b - a)), len(hashes)), 3)
        if len(windows):
            seen = windows[_earlier(tb.gram_hashes(hashes, 3)[windows], word_doc[windows])]
            grams = tb.covered(seen, 3, len(hashes))
        repeated_grams = per_word(grams)
        whole = np.concatenate([[np.uint64(0)], np.cumsum(hashes * tb.powers(len(hashes))[: len(hashes)])])
        line_hash = (whole[at + counts[has]] - whole[at]) * tb.powers(len(hashes), "down")[at]
        first, last = np.zeros(len(has)), np.zeros(len(has))
        first[first_lines[:-1][np.diff(first_lines) > 0]] = 1
        last[first_lines[1:][np.diff(first_lines) > 0] - 1] = 1
        columns = [
            np.log1p(n) / 5, n < 3, np.log1p(size / n) / 3, per_word(lengths > 20), upper, upper > 0.5, total(DIGIT[data]) / size, np.minimum(symbols, 3), symbols > 0.1, symbols > 0.5, np.minimum(bars, 1), bars > 0.2,
            np.minimum(bangs, 2), bangs > 0.5, total(COMMA[data]) / n, STOP[data[ends[at + counts[has] - 1] - 1]], per_word(_earlier(hashes, word_line)), repeated_grams, repeated_grams > 0.5, _earlier(line_hash, doc), first, last,
        ]
        yield a, b, np.stack(columns, axis=1).astype(np.float32), first_lines, size
