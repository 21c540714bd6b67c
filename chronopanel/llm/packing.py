"""Packing documents into training windows by sum of squares, online.

A document's tokens are cut into full windows and a rest. The rest goes to the fill level that makes the sum of
squared counts of partially filled windows least; a level array has the count of each fill. Each partition packs by
itself in one pass. At most `most_open` windows stay open, for bounded memory (4 bytes a token): once there are as many,
only fills of open windows are chosen from, and a rest that fits into none first fills the fullest and is cut there. When the partition ends, the emptiest windows are poured into the gaps of the
fullest, and what is left in the last window is cut into sequences of power-of-two lengths, which need no padding.

Cases: null or empty text is the end token alone; repeated rows are packed each by itself; a null id is carried as
null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[int | None, int, np.ndarray, int]


class WordCachedTokenizer:
    """Token ids of texts; white space never lies within a token of this vocabulary, so words are encoded once and kept.

    A word of letters with stops after it is encoded as the two: the vocabulary's rules never join letters and stops.
    Words and stems are forgotten when there are more than MOST; longer ones than LONG bytes are never kept.
    """

    MOST, LONG, BYTES = 600_000, 64, 2 << 20

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: bytes that print stand for themselves, the rest for characters from 256 on
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.spelled = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _of_letters(self, stem: bytes) -> bytes | None:
        """Ids of a word of letters alone, in lower case; None if the vocabulary's normaliser might see it otherwise."""
        if stem.isalpha():
            said = stem.decode().lower()
        else:
            said = stem.decode("utf-8", "replace").replace("Σ", "σ").lower()  # letter by letter: no final sigma
            if not said.isalpha() or not is_normalized("NFC", said):
                return None
            said = said.encode().decode("latin-1").translate(self.spelled)
        return array("I", [t.id for t in self.model.tokenize(said)]).tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words, as bytes."""
        if len(self.stems) > self.MOST:
            self.stems.clear()
        stems, ids, rest = self.stems, {}, []
        for w in words:
            stem = w.rstrip(b".,;:!?")
            tail = w[len(stem) :]
            found = stems.get(stem)
            if found is None:
                found = self._of_letters(stem) if stem else None
                if found is None:
                    rest.append(w)
                    continue
                if len(stem) <= self.LONG:
                    stems[stem] = found
            if tail:
                if tail not in stems:
                    stems[tail] = array("I", self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids).tobytes()
                found += stems[tail]
            ids[w] = found
        for w, found in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
            ids[w] = array("I", found.ids).tobytes()
        return ids

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (not lists or size < self.BYTES):
                raw = (texts[at] or "").encode("utf-8", "replace")
                lists.append(raw.split())
                size += len(raw)
                at += 1
            fresh = set().union(*lists).difference(self.known)
            if len(self.known) + len(fresh) > self.MOST:
                self.known.clear()
                fresh = set().union(*lists)
            made = self._learn(fresh)
            self.known.update(made)
            for words in lists:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)
            for w in made:
                if len(w) > self.LONG:
                    del self.known[w]


class SumOfSquaresPacker:
    """Windows of `size` tokens; each finished one is a list of pieces (document, start, ids, tokens of the document)."""

    def __init__(self, size: int, most_open: int) -> None:
        self.size, self.most_open, self.n_open = size, most_open, 0
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [(doc, at, ids[at : at + self.size], total)]
            at += self.size
        if at < total:
            fill = self._level(total - at)
            if fill is None:
                fill = int(np.flatnonzero(self.levels)[-1])
                yield from self._put(fill, (doc, at, ids[at : at + self.size - fill], total))
                at += self.size - fill
                fill = self._level(total - at)
            yield from self._put(fill, (doc, at, ids[at:], total))

    def _level(self, length: int) -> int | None:
        """The fill, 0 for a new window, from which a piece of this length makes the sum of squares least; None if it fits nowhere and no window may be opened."""
        after = 2 * self.levels[length : self.size + 1] + 1
        after[-1] = 0
        before = 1 - 2 * self.levels[: self.size + 1 - length]
        before[0] = 0
        may = self.levels[: self.size + 1 - length] > 0
        may[0] = self.n_open < self.most_open
        if not may.any():
            return None
        change = np.where(may, after + before, np.iinfo(np.int64).max)
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _put(self, fill: int, piece: Piece) -> Iterator[list[Piece]]:
        window: list[Piece] = []
        if fill:
            window = self.windows[fill].pop()
            self.levels[fill] -= 1
            self.n_open -= 1
        window.append(piece)
        fill += len(piece[2])
        if fill == self.size:
            yield window
        else:
            self.windows.setdefault(fill, []).append(window)
            self.levels[fill] += 1
            self.n_open += 1

    def finish(self) -> Iterator[list[Piece]]:
        left = [w for fill in sorted(self.windows, reverse=True) for w in self.windows[fill]]
        while len(left) > 1:
            window = left.pop(0)
            gap = self.size - sum(len(p[2]) for p in window)
            while gap and left:
                doc, start, ids, total = left[-1].pop()
                take = min(gap, len(ids))
                window.append((doc, start, ids[:take], total))
                gap -= take
                if take < len(ids):
                    left[-1].append((doc, start + take, ids[take:], total))
                elif not left[-1]:
                    left.pop()
            if gap:
                left.append(window)
                break
            yield window
        if left:
            yield from self._powers(left[0])

    @staticmethod
    def _powers(window: list[Piece]) -> Iterator[list[Piece]]:
        rest = sum(len(p[2]) for p in window)
        pieces = list(window)
        while rest:
            size, out = 1 << (rest.bit_length() - 1), []
            rest -= size
            while size:
                doc, start, ids, total = pieces.pop(0)
                take = min(size, len(ids))
                out.append((doc, start, ids[:take], total))
                size -= take
                if take < len(ids):
                    pieces.insert(0, (doc, start + take, ids[take:], total))
            yield out


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end: int = 2, most_open: int = 1024, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wished.

    A sequence is the pieces of one sequence_id by offset; all are of `size` tokens but at most one chain of
    power-of-two lengths for each partition. vocabulary: path of a tokenizer file that executors can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = WordCachedTokenizer(vocabulary), SumOfSquaresPacker(size, most_open)
        number = TaskContext.get().partitionId() << 33
        stop = np.array([end], np.uint32)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            rows.clear()
            if with_ids:
                flat = b"".join(columns[7].to_pylist())
                offsets = np.concatenate([[0], np.cumsum(np.asarray(columns[2]))]).astype(np.int32)
                columns[7] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32)))
            return pa.RecordBatch.from_arrays(columns if with_ids else columns[:7], names=names)

        def keep(window: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in window:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, offset, raw if with_ids else None))
                offset += len(ids)
            number += 1

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist()), strict=True):
                    for window in packer.add(doc, np.concatenate([ids, stop])):
                        keep(window)
                yield flush()
        for window in packer.finish():
            keep(window)
        yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
