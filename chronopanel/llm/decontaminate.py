"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII letters (A-Z lower-cased), digits and bytes beyond ASCII. A window is `n` consecutive words
of an item; an item of fewer words, but not none, is one window. The set goes to executors in blocks of bounded size:
long items are cut into pieces that overlap by a window less a word, pieces are dealt to blocks by running bytes, and
where there are several blocks, the rows are written with a number each, every block is a job of its own that writes the
hits of the rows that have any, and the hits of a row are put together at the end. So the driver and an executor hold one
block at a time, however large the benchmark, whatever its items: the documents are scanned once for each block. A hash
only proposes a hit; the words themselves confirm it.

Cases: null or empty text has no words and no hits; an item without words occurs nowhere; repeated rows are judged
alike, each by itself; a null item_id counts hits but is named nowhere; empty tables give no rows or no hits; columns
beside the text pass through, whatever their names; where one has the name of the result, the result's name gets
underscores.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import textblocks as tb
from chronopanel.llm.rows import free_name, with_verdict
from chronopanel.llm.scratch import write_table

#: UTF-8 bytes of benchmark texts and item names in one broadcast block, and in one piece of an item; a block has at most a piece more.
SET_BYTES, PIECE_BYTES = 16 << 20, 1 << 20

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


class NgramSet:
    """Normalised windows of benchmark items, with a bit table and sorted hashes in front of the words."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], n: int) -> None:
        self.windows: dict[bytes, set[str]] = defaultdict(set)
        lengths: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            data = tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = tb.word_spans(data, np.array([0, len(data)]), tb.NOT_ALNUM)
            if not len(starts):
                continue
            size, hashes, raw = min(n, len(starts)), tb.word_hashes(data, starts, ends), data.tobytes()
            for at, h in enumerate(tb.gram_hashes(hashes, size)):
                key = b" ".join(raw[s:e] for s, e in zip(starts[at : at + size], ends[at : at + size], strict=True))
                self.windows[key] |= {item} - {None}
                lengths[size].add(int(h))
        self.tables = {}
        for size, found in lengths.items():
            hashes = np.sort(np.fromiter(found, np.uint64, len(found)))
            bits = int(np.clip(np.ceil(np.log2(len(hashes) + 1)) + 6, 10, 24))
            seen = np.zeros(1 << bits, bool)
            seen[hashes & np.uint64(len(seen) - 1)] = True
            self.tables[size] = (hashes, seen)

    def candidates(self, words: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
        """Words at which a window of `size` words starts that the hashes hold."""
        hashes, seen = self.tables[size]
        grams = tb.gram_hashes(words, size)
        at = np.flatnonzero(seen[grams & np.uint64(len(seen) - 1)])
        near = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
        at = at[hashes[near] == grams[at]]
        owner = np.searchsorted(firsts, at, "right") - 1
        return at[at + size <= firsts[owner + 1]]


def _scan(found: NgramSet, texts: pa.Array) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """Of each text: words, hit words as booleans, items that occur."""
    n_words: list[int] = []
    hits: list[np.ndarray] = []
    items: list[set[str]] = []
    for _, _, data, offsets in tb.blocks(texts):
        data = tb.LOWER[data]
        starts, ends, firsts = tb.word_spans(data, offsets, tb.NOT_ALNUM)
        words = tb.word_hashes(data, starts, ends)
        hit = np.zeros(len(starts) + 1, np.int64)
        here: list[set[str]] = [set() for _ in offsets[1:]]
        raw = None
        for size in found.tables:
            for at in found.candidates(words, firsts, size).tolist():
                raw = data.tobytes() if raw is None else raw
                key = b" ".join(raw[s:e] for s, e in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist(), strict=True))
                if key in found.windows:
                    hit[at] += 1
                    hit[at + size] -= 1
                    here[int(np.searchsorted(firsts, at, "right")) - 1] |= found.windows[key]
        mask = np.cumsum(hit[:-1]) > 0
        n_words += np.diff(firsts).tolist()
        hits += [mask[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        items += here
    return n_words, hits, items


def pieces_of(text: str | None, n: int, most: int) -> list[str]:
    """A text's words in pieces of about `most` bytes, each window of n words in exactly one of them; none without words."""
    data = tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tb.word_spans(data, np.array([0, len(data)]), tb.NOT_ALNUM)
    raw, out, first = data.tobytes(), [], 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + most, "right")), min(first + n, len(starts)))
        out.append(raw[starts[first] : ends[last - 1]].decode("utf-8", "replace"))
        if last == len(starts):
            break
        first = last - n + 1
    return out


def benchmark_blocks(benchmark: DataFrame, n: int, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, int]:
    """(block, item, said) of the benchmark's pieces, equal ones of one item once, and how many blocks there are."""

    most = PIECE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = pieces_of(text, n, most)
                if said:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(said), pa.string()), pa.array(said, pa.string())], names=["item", "said"])

    pieces = benchmark.select(benchmark[f"`{item_id}`"].cast("string").alias("item"), benchmark[f"`{item_text}`"].alias("said")).mapInArrow(cut, "item string, said string").distinct()
    size = F.octet_length("said") + F.coalesce(F.octet_length("item"), F.lit(0))
    dealt = write_table(pieces.withColumn("bytes", size.cast("long")).withColumn("part", F.spark_partition_id()))
    totals, at = sorted(dealt.groupBy("part").agg(F.sum("bytes")).collect()), 0
    before = []
    for part, here in totals:
        before.append((part, at))
        at += here
    offsets = dealt.sparkSession.createDataFrame(before, "part int, before long")
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("said", "item").rowsBetween(Window.unboundedPreceding, -1))
    block = F.floor((F.col("before") + F.coalesce(running, F.lit(0))) / SET_BYTES)
    return write_table(dealt.join(F.broadcast(offsets), "part").select(block.alias("block"), "item", "said")), -(-at // SET_BYTES)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Sequence[str] | None = None, name: str = "found") -> DataFrame:
    """docs with a struct column `name`: n_words, n_hit, hits (a bit for each word, big-endian in each byte), items (sorted as strings)."""
    chosen, parts = benchmark_blocks(benchmark, n, item_id, item_text)
    keep = list(docs.columns if keep is None else keep)
    name = free_name(docs.select(*(f"`{c}`" for c in keep)), name)

    def sent(k: int):
        block = [tuple(r) for r in chosen.where(F.col("block") == k).select("item", "said").collect()]
        return docs.sparkSession.sparkContext.broadcast(NgramSet(block, n))

    if parts <= 1:
        return with_verdict(docs, partial(_verdicts, sent(0)), [text], FOUND, name, keep=keep)
    row, of_row, gathered = (free_name(docs, x) for x in ("row", "of_row", "gathered"))
    table = write_table(docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text]))).withColumn(row, F.monotonically_increasing_id()))
    found = []
    for k in range(parts):
        block = sent(k)
        hits = with_verdict(table.select(row, text), partial(_verdicts, block), [text], FOUND, "found_", keep=[row])
        found.append(write_table(hits.where("found_.n_hit > 0")))
        block.destroy()
    hits = reduce(DataFrame.union, found).groupBy(F.col(row).alias(of_row)).agg(F.collect_list("found_").alias(gathered))
    joined = table.join(hits, F.col(row) == F.col(of_row), "left")
    return with_verdict(joined, _put_together, [text, gathered], FOUND, name, keep=keep)


def _struct(n_words: Sequence[int], hits: Sequence[np.ndarray], items: Sequence[set[str]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        names=["n_words", "n_hit", "hits", "items"],
    )


def _verdicts(sent, texts: pa.Array) -> pa.Array:
    return _struct(*_scan(sent.value, texts))


def _put_together(texts: pa.Array, gathered: pa.Array) -> pa.Array:
    """What each text has in any of the blocks; gathered: its hits in those where it has some."""
    n_words, hits, items = _scan(NgramSet([], 1), texts)
    for i, blocks in enumerate(gathered.to_pylist()):
        for found in blocks or []:
            hits[i] = hits[i] | np.unpackbits(np.frombuffer(found["hits"], np.uint8), count=n_words[i]).astype(bool)
            items[i] |= set(found["items"])
    return _struct(n_words, hits, items)


def n_hit(found: str = "found"):
    """Hit words, as a column."""
    return F.col(f"{found}.n_hit")


def is_contaminated(n_hit_words, n_words, share: int = 20):
    """The rule: some word is hit, and at least one in `share`."""
    return (n_hit_words > 0) & (share * n_hit_words >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text") -> DataFrame:
    """docs without the contaminated ones; the rest as they are."""
    name = free_name(docs, "found")
    found = find_contamination(docs, benchmark, n, text, name=name)
    return found.where(~is_contaminated(n_hit(name), F.col(f"{name}.n_words"), share)).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text") -> DataFrame:
    """docs, each text without the hit words (from the first byte of a hit word to that of the next word that isn't)."""
    name = free_name(docs, "found")
    found = find_contamination(docs, benchmark, n, text, name=name)
    fresh = free_name(found, "cleaned")
    out = with_verdict(found, _without_hits, [text, name], T.StringType(), fresh)
    return out.select(*(F.col(f"`{fresh}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def _without_hits(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for text, x in zip(texts.to_pylist(), found.to_pylist(), strict=True):
        hits = np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=x["n_words"]).astype(bool)
        if text is None or not hits.any():
            out.append(text)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        starts, _, _ = tb.word_spans(tb.LOWER[data], np.array([0, len(data)]), tb.NOT_ALNUM)
        gone = tb.covered(starts[hits], np.append(starts, len(data))[1:][hits] - starts[hits], len(data))
        out.append(data[~gone].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())
