"""Exact repeats across documents, routed by content.

All windows of a fixed number of units (words or bytes) are cut into runs that share an anchor, the gram with the
least hash in the window. Equal windows have equal anchors, so equal windows meet in one shard, wherever they stand.

1. Anchors that occur once are left out: a grouped count of 64-bit hashes.
2. Of the others, the run's text becomes a segment; equal segments are one row from here on, with the least document
   and the number of occurrences.
3. Where an anchor has very many different segments (a short passage in much different company), windows are counted
   by hash first, and segments are cut to the windows that occur again.
4. Where an anchor still has very many, its segments are cut into runs of a wider anchor, and so on; the widest anchor
   is the whole window, of which all occurrences are one row.
5. Segments go to shards of bounded size by anchor: no anchor has more than `crowd` of them. Each shard is indexed and
   searched by itself.
6. What the index finds goes back to the documents by segment, and from there to the texts by document.

Hashes choose what is compared; the index compares the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import textblocks as tb
from chronopanel.llm.scratch import drop_table, write_table

#: Bytes of segments in one shard.
SHARD_BYTES = 2 << 20
#: Different segments of one anchor beyond which its segments are cut further.
CROWD = 1000


@dataclass(frozen=True)
class Windows:
    """Windows of `size` units, words or bytes, anchored at grams of `gram` units."""

    size: int
    gram: int
    words: bool

    @property
    def width(self) -> int:
        return self.size - self.gram + 1

    @property
    def wider(self) -> Windows:
        """Half way from this anchor to the whole window."""
        return replace(self, gram=(self.gram + self.size + 1) // 2)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values of the units, first unit of each text, and where units start and end in the bytes."""
        if not self.words:
            at = np.arange(len(data))
            return tb.byte_values()[data], offsets, at, at + 1
        starts, ends, firsts = tb.word_spans(data, offsets, tb.SPACE)
        return tb.word_hashes(data, starts, ends), firsts, starts, ends

    def runs(self, values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each run: its text, first unit, windows, anchor's hash, and whether the anchor may stand in it twice."""
        windows = tb.starts_of_windows(firsts, self.size)
        owner = np.repeat(np.arange(len(firsts) - 1), np.maximum(np.diff(firsts) - self.size + 1, 0))
        grams = tb.gram_hashes(values, self.gram)
        at = tb.anchors(grams, self.width)[windows] if len(windows) else windows
        keys = grams[at]
        new = np.ones(len(windows), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (windows[1:] != windows[:-1] + 1)
        begin = np.flatnonzero(new)
        since = np.arange(len(windows)) - np.repeat(begin, np.diff(np.append(begin, len(windows))))
        begin = np.flatnonzero(since % self.width == 0)
        count = np.diff(np.append(begin, len(windows)))
        return owner[begin], windows[begin], count, keys[begin].view(np.int64), at[begin] != at[begin + count - 1]

    def plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes with one space after each word, and where units start and end there."""
        if not self.words:
            return data.tobytes(), starts, ends
        keep = np.zeros(len(data) + 1, bool)
        keep[:-1] = ~tb.SPACE[data]
        keep[ends[ends < len(data)]] = True
        place = np.cumsum(keep) - 1
        out = np.where(tb.SPACE[data], np.uint8(0x20), data)[keep[:-1]]
        return out.tobytes(), place[starts], place[starts] + (ends - starts)


def _anchors(kind: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in tb.blocks(batch.column(1)):
            values, firsts, _, _ = kind.units(data, offsets)
            owner, _, _, keys, many = kind.runs(values, firsts)
            order = np.lexsort((keys, owner))
            owner, keys, weight = owner[order], keys[order], 1 + many[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            weight = np.add.reduceat(weight, at) if len(at) else weight
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(owner[at])), pa.array(keys[at]), pa.array(weight.astype(np.int32))], names=["doc", "key", "weight"])


def _segments(kind: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc, said_hash, said, wanted -> doc, said_hash, start, key, segment."""
    for batch in batches:
        wanted = batch.column(3)
        for a, b, data, offsets in tb.blocks(batch.column(2)):
            values, firsts, starts, ends = kind.units(data, offsets)
            owner, first, count, keys, _ = kind.runs(values, firsts)
            lists = wanted.slice(a, b - a)
            sizes = np.diff(np.asarray(lists.offsets))
            theirs = np.asarray(lists.flatten()).view(np.uint64) ^ tb.mix(np.repeat(np.arange(b - a), sizes).astype(np.uint64))
            take = np.flatnonzero(np.isin(keys.view(np.uint64) ^ tb.mix(owner.astype(np.uint64)), theirs))
            owner, first, count, keys = owner[take], first[take], count[take], keys[take]
            raw, starts, ends = kind.plain(data, starts, ends)
            low, high = starts[first].tolist(), ends[first + count + kind.size - 2].tolist()
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(rows),
                    batch.column(1).slice(a, b - a).take(rows),
                    pa.array(first - firsts[owner]),
                    pa.array(keys),
                    pa.array([raw[s:e] for s, e in zip(low, high, strict=True)], pa.binary()),
                ],
                names=["doc", "said_hash", "start", "key", "segment"],
            )


def _window_hashes(kind: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, seg_hash, segment, n -> key, seg_hash, n, hashes of the windows."""
    for batch in batches:
        for a, b, data, offsets in tb.blocks(batch.column(2)):
            values, firsts, _, _ = kind.units(data, offsets)
            grams = tb.gram_hashes(values, kind.size)[tb.starts_of_windows(firsts, kind.size)].view(np.int64)
            sizes = np.maximum(np.diff(firsts) - kind.size + 1, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(3).slice(a, b - a), lists], names=["key", "seg_hash", "n", "hashes"])


def _cut(kind: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, seg_hash, segment, low, n, again (windows that occur again) -> parts of the segments."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "seg_hash", "shift", "segment", "low", "n")}
        for key, seg_hash, segment, low, n, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            data = np.frombuffer(segment, np.uint8)
            _, _, starts, ends = kind.units(data, np.array([0, len(data)]))
            at = np.unique(again)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                part = segment[int(starts[run[0]]) : int(ends[run[-1] + kind.size - 1])]
                for c, v in zip(out, (key, seg_hash, int(run[0]), part, low, n), strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _split(kind: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, seg_hash, segment, low, n -> of each run of the segments: key, seg_hash, shift, child_key, segment, low, n."""
    size = tb.BLOCK_BYTES * kind.width // (kind.size + kind.width)  # the runs overlap: together they are so much larger
    for batch in batches:
        for a, b, data, offsets in tb.blocks(batch.column(2), max(1, size)):
            values, firsts, starts, ends = kind.units(data, offsets)
            owner, first, count, keys, _ = kind.runs(values, firsts)
            raw, rows = data.tobytes(), pa.array(owner)
            low, high = starts[first].tolist(), ends[first + count + kind.size - 2].tolist()
            key, seg_hash, least, n = (batch.column(i).slice(a, b - a).take(rows) for i in (0, 1, 3, 4))
            segments = pa.array([raw[s:e] for s, e in zip(low, high, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([key, seg_hash, pa.array(first - firsts[owner]), pa.array(keys), segments, least, n], names=["key", "seg_hash", "shift", "child_key", "segment", "low", "n"])


def _repeated_windows(kind: Windows, crowded: DataFrame) -> DataFrame:
    """key, seg_hash, shift, child_key, segment, low, n: the parts of the segments whose windows occur again."""
    windows = crowded.select("key", "seg_hash", "segment", "n").mapInArrow(lambda x: _window_hashes(kind, x), "key long, seg_hash long, n long, hashes array<long>")
    windows = windows.select("key", "seg_hash", "n", F.posexplode("hashes").alias("at", "hash"))
    twice = write_table(windows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    spots = windows.join(twice, "hash").groupBy("key", "seg_hash").agg(F.collect_list("at").alias("again"))
    parts = crowded.join(spots, ["key", "seg_hash"]).select("key", "seg_hash", "segment", "low", "n", "again")
    parts = parts.mapInArrow(lambda x: _cut(kind, x), "key long, seg_hash long, shift long, segment binary, low long, n long")
    parts = write_table(parts.select("key", "seg_hash", "shift", F.col("key").alias("child_key"), "segment", "low", "n", F.xxhash64("segment").alias("child_hash")))
    drop_table(twice)
    return parts


def _once(parts: DataFrame) -> DataFrame:
    """Equal segments as one row."""
    return write_table(parts.groupBy("key", "seg_hash", "segment").agg(F.min("low").alias("low"), F.sum("n").alias("n")))


def _uncrowded(kind: Windows, unique: DataFrame, crowd: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Rows (key, segment, low, n) with at most `crowd` segments for each anchor; for each time that segments were cut, the parts; tables to drop."""
    rows, cuts, made = [], [], [unique]
    while True:
        crowds = write_table(unique.groupBy("key").count().where(F.col("count") > crowd).select("key"))
        made.append(crowds)
        whole = kind.gram == kind.size
        if whole or crowds.isEmpty():
            rows.append(unique)
            break
        rows.append(unique.join(crowds, "key", "left_anti"))
        crowded = unique.join(crowds, "key", "left_semi")
        if not cuts:
            parts = _repeated_windows(kind, crowded)
        else:
            kind = kind.wider
            parts = crowded.mapInArrow(lambda x, kind=kind: _split(kind, x), "key long, seg_hash long, shift long, child_key long, segment binary, low long, n long")
            parts = write_table(parts.withColumn("child_hash", F.xxhash64("segment")))
        cuts.append(parts)
        unique = _once(parts.select(F.col("child_key").alias("key"), F.col("child_hash").alias("seg_hash"), "segment", "low", "n"))
        made.append(unique)
    return reduce(DataFrame.union, [x.select("key", "segment", "low", "n") for x in rows]), cuts, made


def find_repeats(docs: DataFrame, kind: Windows, index: Callable[[Windows, pa.Table], pa.Table], shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> tuple[DataFrame, list[DataFrame]]:
    """docs: (doc long, not null; said) -> (doc, said_hash, start, found) for segments in which the index found something; and tables to drop after.

    start: the segment's first unit in the text; found: what index() gave for it, relative to that unit.
    index(kind, table of key, segment, low, n) returns key, segment, found (a list of longs), on one shard.
    """
    anchors = docs.select("doc", "said").mapInArrow(lambda x: _anchors(kind, x), "doc long, key long, weight int")
    if not kind.words:  # there, it costs more to find anchors again than to write them
        anchors = write_table(anchors)
    counts = anchors.groupBy("key")
    again = counts.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high") if kind.words else counts.agg(F.sum("weight").alias("n")).where("n > 1")
    again = write_table(again.select("key"))
    wanted = write_table(anchors.join(again, "key").groupBy("doc").agg(F.collect_list("key").alias("wanted")))
    drop_table(again)
    if not kind.words:
        drop_table(anchors)
    texts = docs.select("doc", F.xxhash64("said").alias("said_hash"), "said").join(wanted, "doc").select("doc", "said_hash", "said", "wanted")
    segments = texts.mapInArrow(lambda x: _segments(kind, x), "doc long, said_hash long, start long, key long, segment binary")
    segments = write_table(segments.withColumn("seg_hash", F.xxhash64("segment")))
    drop_table(wanted)
    unique = write_table(segments.groupBy("key", "seg_hash", "segment").agg(F.min("doc").alias("low"), F.count("*").alias("n")))
    rows, cuts, made = _uncrowded(kind, unique, crowd)
    size = rows.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    sharded = rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard")
    found = sharded.applyInArrow(lambda x: index(kind, x), "key long, segment binary, found array<long>")
    found = write_table(found.select("key", F.xxhash64("segment").alias("seg_hash"), F.lit(0).cast("long").alias("shift"), "found"))
    drop_table(*made)
    for parts in reversed(cuts):
        mine = found.select(F.col("key").alias("child_key"), F.col("seg_hash").alias("child_hash"), F.col("shift").alias("child_shift"), "found")
        moved = parts.select("key", "seg_hash", "shift", "child_key", "child_hash").join(mine, ["child_key", "child_hash"])
        before, found = found, write_table(found.union(moved.select("key", "seg_hash", F.col("shift") + F.col("child_shift"), "found")))
        drop_table(before, parts)
    out = segments.select("doc", "said_hash", "start", "key", "seg_hash").join(found, ["key", "seg_hash"])
    return out.select("doc", "said_hash", (F.col("start") + F.col("shift")).alias("start"), "found"), [segments, found]
