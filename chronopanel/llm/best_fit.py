"""Packing documents whole into few sequences by bulk-synchronous best fit.

Only documents longer than a sequence are cut, into full sequences and a rest. What is left (rests and short documents) meets
the gaps of open sequences in rounds. A round range-sorts documents and gaps together by size, a document before a gap
of its size, and sweeps upwards: a gap takes the largest document below it that no smaller gap has taken. Within a range that is a
stack; what a range can't match in itself it leaves as a number of documents on top of the stack, or of gaps that want
some. From these two numbers for each range follows which documents of which earlier range (by rank from the top) the
gaps of a later one take, so that the rest of the round is one join by range and rank. Gaps are then updated, and the
next round begins. Where the sweep places hardly anything any more, sequences are opened for what is left, as many as its tokens fill.
Once that is a hundredth of the documents, and no more than LAST_MOST of them, one task ends it by sequential best fit into new sequences.

A gap that may take many documents would need as many rounds. Documents below a quantum (a share of what a gap takes on
average, less in each round) are therefore swept in bundles of neighbours of about its size; a bundle is matched as one, and if it isn't, its
documents are free again. The share halves what is left every few rounds, so rounds grow with the logarithm of the documents in a sequence.

Through the driver go, a round, two numbers for each range and the totals of what is left. A range's arrays are in one task: make ranges as many as needed with spark.sql.shuffle.partitions. What a
round leaves, and what it has placed, is written to the shared folder; nothing else of it is kept.

Cases: null or empty text is the end token alone; repeated rows are packed each by itself; a null id is carried; an empty
table gives no rows; other columns are not read; equal sizes are taken by id, then piece, and rows equal in these are alike.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm.packing import WordCachedTokenizer
from chronopanel.llm.scratch import drop_table, write_table

#: What a row of a round is: a document or a gap still free, a document that has its place, a gap that is done for the round, what a range leaves (rank: gaps that want, within: bundles on the stack).
DOC, GAP, PLACED, USED, ENDS = range(5)
PIECE = ("doc_id", "piece", "start", "ids_crc32")
ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("what", "range", "rank", "within", "total", "size", *PIECE, "bin", "offset")])
#: Gaps that are broadcast to documents of other ranges, at most: four numbers each; beyond that the join is shuffled.
MOST_SENT = 200_000
#: Documents that one task may end with, at most, and as a part of all.
LAST_MOST, LAST_PART = 100_000, 0.01
#: Quantum of the first rounds and of later ones, as a part of what a gap takes on average; a sweep that places less than FEW of the documents has placed hardly anything.
FIRST_SHARE, LATER_SHARE, FEW = 8, 1.3, 0.02


def cut_pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as tokens, those longer than `size` cut into pieces of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, stop = WordCachedTokenizer(vocabulary), np.array([end], np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([ids, stop])
                    for k, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        rows.append((doc, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[f"`{doc_id}`"].cast("long"), docs[f"`{text}`"]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _sweep(size: int, quantum: float):
    """Python of one range: rows (key, kind, size, piece columns, bin) in order of key and kind -> rows of ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        kinds, sizes = table.column("what").to_numpy(), table.column("size").to_numpy()
        of_bundle = np.maximum(1, (quantum // np.maximum(sizes, 1)).astype(np.int64)).tolist()
        small = sizes.tolist()
        stack: list[list[int]] = []
        partial: dict[int, list[int]] = {}
        taken: list[tuple[int, list[int]]] = []
        wanting: list[int] = []
        for i, kind in enumerate(kinds.tolist()):
            if kind == GAP:
                if stack:
                    taken.append((i, stack.pop()))
                else:
                    wanting.append(i)
            elif of_bundle[i] == 1:
                stack.append([i])
            else:
                bundle = partial.setdefault(of_bundle[i], [])
                bundle.append(i)
                if len(bundle) == of_bundle[i]:
                    stack.append(bundle)
                    del partial[of_bundle[i]]
        stack.extend(partial.values())
        n = len(sizes)
        what, rank, within, total, left = kinds.astype(np.int64).copy(), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), sizes.astype(np.int64).copy()
        bins, offsets = table.column("bin").fill_null(0).to_numpy().copy(), np.zeros(n, np.int64)
        for r, bundle in enumerate(stack, 1):
            at, whole = 0, sum(small[i] for i in bundle)
            for i in bundle:
                rank[i], within[i], total[i] = r, at, whole
                at += small[i]
        for gap, bundle in taken:
            at = size - small[gap]
            for i in bundle:
                what[i], bins[i], offsets[i] = PLACED, bins[gap], at
                at += small[i]
            what[gap], left[gap] = USED, size - at
        rank[wanting] = np.arange(1, len(wanting) + 1)
        keep = ~((what == USED) & (left == 0))
        number = np.full(n, TaskContext.get().partitionId(), np.int64)
        made = {"what": what, "range": number, "rank": rank, "within": within, "total": total, "size": left, "bin": bins, "offset": offsets}
        out = pa.table([pa.array(made[f.name]) if f.name in made else table.column(f.name).cast(pa.int64()) for f in ROW.fields], names=ROW.fieldNames()).filter(pa.array(keep))
        yield from out.to_batches(max_chunksize=10_000)
        left_over = {"what": ENDS, "range": number[0], "rank": len(wanting), "within": len(stack)}
        yield pa.RecordBatch.from_arrays([pa.array([left_over.get(f.name)], pa.int64()) for f in ROW.fields], names=ROW.fieldNames())

    return run


def placed_in_turn(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence from 0, offset) of each length, the longest first, each into the smallest gap that holds it, or a new sequence."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    gaps: list[tuple[int, int]] = []
    opened = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(gaps, (lengths[i], -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        else:
            gap, number, opened = size, opened, opened + 1
        out[i] = (number, size - gap)
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], number))
    return out


def _ended(docs: DataFrame, first: int, size: int) -> DataFrame:
    """The documents that are left, a bounded number, in new sequences from `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            places = placed_in_turn(table.column("size").to_pylist(), size)
            made = {"what": [PLACED] * len(places), "bin": [first + b for b, _ in places], "offset": [at for _, at in places]}
            out = pa.table([pa.array(made[f.name], pa.int64()) if f.name in made else table.column(f.name) for f in ROW.fields], names=ROW.fieldNames())
            yield from out.to_batches(max_chunksize=10_000)

    return docs.repartition(1).mapInArrow(run, ROW)


def matched_ranges(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range, first, last, of_range, top): its wanting gaps first..last take the documents of the stack of of_range from rank top downwards. counts: (range, wanting gaps, documents on the stack), ascending."""
    stack: list[list[int]] = []
    found = []
    for number, wanting, has in counts:
        at = 1
        while at <= wanting and stack:
            of, top = stack[-1]
            n = min(top, wanting - at + 1)
            found.append((number, at, at + n - 1, of, top))
            at += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if has:
            stack.append([number, has])
    return found


def _met(swept: DataFrame, size: int) -> DataFrame:
    """The round's rows after gaps have taken documents of earlier ranges too."""
    spark = swept.sparkSession
    ends = swept.where(F.col("what") == ENDS).select("range", "rank", "within").collect()
    pairs = matched_ranges(sorted(tuple(r) for r in ends))
    schema = "in_range long, first long, last long, of_range long, top long"
    where = F.broadcast(spark.createDataFrame(pairs, schema))
    gaps = swept.where(F.col("what") == GAP)
    gaps = gaps.join(where, (F.col("range") == F.col("in_range")) & F.col("rank").between(F.col("first"), F.col("last")), "left")
    taking = gaps.where("of_range IS NOT NULL").select("of_range", (F.col("top") - F.col("rank") + F.col("first")).alias("of_rank"), F.col("bin").alias("of_bin"), F.col("size").alias("gap"))
    few = sum(last - first + 1 for _, first, last, _, _ in pairs) <= MOST_SENT
    docs = swept.where(F.col("what") == DOC).join(F.broadcast(taking) if few else taking, (F.col("range") == F.col("of_range")) & (F.col("rank") == F.col("of_rank")), "left")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    took = F.col("of_bin").isNotNull()
    own = {"what": F.when(took, PLACED).otherwise(DOC).cast("long"), "bin": F.col("of_bin"), "offset": F.when(took, size - F.col("gap") + F.col("within")).otherwise(zero)}
    rest = F.col("gap") - F.col("total")
    gap = {"what": F.lit(GAP).cast("long"), "size": rest, "bin": F.col("of_bin"), **{c: zero for c in ("range", "rank", "within", "total", "offset")}, **{c: none for c in PIECE}}
    row = lambda new: F.struct(*(new.get(c, F.col(c)).alias(c) for c in ROW.fieldNames()))
    both = F.when(took & (F.col("within") == 0) & (rest > 0), F.array(row(own), row(gap))).otherwise(F.array(row(own)))
    still = gaps.where("of_range IS NULL").select(*ROW.fieldNames()).unionByName(swept.where(F.col("what") == USED).withColumn("what", F.lit(GAP).cast("long")))
    return docs.select(F.inline(both)).unionByName(still).unionByName(swept.where(F.col("what") == PLACED))


def _opened(spark: SparkSession, first: int, n: int, size: int) -> DataFrame:
    new = {"what": F.lit(GAP), "size": F.lit(size), "bin": F.col("id"), "range": F.lit(0), "rank": F.lit(0), "within": F.lit(0), "total": F.lit(0), "offset": F.lit(0)}
    return spark.range(first, first + n).select(*(new.get(c, F.lit(None)).cast("long").alias(c) for c in ROW.fieldNames()))


def best_fit(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; each of `size` at most) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = write_table(pieces.withColumn("number", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") >= size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = {"what": F.lit(DOC), "size": F.col("length"), **{c: F.col(c) for c in PIECE}, "bin": F.lit(None)}
    state = pieces.where(F.col("length") < size).select(*(part.get(c, F.lit(0)).cast("long").alias(c) for c in ROW.fieldNames()))
    tables: list[DataFrame] = []
    opened, share, stuck, single, alone, before, all_, smallest = 0, FIRST_SHARE, True, False, False, None, None, 1
    while True:
        is_doc, holds = F.col("what") == DOC, (F.col("what") == GAP) & (F.col("size") >= smallest)
        n, tokens, least, n_gaps = state.agg(F.count(F.when(is_doc, 1)), F.sum(F.when(is_doc, F.col("size"))), F.min(F.when(is_doc, F.col("size"))), F.count(F.when(holds, 1))).first()
        if not n:
            break
        smallest, all_ = least, all_ or n
        gaps = state.where((F.col("what") == GAP) & (F.col("size") >= smallest))
        if before is not None:
            few = before - n < FEW * before
            stuck, single = few and alone, single or few
        if (stuck or not n_gaps) and n <= min(LAST_MOST, LAST_PART * all_):
            tables.append(write_table(_ended(state.where(is_doc), opened, size)))
            break
        now = state.where(F.col("what") == DOC).unionByName(gaps)
        if stuck or not n_gaps:
            more = -(-tokens // size)
            now = now.unionByName(_opened(spark, opened, more, size))
            share, single, n_gaps, opened = LATER_SHARE if opened else FIRST_SHARE, False, n_gaps + more, opened + more
        quantum = 0.0 if single else tokens / (share * n_gaps)
        alone, before = quantum < 2 * smallest, n
        bundle = F.when(F.col("what") == DOC, F.greatest(F.lit(1), F.floor(F.lit(quantum) / F.col("size")))).otherwise(1)
        order = ("key", "what", "size", "doc_id", "piece")
        lean = now.select((F.col("size") * bundle).alias("key"), "what", "size", *PIECE, "bin").repartitionByRange(*order).sortWithinPartitions(*order)
        swept = write_table(lean.mapInArrow(_sweep(size, quantum), ROW))
        state = write_table(_met(swept, size))
        drop_table(swept)
        tables.append(state)
    placed = spark.read.schema(ROW).parquet(*(t.written_at for t in tables)).where(F.col("what") == PLACED) if tables else state
    rest = placed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", F.col("size").alias("length"), "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return full.unionByName(rest)


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: path of a tokenizer file that executors can read."""
    return best_fit(cut_pieces(docs, vocabulary, size, end, doc_id, text), size)
