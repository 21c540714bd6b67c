"""Suffix-array deduplication of bytes: common-prefix interval trees over enhanced suffix arrays.

Texts are UTF-8 bytes. A byte goes if a string of `n` bytes over it also starts anywhere else, in the same text or
another; strings are judged on the input and overlaps count.

Each shard (see segments.py) holds different stretches of text once. A stack scan over its enhanced suffix array lists
the common-prefix intervals of n bytes or more; an interval whose occurrences differ in the byte before them is a
maximal repeat, given with all occurrences and named by a hash of its bytes. Every repeated string of n bytes lies in
a maximal repeat at each of its occurrences, so their union is what goes. A stretch found more than once as it stands
is a repeat as a whole.

Cases: null or empty text has no bytes; repeated rows repeat each other; rows that share a doc_id are texts of their
own; a null doc_id takes part as any other; a character cut in part makes bytes that aren't UTF-8, kept as bytes in
the result and replaced in texts; an empty table gives no rows; columns beside the text pass through in remove_repeats().
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import textblocks as tb
from chronopanel.llm.repeats import repeat_groups
from chronopanel.llm.rows import free_name, with_verdict
from chronopanel.llm.scratch import drop_table, write_table
from chronopanel.llm.segments import Windows, find_repeats

RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("rest", T.BinaryType())])
GRAM_SHARE = 2
#: Bytes of segments in one shard; the arrays made of it take some 150 times as much.
SHARD_BYTES = 1 << 20


def _name(text: bytes) -> int:
    return zlib.crc32(text) << 31 | zlib.adler32(text) >> 1


def repeats_in_shard(kind: Windows, shard: pa.Table) -> pa.Table:
    """For each segment the repeats in it as triples (offset, length, name), none within another of the same segment.

    A segment that occurs again is a repeat as a whole, and nothing in it needs to be listed; where its anchor has no
    other segment, it needs no index either.
    """
    segments, n = shard.column("segment").to_pylist(), np.asarray(shard.column("n"))
    _, key, times = np.unique(np.asarray(shard.column("key")), return_inverse=True, return_counts=True)
    whole = np.flatnonzero(n > 1)
    indexed = np.flatnonzero((times[key] > 1) | (n == 1))
    group, length, who, at = repeat_groups([segments[i] for i in indexed], kind.size)
    who = indexed[who]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    names = np.array([_name(segments[i][a : a + m]) for i, a, m in zip(who[first].tolist(), at[first].tolist(), length[first].tolist(), strict=True)], np.int64)
    take = np.flatnonzero(n[who] == 1)
    who, at, length, name = who[take], at[take], length[take], names[group[take]]
    who = np.concatenate([who, whole])
    at = np.concatenate([at, np.zeros(len(whole), np.int64)])
    length = np.concatenate([length, [len(segments[i]) for i in whole]]).astype(np.int64)
    name = np.concatenate([name, [_name(segments[i]) for i in whole]]).astype(np.int64)
    order = np.lexsort((-length, at, who))
    who, at, length, name = who[order], at[order], length[order], name[order]
    reach = who * (1 << 40) + at + length
    keep = np.ones(len(who), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    who, at, length, name = who[keep], at[keep], length[keep], name[keep]
    begin = np.flatnonzero(np.diff(who, prepend=-1))
    triples = pa.array(np.stack([at, length, name], axis=1).ravel())
    found = pa.ListArray.from_arrays(pa.array(np.append(3 * begin, 3 * len(who)).astype(np.int32)), triples)
    rows = pa.array(who[begin])
    return pa.table([shard.column("key").take(rows), shard.column("segment").take(rows), found], names=["key", "segment", "found"])


def repeats(docs: DataFrame, n: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, said_hash, spans): of each text with any, its repeats as structs start, length, name. Null ids have a stand-in."""
    doc = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    chosen = docs.select(doc.alias("doc"), F.col(text).alias("said"))
    found, made = find_repeats(chosen, Windows(n, max(1, n // GRAM_SHARE), False), repeats_in_shard, SHARD_BYTES)
    spans = F.expr("transform(sequence(0, size(found) - 1, 3), i -> named_struct('start', start + found[i], 'length', found[i + 1], 'name', found[i + 2]))")
    found = found.select("doc", "said_hash", spans.alias("spans"))
    found = write_table(found.groupBy("doc", "said_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    drop_table(*made)
    return found


def _apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
    total, removed, runs, rest = [], [], [], []
    sizes = spans.value_lengths().fill_null(0).to_pylist()
    flat = spans.flatten()
    start, length, at = np.asarray(flat.field("start")), np.asarray(flat.field("length")), 0
    for text, size in zip(texts.to_pylist(), sizes, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        gone = tb.covered(start[at : at + size], length[at : at + size], len(data))
        at += size
        total.append(len(data))
        removed.append(int(gone.sum()))
        runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0)
        rest.append(data[~gone].tobytes())
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())], names=["n_bytes", "n_removed", "n_spans", "rest"])


def without_repeats(docs: DataFrame, n: int = 200, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, name: str = "result") -> DataFrame:
    """docs with a struct column `name`: n_bytes, n_removed, n_spans (maximal removed runs), rest (the remaining bytes)."""
    name = free_name(docs, name)
    found = repeats(docs, n, doc_id, text)
    keep = list(docs.columns if keep is None else keep)
    mine = [free_name(docs, x) for x in ("found_spans", "found_doc", "found_hash")]
    found = found.select(F.col("spans").alias(mine[0]), F.col("doc").alias(mine[1]), F.col("said_hash").alias(mine[2]))
    doc = F.coalesce(docs[doc_id].cast("long"), F.xxhash64(docs[text]))
    joined = docs.join(found, (doc == found[mine[1]]) & (F.xxhash64(docs[text]) == found[mine[2]]), "left")
    return with_verdict(joined, _apply, [text, mine[0]], RESULT, name, keep=keep)


def remove_repeats(docs: DataFrame, n: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each text without its repeats."""
    name = free_name(docs, "result")
    out = without_repeats(docs, n, doc_id, text, name=name)
    fresh = F.when(F.col(f"{name}.n_removed") > 0, F.make_valid_utf8(F.col(f"{name}.rest").cast("string"))).otherwise(F.col(f"`{text}`"))
    return out.select(*(fresh.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
