"""Substring deduplication: a compressed FM-index for each shard of text, searched backward with streamed documents.

Words are runs of anything but ASCII white space. A window is `n` consecutive words of one document; a word goes if
some window over it also starts in a document with a smaller id. Windows are judged on the input.

The shards hold each different stretch of text once (see segments.py), with the least document that has it. In each, all
stretches are indexed, and those that aren't an anchor's first are streamed backward against it: the matching statistic of
a position is the length of the longest match from there on with a document before. Matches of n words or more are
reported as intervals. A stretch that another document also has goes there as a whole.

Cases: null or empty text has no words; fewer than n words stay; rows that share a doc_id don't count as smaller, and
each keeps its own result; rows with a null doc_id are not compared and lose nothing; repeated rows get equal results;
an empty table gives no rows; columns beside the text pass through in remove_repeats().
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import textblocks as tb
from chronopanel.llm.fm_index import FMIndex
from chronopanel.llm.rows import free_name, with_verdict
from chronopanel.llm.scratch import drop_table, write_table
from chronopanel.llm.segments import Windows, find_repeats

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def earlier_matches(kind: Windows, shard: pa.Table) -> pa.Table:
    """For each segment of a shard its least document, its words, and (start, length) of the intervals in it that a document before has.

    Segments of one document without such intervals are left out. Segments whose anchor has no other need no index.
    """
    low, n = np.asarray(shard.column("low")), np.asarray(shard.column("n"))
    _, key, times = np.unique(np.asarray(shard.column("key")), return_inverse=True, return_counts=True)
    found: dict[int, list[int]] = {}
    rows = np.flatnonzero(times[key] > 1)
    if len(rows):
        first = np.full(len(times), np.iinfo(np.int64).max)
        np.minimum.at(first, key, low)
        streamed = low[rows] > first[key[rows]]
        found = dict(zip(rows[streamed].tolist(), _intervals(kind.size, shard.column("segment").take(rows).to_pylist(), low[rows], streamed), strict=True))
    take = [i for i in range(len(low)) if n[i] > 1 or found.get(i)]
    segments = shard.column("segment").take(pa.array(take, pa.int64()))
    lists = [[int(low[i]), s.count(b" ") + 1, *found.get(i, ())] for i, s in zip(take, segments.to_pylist(), strict=True)]
    return pa.table([shard.column("key").take(pa.array(take, pa.int64())), segments, pa.array(lists, pa.list_(pa.int64()))], names=["key", "segment", "found"])


def _intervals(n: int, segments: list[bytes], low: np.ndarray, streamed: np.ndarray) -> list[list[int]]:
    """For the streamed segments, starts and lengths of their matches of n words or more with a segment of a smaller low; none within another."""
    ids: dict[bytes, int] = {}
    lists = [[ids.setdefault(w, len(ids) + 1) for w in s.split(b" ")] for s in segments]
    sizes = np.array([len(x) for x in lists], np.int64)
    tokens = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.ones(len(tokens), bool)
    inside[firsts[1:] - 1] = False
    tokens[inside] = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    documents = np.unique(low, return_inverse=True)[1].astype(np.int32)
    index = FMIndex(tokens, np.repeat(documents, sizes + 1), int(sizes.max()) + 1)
    sizes = sizes[streamed]
    length = index.matching_statistics(tokens, firsts[:-1][streamed], sizes, documents[streamed])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    reach = place + np.where(length >= n, length, -place)
    at = np.flatnonzero((length >= n) & ((place == 0) | (reach > np.concatenate([[0], reach[:-1]]))))
    pairs = np.stack([place[at], length[at]], axis=1).ravel().tolist()
    bounds = (2 * np.searchsorted(owner[at], np.arange(len(sizes) + 1))).tolist()
    return [pairs[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def repeated_spans(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, said_hash, spans): of each document with any, the words that an earlier document has, as structs start, length."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("said")).where("doc IS NOT NULL")
    found, made = find_repeats(chosen, Windows(n, max(1, min(5, n - 4)), True), earlier_matches)
    spans = F.expr(
        """CASE WHEN doc > found[0] THEN array(named_struct('start', start, 'length', found[1]))
           WHEN size(found) > 2 THEN transform(sequence(2, size(found) - 2, 2), i -> named_struct('start', start + found[i], 'length', found[i + 1])) END"""
    )
    found = found.select("doc", "said_hash", spans.alias("spans")).where("spans IS NOT NULL")
    found = write_table(found.groupBy("doc", "said_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    drop_table(*made)
    return found


def _apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
    totals, removed, out = [], [], []
    sizes = spans.value_lengths().fill_null(0).to_pylist()
    flat = spans.flatten()
    start, length, at = np.asarray(flat.field("start")), np.asarray(flat.field("length")), 0
    for text, size in zip(texts.to_pylist(), sizes, strict=True):
        words = (text or "").encode().split()  # at ASCII white space
        totals.append(len(words))
        gone = tb.covered(start[at : at + size], length[at : at + size], len(words)) if size else None
        at += size
        removed.append(0 if gone is None else int(gone.sum()))
        out.append(b" ".join(words if gone is None else compress(words, (~gone).tolist())).decode())
    return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["n_words", "n_removed", "text"])


def without_repeats(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, name: str = "result") -> DataFrame:
    """docs with a struct column `name`: n_words, n_removed, text (kept words joined by one space)."""
    name = free_name(docs, name)
    found = repeated_spans(docs, n, doc_id, text)
    keep = list(docs.columns if keep is None else keep)
    mine = [free_name(docs, x) for x in ("found_spans", "found_doc", "found_hash")]
    found = found.select(F.col("spans").alias(mine[0]), F.col("doc").alias(mine[1]), F.col("said_hash").alias(mine[2]))
    joined = docs.join(found, (docs[doc_id].cast("long") == found[mine[1]]) & (F.xxhash64(docs[text]) == found[mine[2]]), "left")
    return with_verdict(joined, _apply, [text, mine[0]], RESULT, name, keep=keep)


def remove_repeats(docs: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, texts with repeats rewritten as their kept words joined by one space; a text that lost nothing stays as it is."""
    name = free_name(docs, "result")
    out = without_repeats(docs, n, doc_id, text, name=name)
    fresh = F.when(F.col(f"{name}.n_removed") > 0, F.col(f"{name}.text")).otherwise(F.col(f"`{text}`"))
    return out.select(*(fresh.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))

