"""Document likelihood by a subword lattice.

A text is its words (A-Z lower-cased, each behind a word mark) and one end. Pieces of an existing vocabulary and the end
are drawn one after another; the probability of a text is the sum over all segmentations into pieces, by forward
recursion in log space. No piece crosses a word mark, so the sum is a product over the words and the end.

Weights: the vocabulary's own scores stand for `strength` pieces, seen before any text; to these are added the expected
counts over all training words (some rounds of forward-backward, each distinct word once with its count in the whole
corpus). So weights sum to one over pieces and end, and probabilities to at most one over all texts.

Texts are held once in encoded blocks (word numbers and the block's own word list), so that counts and probabilities
go by block and word, not by document and word. Words of many blocks are broadcast (of a bounded number), others shuffled, when blocks get their words' probabilities. All words of all training documents count; the result of a fit is as
large as the vocabulary file, whatever the corpus.

Cases: null or empty text is the end alone; without training documents the vocabulary's scores stand alone; a null
doc_id is training text; repeated rows count as often as they stand; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import textblocks as tb
from chronopanel.llm.lattice import Lattice, Vocabulary, read_vocabulary
from chronopanel.llm.scratch import drop_table, write_table

#: Bytes of text in one encoded block; the arrays made of it take some thirty times as much.
BLOCK_BYTES = 9 << 20
#: Blocks from which a word may be broadcast with its numbers, and how many words at most; of more words, those of most blocks.
OFTEN, MOST_SENT = 64, 500_000
ROUNDS = 3
#: Pieces of text for which the vocabulary's own scores stand; the end stands for one.
STRENGTH = 10_000.0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, said, held_out -> for each block its documents (codes) and its words (word, code, times in training)."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    names = ["block", "doc", "held_out", "codes", "word", "code", "n_train"]
    for batch in batches:
        for a, b, data, offsets in tb.blocks(batch.column(1), BLOCK_BYTES):
            data = tb.LOWER[data]
            starts, ends, firsts = tb.word_spans(data, offsets, tb.SPACE)
            _, first, codes = np.unique(tb.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            held = batch.column(2).slice(a, b - a)
            trained = ~np.repeat(np.asarray(held), np.diff(firsts))
            times = np.bincount(codes[trained], minlength=len(first))
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            flat = codes.astype("<u4").tobytes()
            n, m = b - a, len(words)
            columns = [
                pa.array(np.full(n + m, block)),
                pa.concat_arrays([batch.column(0).slice(a, n), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([held, pa.nulls(m, pa.bool_())]),
                pa.array([flat[4 * s : 4 * e] for s, e in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)] + [None] * m, pa.binary()),
                pa.array([None] * n + words, pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))]),
            ]
            block += 1
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            for at in range(0, whole.num_rows, 50_000):
                yield whole.slice(at, 50_000)


def _decoded(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def fit_pieces(words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = ROUNDS, strength: float = STRENGTH) -> tuple[np.ndarray, float]:
    """Probabilities of the pieces and of the end, fitted to words (word, c). Each round brings one number for each piece to the driver."""
    n, prior = len(vocabulary.pieces), strength * vocabulary.weights
    pieces, end = prior / (strength + 1), 1 / (strength + 1)
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((vocabulary, np.log(pieces)))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*sent.value), np.zeros(n)
            for batch in batches:
                total += lattice.expected_counts(_decoded(batch.column(0)), np.asarray(batch.column(1)).astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        found = words.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = prior.copy()
        for r in found:
            counts[r.piece] += r.n
        whole = counts.sum() + ends + 1
        pieces, end = counts / whole, (ends + 1) / whole
        sent.unpersist()
    return pieces, end


def _in_blocks(lists: DataFrame, weighed: DataFrame) -> DataFrame:
    """lists (block, code, word) with the columns of their words.

    A word has a row for each block that it stands in. Words of more than `often` blocks go to all executors, so that none of
    them is one task; there are at most MOST_SENT, as all blocks' rows are no more than MOST_SENT times `often`. Other words are joined by a shuffle.
    """
    rows = weighed.agg(F.sum("blocks")).first()[0] or 0
    often = max(OFTEN, -(-rows // MOST_SENT))
    sent = F.broadcast(weighed.where(F.col("blocks") > often))
    rest = lists.join(F.broadcast(weighed.where(F.col("blocks") > often).select("word")), "word", "left_anti")
    return lists.join(sent, "word").unionByName(rest.join(weighed.where(F.col("blocks") <= often), "word"))


def score_documents(docs: DataFrame, vocabulary: str, held_out, rounds: int = ROUNDS, strength: float = STRENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column; other rows train.

    vocabulary: path of a sentencepiece file, read on the driver. Scores are base-10 logarithms.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("said"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    encoded = write_table(chosen.mapInArrow(_encode, "block long, doc long, held_out boolean, codes binary, word binary, code int, n_train long"))
    lists, texts = encoded.where("word IS NOT NULL"), encoded.where("codes IS NOT NULL")
    words = write_table(lists.groupBy("word").agg(F.sum("n_train").alias("c"), F.count("*").alias("blocks")))
    known = words.where("c > 0").select("word", "c")
    ends = texts.where("NOT held_out").count()
    s = known.agg(F.count("*").alias("types"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, types = s.n + ends, s.types + (ends > 0)
    vocabulary = read_vocabulary(vocabulary)
    pieces, end = fit_pieces(known, ends, vocabulary, rounds, strength)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, np.log(pieces)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for batch in batches:
            log_p = lattice.log_marginals(_decoded(batch.column(0))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_p)], names=["word", "c", "blocks", "log_p"])

    weighed = write_table(words.mapInArrow(weigh, "word binary, c long, blocks long, log_p double"))
    drop_table(words)
    found = _in_blocks(lists.select("block", "code", "word"), weighed).select(F.col("block").alias("of_block"), "code", "c", "log_p")
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (types + 1)))
    log_end = float(np.log10(end))

    def sum_up(texts: pa.Table, words: pa.Table) -> pa.Table:
        code = np.asarray(words.column("code"))
        c, log_p = np.zeros(len(code)), np.zeros(len(code))
        c[code], log_p[code] = np.asarray(words.column("c")), np.asarray(words.column("log_p"))
        base = base_of(c)
        rows = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for raw in texts.column("codes").to_pylist():
            mine = np.frombuffer(raw, "<u4")
            rows["n_tokens"].append(len(mine) + 1)
            rows["n_known"].append(int((c[mine] > 0).sum()) + (ends > 0))
            rows["base_score"].append(float(base[mine].sum() + base_of(ends)))
            rows["score"].append(float(log_p[mine].sum() + log_end))
        made = [pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["n_known"], pa.int64()), pa.array([n] * len(texts), pa.int64()), pa.array(rows["base_score"], pa.float64()), pa.array(rows["score"], pa.float64())]
        return pa.table([texts.column("doc"), texts.column("held_out"), *made], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = texts.select(F.col("block").alias("text_block"), "doc", "held_out", "codes").groupBy("text_block").cogroup(found.groupBy("of_block"))
    return both.applyInArrow(sum_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
