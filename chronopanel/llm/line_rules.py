"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits as 0, white space as one space) and hashed. For each host the distinct
documents of each line are counted, by document id; lines above the limit are removed, and a document of
which too few words are left is rejected. Rules on the text alone (too few words, too many words in repeated 3-word
windows) come with it, and their counts.

Counts are summed before they are shuffled. Lines above the limit are at most lines / limit; they are counted, and go
to all executors only up to `MOST_SENT` of them; beyond that the join deals each line's rows by a salt as well.

Cases: null, empty or blank text has no words and fails; a null host is one host; repeated rows are judged alike, each
by itself, and rows of one doc_id count once; a row with a null doc_id is a document of its own; lines without words count nowhere; an empty table gives no rows;
other columns pass through in remove_frequent_lines().
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import textblocks as tb
from chronopanel.llm.rows import free_name, with_verdict
from chronopanel.llm.scratch import write_table

#: Distinct documents of one host in which a line may stand.
MOST_DOCUMENTS = 50
#: Of 10 words of a document, so many may be removed.
MOST_REMOVED = 7
#: The rules of single texts: least words, and the most of 100 words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Frequent lines that are broadcast, at most: two numbers each.
MOST_SENT = 500_000
SALTS = 32
BLOCK_BYTES = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NUMBERS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("line_words", T.ArrayType(T.LongType()))])
# Bytes that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PLAIN = tb.LOWER.copy()
PLAIN[0x30:0x3A] = 0x30


def _again(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values stand more than once in the same owner's, and which of them not for the first time."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later = np.zeros(len(order), bool)
    later[order] = same
    more = same.copy()
    more[:-1] |= same[1:]
    often = np.zeros(len(order), bool)
    often[order] = more
    return often, later


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin and end (without the line break); a text's last line may be empty and is then left out."""
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    ends = np.append(begins[1:], len(data))
    return begins, ends - (data[ends - 1] == 0x0A)


def _numbers(texts: pa.Array) -> pa.Array:
    counts: list[list[np.ndarray]] = [[] for _ in COUNTS]
    hashes, words, sizes = [], [], [np.zeros(1, np.int64)]
    for a, b, data, offsets in tb.blocks(texts, BLOCK_BYTES):
        n = b - a
        starts, ends, firsts = tb.word_spans(data, offsets, tb.SPACE)
        by_doc = lambda marks: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)]))  # noqa: E731, B023
        values = tb.word_hashes(data, starts, ends)
        windows = tb.starts_of_windows(firsts, 3)
        owner = tb.owners(firsts)
        often, _ = _again(tb.gram_hashes(values, 3)[windows], owner[windows]) if len(windows) else (windows.astype(bool), None)
        covered = tb.covered(windows[often], 3, len(values))
        begins, stops = _line_spans(data, offsets)
        first_words = np.searchsorted(starts, np.append(begins, len(data)))
        has = np.flatnonzero(np.diff(first_words))
        begins, stops, in_line, first_words = begins[has], stops[has], np.diff(first_words)[has], first_words[:-1][has]
        line_doc = np.searchsorted(offsets, begins, "right") - 1
        _, later = _again(tb.word_hashes(data, begins, stops), line_doc)
        plain = tb.word_hashes(PLAIN[data], starts, ends)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain * tb.powers(len(plain))[: len(plain)])])
        lines = tb.mix((total[first_words + in_line] - total[first_words]) * tb.powers(len(plain), "down")[first_words] + in_line.astype(np.uint64))
        made = (np.diff(firsts), by_doc(~tb.SPACE[data] & ((data & 0xC0) != 0x80)), by_doc(SYMBOLS[data]), np.bincount(line_doc[later], minlength=n), np.bincount(owner[covered], minlength=n))
        for out, x in zip(counts, made, strict=True):
            out.append(x)
        hashes.append(lines.view(np.int64))
        words.append(in_line)
        sizes.append(np.bincount(line_doc, minlength=n))
    flat = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (*counts, hashes, words)]
    at = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
    return pa.StructArray.from_arrays([*flat[:5], *(pa.ListArray.from_arrays(at, x) for x in flat[5:])], names=[f.name for f in NUMBERS.fields])


def _host(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), column.cast("string")), F.lit(""))


def frequent_lines(table: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, line, n_documents) of lines above the limit, from a table of host, document, lines."""
    once = table.select("host", "document", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line", "document").agg(F.count("*").alias("rows"))
    return once.groupBy("host", "line").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") > most)


def with_line_counts(docs: DataFrame, host: str = "source", text: str = "text", keep: Sequence[str] | None = None, most: int = MOST_DOCUMENTS, name: str = "rules", doc_id: str = "doc_id") -> DataFrame:
    """docs with a struct column `name` (with underscores after it where docs has one): the counts of COUNTS, n_frequent_words, frequent (places of frequent lines among the lines with words)."""
    keep = list(docs.columns if keep is None else keep)
    name = free_name(docs, name)
    mine = {w: free_name(docs, w) for w in ("row", "host", "document", "numbers")}
    document = F.when(docs[f"`{doc_id}`"].isNotNull(), F.xxhash64(docs[f"`{doc_id}`"]))
    wide = docs.select(*(docs[f"`{c}`"] for c in dict.fromkeys([*keep, text])), _host(docs[host]).alias(mine["host"]), document.alias(mine["document"]))
    table = with_verdict(wide, _numbers, [text], NUMBERS, mine["numbers"], keep=[*keep, mine["host"], mine["document"]])
    table = write_table(table.withColumn(mine["row"], F.monotonically_increasing_id()))
    numbers = F.col(mine["numbers"])
    of_row = F.coalesce(mine["document"], F.xxhash64(F.lit("row"), mine["row"]))
    lean = table.select(F.col(mine["row"]).alias("row"), F.col(mine["host"]).alias("host"), of_row.alias("document"), numbers["lines"].alias("lines"), numbers["line_words"].alias("line_words"))
    frequent = write_table(frequent_lines(lean, most).select("host", "line"))
    spots = lean.select("row", "host", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "x")).select("row", "host", "place", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    if frequent.count() <= MOST_SENT:
        found = spots.join(F.broadcast(frequent), ["host", "line"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = spots.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    gone = found.groupBy("row").agg(F.sum("words").alias("n_frequent_words"), F.sort_array(F.collect_list("place")).alias("frequent"))
    gone = gone.select(F.col("row").alias(free_name(table, "of_row")), "n_frequent_words", "frequent")
    joined = table.join(gone, table[mine["row"]] == gone[gone.columns[0]], "left")
    made = F.struct(*(numbers[c].alias(c) for c in COUNTS), F.coalesce(gone["n_frequent_words"], F.lit(0)).alias("n_frequent_words"), gone["frequent"].alias("frequent"))
    return joined.select(*(table[f"`{c}`"] for c in keep), made.alias(name))


def base_failed(rules: Column) -> Column:
    return (rules["n_words"] < LEAST_WORDS) | (100 * rules["n_repeat_words"] > MOST_REPEATED * rules["n_words"])


def is_depleted(rules: Column) -> Column:
    return 10 * rules["n_frequent_words"] > MOST_REMOVED * rules["n_words"]


def _without_lines(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, at in zip(texts.to_pylist(), places.to_pylist(), strict=True):
        if not at:
            out.append(text)
            continue
        gone, seen, kept = set(at), -1, []
        for line in text.split("\n"):
            has = bool(line.strip(" \t\n\v\f\r"))
            seen += has
            if not (has and seen in gone):
                kept.append(line)
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def remove_frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", most: int = MOST_DOCUMENTS, doc_id: str = "doc_id") -> DataFrame:
    """docs that pass, each text without the lines above the limit."""
    name = free_name(docs, "rules")
    found = with_line_counts(docs, host, text, most=most, name=name, doc_id=doc_id)
    found = found.where(~base_failed(F.col(name)) & ~is_depleted(F.col(name)))
    places, fresh = free_name(found, "places"), free_name(found, "cleaned")
    out = with_verdict(found.withColumn(places, F.col(name)["frequent"]), _without_lines, [text, places], T.StringType(), fresh)
    return out.select(*(F.col(f"`{fresh}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
