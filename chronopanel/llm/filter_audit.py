"""How filters of documents interact: what each removes in every order, and what only it would.

Five failure conditions make a mask of bits for each document. Four look at the text alone. The fifth, a text equal to
that of a smaller id, comes from partition refinement: documents are split by their code-point length, then by the hash
of one block of text after another (each sixteen times as long as the one before), and classes of one document are
dropped at every step. A document leaves the refinement where its text ends. Only texts of classes that are left are
compared as a whole, each with the text of its class's least id; those that differ (equal hashes of different texts)
form classes again until none is left. Hashes therefore only save comparisons; they decide nothing.

Masks are then counted by part, and all orders are read off those counts: what passes a set of filters doesn't depend on
their order, so 32 sums for each part give every step of all 120 orders.

A class may hold any share of the rows: classes are counted before they are shuffled, the joins that drop singletons
have one row for each class on their other side, and texts meet their class's least one by class and a salt that grows with the
class. Classes that are left are broadcast up to `MOST_SENT` (four numbers each); beyond that the join is shuffled.

Cases: null text is empty, and equal to other empty texts; a null id is neither smaller nor larger than another, so its
row never fails E; rows of one id never fail E by each other; a null part is the empty string; a document without words
has no share of distinct words to fail B; labels of one id that differ count as good (toxic) if any says so, and ids
without labels or null labels are neither; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from itertools import permutations
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm.rows import with_verdict
from chronopanel.llm.scratch import drop_table, write_table

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Least words; of 100 words the least that must be distinct; of 100 code points the most that may be capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Code points of the first block, and how many times as long each next one is.
BLOCK, TIMES = 64, 16
#: Classes that are broadcast, at most.
MOST_SENT = 500_000
#: Members of a class that are dealt to one salt, about.
PER_SALT = 1000
PRINT = T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def own_mask(raw: bytes, length: int) -> int:
    """Bits of the conditions that look at the text alone: A few words, B few distinct words, C capitals, D symbols. length: its code points."""
    words = raw.split()
    mask = BIT["A"] if len(words) < LEAST_WORDS else 0
    if 100 * len(set(words)) < LEAST_DISTINCT * len(words):
        mask |= BIT["B"]
    if 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * length:
        mask |= BIT["C"]
    return mask | BIT["D"] if len(raw) > len(raw.translate(None, SYMBOLS)) else mask


def refinement_keys(text: str) -> list[int]:
    """Keys of the classes in which a text lies, one for each step: of its length, then of the length and one more block of it each time."""
    seen = blake2b(b"%d:" % len(text), digest_size=8)
    keys, at, size = [seen.digest()], 0, BLOCK
    while at < len(text):
        seen.update(text[at : at + size].encode("utf-8", "surrogatepass"))
        keys.append(seen.digest())
        at, size = at + size, size * TIMES
    return [int.from_bytes(k, "little", signed=True) for k in keys]


def _prints(texts: pa.Array) -> pa.Array:
    masks, keys = [], []
    for text in texts.to_pylist():
        text = text or ""
        masks.append(own_mask(text.encode("utf-8", "surrogatepass"), len(text)))
        keys.append(refinement_keys(text))
    return pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["mask", "keys"])


def _refined(prints: DataFrame) -> DataFrame:
    """(class, n, low): classes of two or more documents that no block splits. prints: doc_id, keys."""
    ended, live, step = [], prints, 0
    while True:
        counted = live.groupBy(F.get("keys", F.lit(step)).alias("class"), (F.size("keys") == step + 1).alias("ends")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
        counted = write_table(counted.where("n > 1"))
        ended.append(counted.where("ends").select("class", "n", "low"))
        goes_on = counted.where("NOT ends").select("class")
        if goes_on.isEmpty():
            break
        before, live = live, write_table(live.withColumn("class", F.get("keys", F.lit(step))).where(F.size("keys") > step + 1).join(goes_on, "class", "left_semi").drop("class"))
        if before is not prints:
            drop_table(before)
        step += 1
    return reduce(DataFrame.unionByName, ended)


def _marked(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of rows whose text a smaller id has as well. rows: doc_id, part, text, print; prints: doc_id, keys; both without null ids."""
    classes = write_table(_refined(prints).withColumn("salts", F.ceil(F.col("n") / PER_SALT)))
    few = classes.count() <= MOST_SENT
    left = rows.select("doc_id", "part", "text", F.col("print.mask").alias("mask"), F.element_at("print.keys", -1).alias("class")).join(F.broadcast(classes) if few else classes, "class")
    found: list[DataFrame] = []
    while True:
        first = left.where("doc_id = low").groupBy("class", "salts").agg(F.max("text").alias("said"))
        first = first.select("class", "said", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        met = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts")).join(first, ["class", "salt"]).withColumn("same", F.col("text") == F.col("said"))
        met = met.where(~F.col("same") | (F.col("doc_id") > F.col("low")))
        met = write_table(met.select("class", "doc_id", "part", "mask", "same", F.when(~F.col("same"), F.col("text")).alias("text")))
        found.append(met.where("same").select("doc_id", "part", "mask"))
        rest = met.where("NOT same").drop("same")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        again = rest.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).withColumn("salts", F.ceil(F.col("n") / PER_SALT))
        left = rest.join(again, "class")


def _rows(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask): rows whose text a smaller id has as well, with the mask of their other failures."""
    rows = _rows(docs, doc_id, text, part).where("doc_id IS NOT NULL")
    lean = with_verdict(rows, _prints, ["text"], PRINT, "print", keep=["doc_id"])
    return _marked(with_verdict(rows, _prints, ["text"], PRINT, "print"), write_table(lean.select("doc_id", "print.keys")))


def _counted(rows: DataFrame, marks: DataFrame, weights: dict[int, int]) -> DataFrame:
    """(part, mask, good, toxic, n) of rows (doc_id, part, mask). weights: bits that are added to the mask, and how often each row then counts."""
    known = rows.join(marks, "doc_id", "left")
    counts = known.groupBy("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, (counts.withColumns({"mask": F.col("mask") + bits, "n": F.col("n") * by}) for bits, by in weights.items()))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. See interaction()."""
    rows = _rows(docs, doc_id, text, part)
    marks = labels.groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    lean = with_verdict(rows, _prints, ["text"], PRINT, "print", keep=["doc_id", "part"])
    prints = write_table(lean.select("doc_id", "part", "print.mask", "print.keys"))
    of_ids = with_verdict(rows.where("doc_id IS NOT NULL"), _prints, ["text"], PRINT, "print")
    copies = _marked(of_ids, prints.where("doc_id IS NOT NULL").select("doc_id", "keys"))
    counts = _counted(prints.drop("keys"), marks, {0: 1}).unionByName(_counted(copies, marks, {0: -1, BIT["E"]: 1}))
    return interaction(counts)


def interaction(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, ...) for all orders of the filters, from counts (part, mask of failures, good, toxic, n).

    kept: documents left after the step; removed: taken by it; redundant: fail its filter and were gone before;
    unique_fails: fail its filter alone; good_lost, toxic_lost: removed ones with that label; shapley: what its filter
    removes, summed over all orders.
    """
    mask, n = F.col("mask"), F.col("n")
    passing = lambda among: F.array(*(F.sum(F.when((mask.bitwiseAND(s) == 0) & among, n).otherwise(0)) for s in range(1 << len(FILTERS))))
    of_part = counts.groupBy("part").agg(
        passing(F.lit(True)).alias("passing"),
        passing(F.col("good")).alias("good"),
        passing(F.col("toxic")).alias("toxic"),
        F.array(*(F.sum(F.when(mask == b, n).otherwise(0)) for b in BIT.values())).alias("alone"),
    )
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = of_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda among: reduce(add, (F.when(among(place[f]), b).otherwise(0) for f, b in BIT.items()))
    step = F.col("step")
    steps = steps.withColumns({"before": bits(lambda at: at < step), "bit": bits(lambda at: at == step), "after": bits(lambda at: at <= step)})
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    others = [f for f in FILTERS]
    share = F.lit(0)
    for s in range(1 << len(FILTERS)):  # a set that comes before the filter does so in |s|! (4 - |s|)! orders
        size = bin(s).count("1")
        if size < len(others):
            ways = reduce(lambda x, y: x * y, [*range(1, size + 1), *range(1, len(others) - size)], 1)
            gone = F.get("passing", F.lit(s)) - F.get("passing", F.col("bit").bitwiseOR(s))
            share = share + F.when(F.col("bit").bitwiseAND(s) == 0, gone * ways).otherwise(0)
    failing = F.get("passing", F.lit(0)) - F.get("passing", F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("passing", F.col("after")).alias("kept"),
        lost("passing").alias("removed"),
        (failing - lost("passing")).alias("redundant"),
        F.get("alone", F.log2("bit").cast("int")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        share.cast("long").alias("shapley"),
    )
