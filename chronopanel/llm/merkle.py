"""Merkle manifest of a dataset: a digest for each document, each source and the whole, and proofs that a document is in it.

Leaves of a source ascend by id. Every 16 consecutive nodes (the last run may be shorter) become the digest of their
concatenation, until one is left. The roots of the sources, by source, are the leaves of one more tree.

Nodes are dealt to aligned blocks of 16 ** `deep` of them. A block is traversed recursively in postorder: a subtree
returns its digest and, while the recursion unwinds, the siblings of each child are appended to all leaves that the child
contains. The roots of the blocks are the nodes of the next traversal, dealt to blocks in turn, until each source has
one node; the sources' tree is traversed the same way. On the way back each block hands what is above it down to its
leaves; for the documents themselves this is done within the task that has the block, where the proof is hashed and the
root recomputed, so that no proof is ever written or shuffled.

A node's place among its source's is its rank in a range sort, from counts of ranges, so that a source of any size is spread over
all tasks. A task holds one block at a time.

Digests: lower-case hex of sha256 over concatenated inputs, digests as hex text; a column is `-` if null, else its bytes
as UTF-8 counted, a colon, and the value.

Cases: null ids come first; rows of one source and id ascend by leaf, so repeated rows are equal neighbours; a null source is a source of
its own, before all others, and not that of an empty name; empty and null texts differ; the proof of a lone document of a lone source
is the digest of nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.scratch import write_table

#: Nodes that are hashed together, and levels of the tree in a block.
WIDE, DEEP = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands above a node: for each level from below the digests left and right of it, concatenated.
ABOVE = "array<struct<left: string, right: string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def levels_above(n: int) -> int:
    """Levels between n nodes and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDE), levels + 1
    return levels


def traverse(digests: Sequence[str], levels: int, leave=None) -> str:
    """Digest of the subtree of these nodes, `levels` high. leave(i, left, right) is told the siblings of node i's ancestors, from its own upwards."""

    def walk(first: int, last: int, level: int) -> str:
        if not level:
            return digests[first]
        step = WIDE ** (level - 1)
        starts = range(first, last, step)
        children = [walk(a, min(a + step, last), level - 1) for a in starts]
        if leave:
            for k, a in enumerate(starts):
                left, right = "".join(children[:k]), "".join(children[k + 1 :])
                for i in range(a, min(a + step, last)):
                    leave(i, left, right)
        return sha256("".join(children).encode()).hexdigest()

    return walk(0, len(digests), levels)


def _ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes (tree, ...) with rank: the place among its tree's by order, from 0, and n: how many the tree has."""
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())
    dealt = write_table(dealt.repartitionByRange("tree", *order, "tie").withColumn("range", F.spark_partition_id()).drop("tie"))
    counts = dealt.groupBy("tree", "range").agg(F.count("*").alias("here"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    own = dealt.withColumn("place", F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)))
    return own.join(counts, ["tree", "range"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("range", "place", "before")


def _climb(nodes: DataFrame, most: int, deep: int) -> tuple[DataFrame, DataFrame]:
    """The tree's root for each tree, and (tree, block, above) of the first blocks. nodes: tree, rank, n, digest; most: nodes of the largest tree."""
    size = WIDE**deep
    levels: list[DataFrame] = []
    now = nodes.select("tree", "rank", "n", "digest")
    while True:
        up = write_table(_blocks(now, deep))
        levels.append(up)
        if most <= size:
            break
        most = -(-most // size)
        now = up.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), F.col("digest"))
    roots = levels[-1].select("tree", "digest")
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(ABOVE).alias("above"))
    for up in reversed(levels[:-1]):
        nodes_of = up.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), "digest")
        above = write_table(_handed_down(nodes_of, above, deep))
    return roots, above


def _deals(nodes: DataFrame, deep: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / WIDE**deep))


def _blocks(nodes: DataFrame, deep: int) -> DataFrame:
    """(tree, block, n, digest): the root of each block of nodes (tree, rank, n, digest)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        n = int(block["n"].iloc[0])
        digest = traverse(block["digest"].tolist(), min(deep, levels_above(n)))
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "block": block["block"].iloc[:1], "n": [n], "digest": [digest]})

    return _deals(nodes, deep).groupBy("tree", "block").applyInPandas(run, "tree string, block long, n long, digest string")


def _handed_down(nodes: DataFrame, above: DataFrame, deep: int) -> DataFrame:
    """(tree, block, above) for nodes (tree, rank, n, digest), each the root of the block of its rank, from what stands above their own blocks."""

    def run(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        own: list[list[dict]] = [[] for _ in range(len(block))]
        traverse(block["digest"].tolist(), min(deep, levels_above(int(block["n"].iloc[0]))), lambda i, left, right: own[i].append({"left": left, "right": right}))
        rest = list(over["above"].iloc[0])
        return pd.DataFrame({"tree": block["tree"], "block": block["rank"], "above": [x + rest for x in own]})

    return _deals(nodes, deep).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, f"tree string, block long, above {ABOVE}")


def manifest(docs: DataFrame, deep: int = DEEP, tampered: Column | None = None, text: str = "text") -> DataFrame:
    """For each document: doc_id, leaf, subroot of its source, root, proof_sha256, folded_root, verified.

    folded_root is the root recomputed from the leaf and its proof. tampered: where given and not null, the text that is
    found in place of the one in the manifest, from which the leaf is made again before it is folded.
    """
    found = F.lit(None).cast("string") if tampered is None else tampered
    columns = [docs[f"`{c}`"] for c in COLUMNS]
    again = [F.coalesce(found, docs[f"`{text}`"]) if c == text else docs[f"`{c}`"] for c in COLUMNS]
    source = F.coalesce(F.concat(F.lit("s"), docs["`source`"].cast("string")), F.lit(""))
    leaves = docs.select(docs["`doc_id`"].alias("doc_id"), source.alias("tree"), leaf_digest(columns).alias("digest"), F.when(found.isNotNull(), leaf_digest(again)).alias("changed"))
    leaves = write_table(_ranked(leaves, ["doc_id", "digest"]))
    most = leaves.agg(F.max("n")).first()[0] or 0
    subroots, above = _climb(leaves, most, deep)
    sources = write_table(_ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"]))
    n_sources = sources.count()
    root, over = _climb(sources.select("tree", "rank", "n", "digest"), n_sources, deep)
    return _proven(leaves, above, _of_sources(sources, over, deep), root, deep)


def _of_sources(sources: DataFrame, over: DataFrame, deep: int) -> DataFrame:
    """(tree, subroot, upper): what stands above each source's root."""
    ranks = _handed_down(sources.select("tree", "rank", "n", "digest"), over, deep).select("tree", F.col("block").alias("rank"), F.col("above").alias("upper"))
    return sources.join(ranks, ["tree", "rank"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "upper")


def _proven(leaves: DataFrame, above: DataFrame, upper: DataFrame, root: DataFrame, deep: int) -> DataFrame:
    top = root.first()
    whole = above.join(upper, "tree").select("tree", "block", "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), F.concat("above", "upper").alias("above"))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    kind = dict(leaves.dtypes)["doc_id"]

    def run(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        leaf, rest = block["digest"].tolist(), [(x["left"], x["right"]) for x in over["above"].iloc[0]]
        folded = [c or d for c, d in zip(block["changed"].tolist(), leaf, strict=True)]
        proofs = [sha256() for _ in leaf]

        def leave(i: int, left: str, right: str) -> None:
            proofs[i].update((left + right).encode())
            folded[i] = sha256((left + folded[i] + right).encode()).hexdigest()

        traverse(leaf, min(deep, levels_above(int(block["n"].iloc[0]))), leave)
        for left, right in rest:
            for i in range(len(leaf)):
                leave(i, left, right)
        made = (block["doc_id"], leaf, over["subroot"].iloc[0], over["root"].iloc[0], [p.hexdigest() for p in proofs], folded, [f == over["root"].iloc[0] for f in folded])
        return pd.DataFrame(dict(zip(names, made, strict=True)))

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _deals(leaves, deep).groupBy("tree", "block").cogroup(whole.groupBy("tree", "block")).applyInPandas(run, schema)
