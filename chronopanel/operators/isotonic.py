"""Isotonic regression of any number of rows.

Equal x are averaged first. The points are range-sorted by x and numbered; neighbours are dealt to groups of a bounded
number, each group pools its adjacent violators, and what comes out (blocks with their weight and sum) are the points of the next
round, in groups that overlap the borders of the last one. A group's pools are those of the whole wherever they don't touch
its border, and pooling more never undoes one, so the rounds end at the one solution: when no block lies above the next. No
task has a whole series; a series that is one long violation shrinks by the size of a group in each round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import order_statistics as od
from chronopanel.operators import point_in_time as pit
from chronopanel.sources import store

#: Blocks that are pooled in one task at a time.
GROUP = 100_000
#: Ranges of x by which rows and blocks are dealt when rows look up their block.
RANGES = 1024


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (low, high, weight, mass) in order of x, adjacent ones pooled until their means ascend."""
    out: list[list[float]] = []
    for a, b, w, s in zip(low.tolist(), high.tolist(), weight.tolist(), mass.tolist(), strict=True):
        while out and out[-1][3] * w >= s * out[-1][2]:
            a, w, s = out[-1][0], w + out[-1][2], s + out[-1][3]
            out.pop()
        out.append([a, b, w, s])
    return tuple(np.array(out).T) if out else (low, high, weight, mass)


def isotonic_blocks(rows: DataFrame, x: str, y: str, keys: Sequence[str] = (), weight: str | None = None, group: int = GROUP) -> DataFrame:
    """(keys, low, high, weight, value): the blocks of the non-decreasing step function of x that is nearest to y by weighted squares, ascending. Rows with a null x or y are left out."""
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, (F.col(x).cast("double") + F.lit(0.0)).alias("low"), w.alias("weight"), (w * F.col(y)).alias("mass"))
    points = have.groupBy(*keys, "low").agg(F.sum("weight").alias("weight"), F.sum("mass").alias("mass")).where("weight > 0")
    blocks = points.select(*keys, "low", F.col("low").alias("high"), "weight", "mass")
    schema = ", ".join([*(f"{k} {dict(rows.dtypes)[k]}" for k in keys), "low double, high double, weight double, mass double"])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("low")
        made = pooled(*(block[c].to_numpy() for c in ("low", "high", "weight", "mass")))
        out = pd.DataFrame(dict(zip(("low", "high", "weight", "mass"), made, strict=True)))
        for k in reversed(keys):
            out.insert(0, k, block[k].iloc[0])
        return out

    shift, quiet = 0, 0
    while True:
        placed = store.materialized(od.with_place(blocks, ["low"], keys).withColumn("group_", F.floor((F.col("place") + shift) / group)))
        blocks = store.materialized(placed.groupBy(*keys, "group_").applyInPandas(run, schema))
        quiet = quiet + 1 if placed.count() == blocks.count() else 0
        if quiet == 2 or placed.where("group_ > 0").isEmpty():
            break
        shift = group // 2 - shift
    return blocks.select(*keys, "low", "high", "weight", (F.col("mass") / F.col("weight")).alias("value"))


def isotonic_values(rows: DataFrame, blocks: DataFrame, x: str, keys: Sequence[str] = (), name: str = "fitted") -> DataFrame:
    """rows with the step function at x: a block's value within it, a straight line between two blocks, the outer values beyond them; null without x.

    Each row meets the last block that begins at or below it, both sides dealt by key and a range of x.
    """
    keys = list(keys)
    after = Window.partitionBy(*keys).orderBy("low")
    steps = blocks.select(*keys, F.col("low").alias(x), "high", "value", F.lead("low").over(after).alias("next_low"), F.lead("value").over(after).alias("next_value"))
    ends = blocks.agg(F.min("low").alias("a"), F.max("high").alias("b")).first()
    low, wide = (ends["a"] or 0.0), max((ends["b"] or 0.0) - (ends["a"] or 0.0), 1e-300) / RANGES
    bucket = F.least(F.greatest(F.floor((F.col(x) - low) / wide), F.lit(-1)), F.lit(RANGES))
    met = pit.asof_backward(rows, steps, keys, x, ["high", "value", "next_low", "next_value"], bucket)
    first = blocks.groupBy(*keys).agg(F.min_by("value", "low").alias("first_value"))
    met = met.join(F.broadcast(first), keys, "left") if keys else met.crossJoin(F.broadcast(first))
    at = F.col(x)
    between = F.col("value") + (F.col("next_value") - F.col("value")) * F.try_divide(at - F.col("high"), F.col("next_low") - F.col("high"))
    fitted = F.when(F.col("value").isNull(), F.col("first_value")).when((at <= F.col("high")) | F.col("next_low").isNull(), F.col("value")).otherwise(between)
    return met.select(*rows.columns, F.when(at.isNotNull(), fitted).alias(name))
