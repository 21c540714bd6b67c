"""Signed-rank tests with exact tails, many keys at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronopanel.operators import order_statistics as od

#: Differences up to which a tail is counted out; beyond, it is that of the normal law with the variance of the ranks at hand.
EXACT_MOST = 300


def upper_tail(doubled: Sequence[int], at_least: int) -> float:
    """The share of all signs for which the doubled ranks with a plus come to `at_least` or more.

    One convolution for each rank: the sums without it, and the same ones moved up by it. Shares, not counts, so that nothing overflows.
    """
    shares = np.zeros(int(sum(doubled)) + 1)
    shares[0] = 1.0
    for r in map(int, doubled):
        moved = np.zeros_like(shares)
        moved[r:] = shares[: len(shares) - r]
        shares = (shares + moved) / 2
    return float(shares[int(at_least) :].sum())


@F.pandas_udf(DoubleType())
def _tails(doubled: pd.Series, at_least: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or w is None else upper_tail(d, w) for d, w in zip(doubled, at_least, strict=True)], dtype="object").astype(float)


def _normal_upper(z):
    """1 - the standard normal distribution function, by the rational approximation of its error function (7 places)."""
    t = 1 / (1 + 0.5 * F.abs(z) / F.sqrt(F.lit(2.0)))
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(0.0)
    for c in reversed(terms):
        power = F.lit(c) + t * power
    erfc = t * F.exp(-x * x + power)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def block_means(series: DataFrame, value: str, block: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, block_, value) of consecutive blocks of a series by place (from 0); the last block may be shorter."""
    return series.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col("place") / block).alias("block_")).agg(F.avg(value).alias(value))


def signed_rank_test(rows: DataFrame, value: str, keys: Sequence[str] = (), exact_most: int = EXACT_MOST) -> DataFrame:
    """(keys, n, w_plus, p_greater, is_exact): whether the values lie above 0, by the sum of the ranks of their sizes that are above.

    Zeros are left out; equal sizes share their mean rank, doubled so that it is whole. Up to `exact_most` values all signs are counted.
    """
    keys = list(keys)
    have = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != 0)).select(*keys, F.col(value).alias("value_"), F.abs(value).alias("size_"))
    ranked = od.with_average_rank(have, "size_", "rank_", keys).withColumn("twice_", (2 * F.col("rank_")).cast("long"))
    sizes = have.groupBy(*keys).agg(F.count("*").alias("n_"))
    ranked = ranked.join(F.broadcast(sizes.where(F.col("n_") <= exact_most).withColumn("few_", F.lit(True)).drop("n_")), keys, "left") if keys else ranked.crossJoin(F.broadcast(sizes.select((F.col("n_") <= exact_most).alias("few_"))))
    made = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("value_") > 0, F.col("twice_")).otherwise(0)).alias("twice_w"),
        F.sum("rank_").alias("all_"),
        F.sum(F.col("rank_") ** 2).alias("squares_"),
        F.collect_list(F.when(F.col("few_"), F.col("twice_"))).alias("ranks_"),
    )
    exact = F.size("ranks_") == F.col("n")
    z = F.try_divide(F.col("twice_w") / 2 - F.col("all_") / 2, F.sqrt(F.col("squares_") / 4))
    p = F.when(exact, _tails(F.when(exact, F.col("ranks_")), F.col("twice_w"))).otherwise(_normal_upper(z))
    return made.select(*keys, "n", (F.col("twice_w") / 2).alias("w_plus"), p.alias("p_greater"), exact.alias("is_exact"))
