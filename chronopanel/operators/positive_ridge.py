"""Ridge regressions with coefficients that may not be negative, for many keys, from their moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_moments(rows: DataFrame, keys: Sequence[str], names: Sequence[str], target: str) -> DataFrame:
    """(keys, n, moments): sums of products of 1, the columns and the target; rows with a null among them are left out."""
    all_ = [F.lit(1.0), *(F.col(c).cast("double") for c in (*names, target))]
    have = rows.where(reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in (*names, target))))
    return have.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(a * b) for i, a in enumerate(all_) for b in all_[i:])).alias("moments"))


def least_squares_above_zero(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The b >= 0 for which b'ab / 2 - c'b is least, a being positive definite: by an active set.

    The column with the steepest gain enters; where the solution on the entered ones would go below zero, the way to it ends at the
    first that reaches zero, which leaves.
    """
    k = len(c)
    b, entered = np.zeros(k), np.zeros(k, bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(c).max(initial=0)))
    while True:
        gain = np.where(entered, -np.inf, c - a @ b)
        if entered.all() or gain.max() <= tolerance:
            return b
        entered[int(gain.argmax())] = True
        while True:
            s = np.zeros(k)
            s[entered] = np.linalg.solve(a[np.ix_(entered, entered)], c[entered])
            below = entered & (s <= 0)
            if not below.any():
                b = s
                break
            step = np.min(b[below] / (b[below] - s[below]))
            b = b + step * (s - b)
            entered &= b > 1e-14
            b[~entered] = 0.0


def positive_ridge(moments: DataFrame, keys: Sequence[str], names: Sequence[str], penalty: float) -> DataFrame:
    """(keys, n, beta): intercept (free, not penalised), then a coefficient of at least 0 for each name."""
    k, keys = len(names), list(keys)
    upper = np.triu_indices(k + 2)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas = []
            for m in batch["moments"]:
                full = np.zeros((k + 2, k + 2))
                full[upper] = m
                full = full + np.triu(full, 1).T
                means = full[0, 1:] / full[0, 0]
                centred = full[1:, 1:] - np.outer(means, means) * full[0, 0]
                b = least_squares_above_zero(centred[:k, :k] + penalty * np.eye(k), centred[:k, k])
                betas.append([float(means[k] - means[:k] @ b), *b.tolist()])
            yield batch[[*keys, "n"]].assign(beta=betas)

    kinds = dict(moments.dtypes)
    return moments.mapInPandas(solve, ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "n")), "beta array<double>"]))
