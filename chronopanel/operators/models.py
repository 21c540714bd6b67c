"""Linear models over panels: moments are summed by Spark, small systems solved on what is left."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import order_statistics as od


def train_limits(rows: DataFrame, names: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: low, high, median, mean and deviation of each column after cutting at low and high, all from training rows."""
    cuts = od.quantiles(rows.where("is_train"), names, {"low": low, "mid": 0.5, "high": high})
    filled = rows.where("is_train").crossJoin(F.broadcast(cuts)).select(*(F.greatest(F.least(F.coalesce(n, f"{n}_mid"), f"{n}_high"), f"{n}_low").alias(n) for n in names))
    spread = filled.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("dev", F.stddev_samp))))
    return cuts.crossJoin(spread)


def standardized(rows: DataFrame, names: Sequence[str], limits: DataFrame) -> DataFrame:
    """rows with each column cut at the limits, filled with the median and put on mean 0 and deviation 1 of training."""
    z = lambda n: F.try_divide(F.greatest(F.least(F.coalesce(n, f"{n}_mid"), f"{n}_high"), f"{n}_low") - F.col(f"{n}_mean"), F.col(f"{n}_dev"))
    return rows.crossJoin(F.broadcast(limits)).select(*(c for c in rows.columns if c not in names), *(z(n).alias(n) for n in names))


def ridge_moments(rows: DataFrame, names: Sequence[str], target: str, weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: weighted sums of products of 1, the columns and the target; all that a ridge fit needs, however many rows there are."""
    w = F.lit(1.0) if weight is None else weight
    all_ = ["one", *names, target]
    full = rows.withColumn("one", F.lit(1.0))
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(all_) for b in all_[i:]]
    return full.groupBy(*keys).agg(*sums)


def solve_ridge(row: dict, names: Sequence[str], target: str, penalty: float) -> list[float]:
    """Intercept (not penalised) and coefficients from one row of ridge_moments()."""
    all_ = ["one", *names]
    get = lambda a, b: row[f"{a}*{b}"] if f"{a}*{b}" in row else row[f"{b}*{a}"]
    a = np.array([[get(x, y) for y in all_] for x in all_], float) + penalty * np.diag([0.0] + [1.0] * len(names))
    return np.linalg.solve(a, np.array([get(x, target) for x in all_], float)).tolist()


def ridge_one(rows: DataFrame, x: str, y: str, penalty: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, intercept, slope) of a ridge on one column, the intercept not penalised; all in sums."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    sxx, sxy = F.sum(F.col(x) ** 2) - sx * sx / n, F.sum(F.col(x) * F.col(y)) - sx * sy / n
    slope = sxy / (sxx + penalty)
    return rows.groupBy(*keys).agg(n.alias("n"), ((sy - slope * sx) / n).alias("intercept"), slope.alias("slope"))


def walk_forward_ridge(rows: DataFrame, refits: DataFrame, x: str, y: str, penalty: float) -> DataFrame:
    """(refit, n, intercept, slope) of a ridge per refit date on the rows whose labels are mature by then (label_end <= refit).

    Sums are taken by date first and then run up, so that no row is read again for a later refit.
    """
    daily = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("label_end").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) ** 2).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    known = daily.join(F.broadcast(refits), F.col("label_end") <= F.col("refit")).groupBy("refit").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") ** 2 / F.col("n") + penalty)
    return known.withColumn("slope", slope).select("refit", "n", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "slope")


def equal_mean_rank(long: DataFrame, keys: Sequence[str] = ("date",), least: int = 2) -> DataFrame:
    """(keys, sid, prediction, n): mean of the centred ranks of a name's factors. long: keys, sid, factor_id, score."""
    ranked = long.withColumn("rank", C.centered_rank(F.col("score"), [*keys, "factor_id"]))
    return ranked.where("rank IS NOT NULL").groupBy(*keys, "sid").agg(F.avg("rank").alias("prediction"), F.count("*").alias("n")).where(F.col("n") >= least)


def mature_dates(labels: DataFrame, cutoff: Column, n: int) -> DataFrame:
    """Labels known by the cutoff, of the last n dates."""
    place = F.dense_rank().over(Window.orderBy(F.col("date").desc()))
    dates = labels.where(F.col("label_end") <= cutoff).select("date").distinct().withColumn("place", place).where(F.col("place") <= n).drop("place")
    return labels.where(F.col("label_end") <= cutoff).join(F.broadcast(dates), "date")


def logistic(rows: DataFrame, x: str, y: str, rounds: int = 8) -> DataFrame:
    """(intercept, slope, n) of a logistic regression on one column by Newton steps; each step is one pass of sums."""
    spark = rows.sparkSession
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a, b, n = 0.0, 0.0, 0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = p * (1 - p)
        r = have.agg(F.sum(F.col("y") - p), F.sum((F.col("y") - p) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") ** 2), F.count("*")).first()
        if not r[5] or r[2] * r[4] - r[3] ** 2 <= 1e-12:
            break
        det = r[2] * r[4] - r[3] ** 2
        a, b, n = a + (r[4] * r[0] - r[3] * r[1]) / det, b + (r[2] * r[1] - r[3] * r[0]) / det, r[5]
    return spark.createDataFrame([(a, b, n)], "intercept double, slope double, n long")


def effective_sizes(rows: DataFrame, weight: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, n_dates, n_effective): rows, distinct dates and (sum of weights)^2 / sum of squares."""
    w = F.col(weight)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("date").alias("n_dates"), F.try_divide(F.sum(w) ** 2, F.sum(w * w)).alias("n_effective"))
