"""Logistic regressions of many keys at once, plain or on a spline basis, and what is made of them fold by fold.

A step is one grouped aggregation for all keys: gradient, curvature and likelihood of each key at its own coefficients,
summed before they are shuffled. What is solved is one small system for each key. A step that makes the penalised likelihood worse is
halved; a key whose gradient is nothing keeps its coefficients, and steps end when all keys are done. The coefficients of
each step are written to the shared folder, so that a plan doesn't grow with the steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import order_statistics as od
from chronopanel.sources import store


def linear(names: Sequence[str], beta: Column) -> Column:
    """Intercept and columns by their coefficients."""
    return reduce(add, (beta[i + 1] * F.col(c) for i, c in enumerate(names)), beta[0])


def probability(score: Column) -> Column:
    """1 / (1 + exp(-score)), without overflow."""
    return F.when(score >= 0, 1 / (1 + F.exp(-score))).otherwise(F.exp(score) / (1 + F.exp(score)))


def _stepped(k: int, penalty: float, tolerance: float):
    shrink = penalty * np.diag([0.0] + [1.0] * k)
    upper = np.triu_indices(k + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            for r in rows:
                beta = np.array(r["beta"], float)
                value = r["likelihood"] - 0.5 * penalty * float(beta[1:] @ beta[1:])
                if np.isfinite(value) and value >= r["value"] - 1e-12 * abs(value):
                    full = np.zeros((k + 1, k + 1))
                    full[upper] = r["curvature"]
                    full = full + np.triu(full, 1).T + shrink
                    gradient = np.array(r["gradient"], float) - shrink @ beta
                    r["value"], r["good"] = value, beta
                    if np.abs(gradient).max() <= tolerance * max(1, r["n"]):
                        r["status"], step = "converged", np.zeros(k + 1)
                    elif np.linalg.cond(full) > 1e14:
                        r["status"], step = "singular", np.zeros(k + 1)
                    else:
                        step = np.linalg.solve(full, gradient)
                else:
                    step = np.array(r["step"], float) / 2
                r["step"], r["beta"] = step, np.array(r["good"], float) + step
            yield pd.DataFrame(rows, columns=batch.columns).drop(columns=["likelihood", "gradient", "curvature"])

    return run


def logistic_fits(rows: DataFrame, keys: Sequence[str], names: Sequence[str], outcome: str, penalty: float = 0.0, rounds: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """(keys, n, n_positive, beta, status) of a logistic regression for each key; beta: intercept, then a coefficient for each name.

    penalty: on half the squared coefficients, the intercept excepted. status: converged; one_class where all outcomes
    are one (and nothing is penalised into place: no beta then); singular; not_converged after `rounds` steps, as for
    separable outcomes without a penalty. Rows with a null among columns or outcome are left out.
    """
    keys, names = list(keys), list(names)
    have = rows.where(reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in (*names, outcome)))).select(*keys, *(F.col(c).cast("double").alias(c) for c in names), F.col(outcome).cast("double").alias("y_"))
    k = len(names)
    zeros = F.array(*[F.lit(0.0)] * (k + 1))
    start = have.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y_").cast("long").alias("n_positive"))
    one = F.col("n_positive").isin(0) | (F.col("n_positive") == F.col("n"))
    state = store.materialized(start.select(*keys, "n", "n_positive", zeros.alias("beta"), zeros.alias("good"), zeros.alias("step"), F.lit(-1e308).alias("value"), F.when(one, "one_class").alias("status")))
    for _ in range(rounds):
        going = state.where("status IS NULL")
        if going.isEmpty():
            break
        met = have.join(going.select(*keys, "beta"), keys)
        score = linear(names, F.col("beta"))
        met = met.withColumn("s_", score).withColumn("p_", probability(F.col("s_")))
        x = [F.lit(1.0), *(F.col(c) for c in names)]
        w = F.col("p_") * (1 - F.col("p_"))
        log_of = F.greatest(F.col("s_"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("s_")))
        sums = met.groupBy(*keys).agg(
            F.sum(F.col("y_") * F.col("s_") - log_of).alias("likelihood"),
            F.array(*(F.sum((F.col("y_") - F.col("p_")) * a) for a in x)).alias("gradient"),
            F.array(*(F.sum(w * a * b) for i, a in enumerate(x) for b in x[i:])).alias("curvature"),
        )
        schema = state.schema
        stepped = going.join(sums, keys).select(*state.columns, "likelihood", "gradient", "curvature").mapInPandas(_stepped(k, penalty, tolerance), schema)
        state = store.materialized(stepped.unionByName(state.where("status IS NOT NULL")))
    return state.select(*keys, "n", "n_positive", F.when(F.col("status").isNull() | (F.col("status") != "one_class"), F.col("good")).alias("beta"), F.coalesce("status", F.lit("not_converged")).alias("status"))


def expanding(rows: DataFrame, folds: DataFrame, fold: str = "fold") -> DataFrame:
    """rows of each fold's past: those whose own fold (column own_fold) is before it. folds: a stated set."""
    return rows.join(F.broadcast(folds.select(fold).distinct()), F.col("own_fold") < F.col(fold))


def prequential_calibration(rows: DataFrame, score: str, outcome: str, fold: str = "fold") -> DataFrame:
    """rows with p: their score calibrated by a logistic fit on all earlier folds; null in the first fold and where the past has one class or no positive slope."""
    past = rows.select(F.col(fold).alias("own_fold"), score, outcome)
    fits = logistic_fits(expanding(past, rows.select(fold), fold), [fold], [score], outcome)
    good = fits.where((F.col("status") == "converged") & (F.col("beta")[1] > 0)).select(fold, "beta")
    return rows.join(F.broadcast(good), fold, "left").select(*rows.columns, probability(linear([score], F.col("beta"))).alias("p"))


def calibration_diagnostic(rows: DataFrame, p: str, outcome: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, intercept, slope, status) of outcomes on the logit of their probabilities, cut at 1e-8: 0 and 1 if they are right."""
    cut = F.greatest(F.least(F.col(p), F.lit(1 - 1e-8)), F.lit(1e-8))
    fits = logistic_fits(rows.withColumn("logit_", F.log(cut / (1 - cut))), keys, ["logit_"], outcome)
    return fits.select(*keys, "n", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope"), "status")


def train_transform(train: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, {name}_low, _mid, _high, _mean, _dev): cuts at 0.01 and 0.99, the median that fills gaps, and mean and deviation of what comes of it; all keys in the same jobs."""
    cuts = od.quantiles(train, names, {"low": 0.01, "high": 0.99}, keys)
    cut = train.select(*keys, *names).join(F.broadcast(cuts), list(keys))
    clipped = cut.select(*keys, *(F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), f"{c}_high"), f"{c}_low")).alias(c) for c in names))
    middle = od.quantiles(clipped, names, {"mid": 0.5}, keys)
    filled = clipped.join(F.broadcast(middle), list(keys)).select(*keys, *(F.coalesce(c, f"{c}_mid").alias(c) for c in names))
    spread = filled.groupBy(*keys).agg(*(f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("dev", F.stddev_samp))))
    return cuts.join(middle, list(keys)).join(spread, list(keys))


def transformed(rows: DataFrame, limits: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """rows with each column cut, filled and scaled as its key's training rows say; null where they have no spread."""
    cut = lambda c: F.when(F.col(c).isNull(), F.col(f"{c}_mid")).otherwise(F.greatest(F.least(F.col(c), f"{c}_high"), f"{c}_low"))
    z = lambda c: F.try_divide(cut(c) - F.col(f"{c}_mean"), F.nullif(F.col(f"{c}_dev"), F.lit(0.0)))
    met = rows.join(F.broadcast(limits), list(keys))
    return met.select(*(c for c in rows.columns if c not in names), *(z(c).alias(c) for c in names))


def spline_knots(train: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, {name}_t0, _t1, _t2): least, middle and largest value of each column in the key's training rows."""
    return od.quantiles(train, names, {"t0": 0.0, "t1": 0.5, "t2": 1.0}, keys)


def spline_columns(name: str) -> dict[str, Column]:
    """The quadratic B-splines of a column on its knots {name}_t0, _t1, _t2, the first one left out (they sum to 1).

    Knots go on outside by the distance of the outer two. Beyond the outer knots a spline goes on as the straight line that touches it there.
    """
    t0, t1, t2 = (F.col(f"{name}_t{i}") for i in range(3))
    a, b = t1 - t0, t2 - t1
    knots = [t0 - 2 * a, t0 - a, t0, t1, t2, t2 + b, t2 + 2 * b]
    x = F.greatest(F.least(F.col(name), t2), t0)
    level = [F.when((x >= knots[i]) & ((x < knots[i + 1]) | ((x <= knots[i + 1]) & F.lit(i == 3))), 1.0).otherwise(0.0) if i in (2, 3) else F.lit(0.0) for i in range(6)]
    ratio = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    for d in (1, 2):
        lower = level
        level = [ratio(x - knots[i], knots[i + d] - knots[i]) * lower[i] + ratio(knots[i + d + 1] - x, knots[i + d + 1] - knots[i + 1]) * lower[i + 1] for i in range(6 - d)]
    slope = [2 * (ratio(lower[i], knots[i + 2] - knots[i]) - ratio(lower[i + 1], knots[i + 3] - knots[i + 1])) for i in range(4)]
    return {f"{name}_s{i}": level[i] + slope[i] * (F.col(name) - x) for i in range(1, 4)}


def with_splines(rows: DataFrame, knots: DataFrame, names: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """rows with the spline columns of names on their key's knots, and the names of those columns."""
    made = {c: e for n in names for c, e in spline_columns(n).items()}
    return rows.join(F.broadcast(knots), list(keys)).select(*rows.columns, *(e.alias(c) for c, e in made.items())), list(made)


def walk_forward_logistic(rows: DataFrame, names: Sequence[str], outcome: str, penalty: float, splines: bool = False, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Predictions (rows' columns, raw, p, base_rate, above_base) of each fold by a fit on all earlier ones, and the fits. Transforms and knots come from the past alone.

    rows: fold, the columns, the outcome (null where it isn't known yet: such rows are predicted and train nothing).
    """
    past = expanding(rows.where(F.col(outcome).isNotNull()).select(F.col(fold).alias("own_fold"), *names, outcome), rows.select(fold), fold)
    limits = store.materialized(train_transform(past, names, [fold]))
    train, now, used = transformed(past, limits, names, [fold]), transformed(rows, limits, names, [fold]), list(names)
    if splines:
        knots = store.materialized(spline_knots(train, names, [fold]))
        (train, used), (now, _) = with_splines(train, knots, names, [fold]), with_splines(now, knots, names, [fold])
    fits = logistic_fits(train, [fold], used, outcome, penalty)
    known = fits.select(fold, "beta", (F.col("n_positive") / F.col("n")).alias("base_rate"))
    scored = now.join(F.broadcast(known), fold).withColumn("raw", linear(used, F.col("beta")))
    p = probability(F.col("raw"))
    return scored.select(*rows.columns, "raw", p.alias("p"), "base_rate", (p > F.col("base_rate")).alias("above_base")), fits


def fold_ledger(predictions: DataFrame, outcome: str, fold: str = "fold") -> DataFrame:
    """(fold, n, base_rate, alert_rate, brier, baseline_brier, improvement, auc) of the predictions whose outcome is known."""
    y = F.col(outcome).cast("double")
    known = predictions.where(F.col(outcome).isNotNull())
    brier, baseline = F.avg((F.col("p") - y) ** 2), F.avg((F.col("base_rate") - y) ** 2)
    made = known.groupBy(fold).agg(F.count("*").alias("n"), F.first("base_rate").alias("base_rate"), F.avg(F.col("above_base").cast("double")).alias("alert_rate"), brier.alias("brier"), baseline.alias("baseline_brier"), (baseline - brier).alias("improvement"))
    return made.join(od.area_under_curve(known, "p", outcome, [fold]).select(fold, "auc"), fold)
