"""Nested walk-forward selection of ridge models on many columns.

A panel is read once for its moments: for each date one matrix of products, the date's rows weighing one together. All
fits are then differences of two running sums of these matrices (of a refit: the last dates whose labels are known by
then; of an inner fold: all dates before the block it is validated on), so that no row is read again for another fit, and what goes to the
solver is one small matrix for each fit. Running sums are taken for each matrix entry by itself, so no task has them all.

Inner folds don't depend on the year that they select for: a later year only has more of them. They are therefore
fitted and validated once. Of a year's recipes the one with the least capacity is taken that isn't worse than the best by more
than a standard error, that of moving blocks in closed form (what their bootstrap tends to).

Dates, years, refits, folds and recipes are stated sets; the rows of the panel are not, and stay distributed. Dates are
ordered by when their labels are known. Rows with a null among columns or target are in no fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.sources import store


class Recipe(NamedTuple):
    """A ridge: its penalty, its capacity (less is preferred), and its columns, None for all."""

    name: str
    penalty: float
    capacity: int
    columns: tuple[str, ...] | None = None


def coverage_gate(rows: DataFrame, factors: Sequence[str], least: float = 0.95) -> DataFrame:
    """(factor_id, minimum_coverage, passed): the least share of a date's names that have the factor. rows: date, sid and the factors."""
    daily = rows.groupBy("date").agg(*(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in factors))
    lowest = daily.agg(*(F.min(f).alias(f) for f in factors))
    return lowest.unpivot([], list(factors), "factor_id", "minimum_coverage").withColumn("passed", F.col("minimum_coverage") >= least)


def complete_rows(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """The rows that have all factors as finite numbers."""
    return rows.where(reduce(lambda p, q: p & q, (C.finite(F.col(f).cast("double")).isNotNull() for f in factors)))


def complete_coverage(rows: DataFrame, factors: Sequence[str], least_names: int, least: float = 0.95) -> DataFrame:
    """(date, base_names, complete_names, coverage, passed) of complete_rows() against all rows."""
    whole = reduce(lambda p, q: p & q, (C.finite(F.col(f).cast("double")).isNotNull() for f in factors))
    made = rows.groupBy("date").agg(F.count("*").alias("base_names"), F.sum(whole.cast("long")).alias("complete_names"))
    coverage = F.col("complete_names") / F.col("base_names")
    return made.withColumn("coverage", coverage).withColumn("passed", (F.col("complete_names") >= least_names) & (F.col("coverage") >= least))


def ranked_panel(rows: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """Complete rows with factors and target as centred ranks of their date: ranks are those of the universe that is left."""
    left = complete_rows(rows, factors)
    return left.withColumns({c: C.centered_rank(F.col(c), ["date"]) for c in (*factors, target)})


def date_moments(rows: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """(date, known, place, n, moments): mean products of 1, the columns and the target in each date; place from 1 by when labels are known. rows: date, label_end."""
    all_ = [F.lit(1.0), *(F.col(c).cast("double") for c in (*names, target))]
    have = rows.where(reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in (*names, target, "label_end"))))
    products = F.array(*(F.avg(a * b) for i, a in enumerate(all_) for b in all_[i:]))
    daily = have.groupBy("date").agg(F.max("label_end").alias("known"), F.count("*").alias("n"), products.alias("moments"))
    return store.materialized(daily.withColumn("place", F.row_number().over(Window.orderBy("known", "date"))))


def running_moments(daily: DataFrame) -> DataFrame:
    """(place, moments): sums over all dates up to a place; one row of zeros at place 0."""
    zero = daily.groupBy().agg(F.max(F.size("moments")).alias("k")).where("k > 0").select(F.lit(0).alias("place"), F.expr("transform(sequence(1, k), i -> 0D)").alias("moments"))
    entries = daily.select("place", "moments").unionByName(zero).select("place", F.posexplode("moments").alias("entry", "x"))
    total = F.sum("x").over(Window.partitionBy("entry").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    pairs = entries.select("place", F.struct("entry", total.alias("x")).alias("e"))
    return store.materialized(pairs.groupBy("place").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]).alias("moments")))


def ridge_solutions(moments: np.ndarray, k: int, penalty: float, kept: Sequence[int]) -> np.ndarray:
    """Intercept and k coefficients (0 where a column isn't kept) of each row of moments; the intercept isn't penalised."""
    full = np.zeros((len(moments), k + 2, k + 2))
    i, j = np.triu_indices(k + 2)
    full[:, i, j] = moments
    full[:, j, i] = moments
    total = full[:, 0, 0][:, None]
    means = full[:, 0, 1:] / total
    centred = full[:, 1:, 1:] - means[:, :, None] * means[:, None, :] * total[:, :, None]
    kept = list(kept)
    a = centred[:, kept][:, :, kept] + penalty * np.eye(len(kept))
    out = np.zeros((len(moments), k + 1))
    out[:, [c + 1 for c in kept]] = np.linalg.solve(a, centred[:, kept, k][:, :, None])[:, :, 0]
    out[:, 0] = means[:, k] - (means[:, :k] * out[:, 1:]).sum(1)
    return out


def fitted(running: DataFrame, spans: DataFrame, names: Sequence[str], recipes: Sequence[Recipe]) -> DataFrame:
    """(fit, n_dates, recipe, beta) of every recipe on the dates at places first to last. spans: fit, first, last; beta: intercept, then a coefficient for each name."""
    upto = lambda c, name: running.select(F.col("place").alias(c), F.col("moments").alias(name))
    at = spans.withColumn("before", F.col("first") - 1).join(upto("last", "b"), "last").join(upto("before", "a"), "before")
    sums = at.select("fit", (F.col("last") - F.col("before")).cast("int").alias("n_dates"), F.zip_with("b", "a", lambda b, a: b - a).alias("moments"))
    names, kind = list(names), dict(spans.dtypes)["fit"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            moments = np.stack(batch["moments"].to_numpy())
            for r in recipes:
                kept = [names.index(c) for c in (r.columns or names)]
                yield pd.DataFrame({"fit": batch["fit"], "n_dates": batch["n_dates"], "recipe": r.name, "beta": list(ridge_solutions(moments, len(names), r.penalty, kept))})

    return store.materialized(sums.mapInPandas(solve, f"fit {kind}, n_dates int, recipe string, beta array<double>"))


def predicted(names: Sequence[str], beta: Column) -> Column:
    """The ridge's value, to ten places, so that equal rows tie whatever the order of sums."""
    return F.round(beta[0] + reduce(add, (beta[i + 1] * F.col(c) for i, c in enumerate(names))), 10)


def fold_spans(daily: DataFrame, least: int, block: int) -> DataFrame:
    """(fit, first, last): inner fold f trains on all dates before its block of validation dates."""
    n = daily.agg(F.floor((F.count("*") - least) / block).cast("int").alias("folds")).where("folds > 0")
    return n.select(F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fit")).select("fit", F.lit(1).alias("first"), (F.lit(least) + F.col("fit") * block).cast("int").alias("last"))


def validation_ic(rows: DataFrame, daily: DataFrame, fits: DataFrame, names: Sequence[str], target: str, least: int, block: int) -> DataFrame:
    """(recipe, fold, place, ic): rank correlation of prediction and target on each date of each fold's block."""
    fold = F.floor((F.col("place") - 1 - least) / block).cast("int")
    places = daily.where(F.col("place") > least).select("date", "place", fold.alias("fold"))
    folds = places.join(fits.select(F.col("fit").alias("fold"), "recipe", "beta"), "fold")
    have = rows.where(F.col(target).isNotNull()).join(F.broadcast(folds), "date").select("recipe", "fold", "place", predicted(names, F.col("beta")).alias("p"), F.col(target).alias("y")).where("p IS NOT NULL")
    ranked = have.select("recipe", "fold", "place", *(C.average_rank(F.col(c), ["recipe", "place"]).alias(c) for c in ("p", "y")))
    return store.materialized(ranked.groupBy("recipe", "fold", "place").agg(C.finite(F.corr("p", "y")).alias("ic")).where("ic IS NOT NULL"))


def legal_counts(daily: DataFrame, cutoffs: DataFrame, key: str, cutoff: str) -> DataFrame:
    """cutoffs with legal: how many dates have labels that are known by then."""
    return cutoffs.join(F.broadcast(daily.select("known")), F.col("known") <= F.col(cutoff)).groupBy(key, cutoff).agg(F.count("*").cast("int").alias("legal"))


def select_recipes(ic: DataFrame, daily: DataFrame, years: DataFrame, recipes: Sequence[Recipe], least: int, block: int, least_blocks: int, error_block: int) -> DataFrame:
    """(year, recipe, mean_ic, one_se_members, n_blocks): for each year (year, cutoff) the recipe that its legal folds choose. Years with fewer than least_blocks have none."""
    spark = ic.sparkSession
    capacity = spark.createDataFrame([(r.name, r.capacity) for r in recipes], "recipe string, capacity int")
    legal = legal_counts(daily, years, "year", "cutoff").withColumn("n_blocks", F.floor((F.col("legal") - least) / block).cast("int")).where(F.col("n_blocks") >= least_blocks)
    seen = ic.join(F.broadcast(legal), F.col("fold") < F.col("n_blocks")).select("year", "n_blocks", "recipe", "place", "ic")
    means = seen.groupBy("year", "n_blocks", "recipe").agg(F.avg("ic").alias("mean_ic")).join(F.broadcast(capacity), "recipe")
    first = F.row_number().over(Window.partitionBy("year").orderBy(F.round("mean_ic", 12).desc(), "capacity", "recipe"))
    best = means.withColumn("at", first).where("at = 1").select("year", F.col("recipe").alias("best"))
    series = seen.join(F.broadcast(best), "year")
    top = series.where("recipe = best").select("year", "place", F.col("ic").alias("top"))
    gaps = series.join(top, ["year", "place"]).select("year", "recipe", "place", (F.col("top") - F.col("ic")).alias("d"))
    over = Window.partitionBy("year", "recipe").orderBy("place").rowsBetween(-(error_block - 1), 0)
    blocks = gaps.withColumn("m", F.when(F.count("d").over(over) == error_block, F.avg("d").over(over)))
    error = F.stddev_pop("m") * F.sqrt(F.lit(error_block) / F.count("d"))
    close = blocks.groupBy("year", "recipe").agg(F.avg("d").alias("gap"), F.coalesce(error, F.lit(0.0)).alias("se")).where(F.col("gap") <= F.col("se") + 1e-12)
    kept = close.join(means, ["year", "recipe"])
    least_first = F.row_number().over(Window.partitionBy("year").orderBy("capacity", "recipe"))
    members = F.array_join(F.sort_array(F.collect_list("recipe").over(Window.partitionBy("year"))), "|")
    return kept.withColumns({"at": least_first, "one_se_members": members}).where("at = 1").select("year", "recipe", "mean_ic", "one_se_members", "n_blocks")


def refit_spans(daily: DataFrame, refits: DataFrame, least: int, most: int) -> DataFrame:
    """(fit, first, last): for each refit date the last `most` dates whose labels are known by then; none with fewer than `least`."""
    dated = refits.select("refit", F.col("refit").alias("cutoff"))
    legal = legal_counts(daily, dated, "refit", "cutoff")
    return legal.where(F.col("legal") >= least).select(F.col("refit").alias("fit"), F.greatest(F.lit(1), F.col("legal") - most + 1).cast("int").alias("first"), F.col("legal").alias("last"))


def walk_forward(rows: DataFrame, fits: DataFrame, refits: DataFrame, chosen: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, sid, prediction, recipe, refit): each date's rows by its year's recipe, as fitted at the last refit that predicts from that date on or before.

    refits: refit, predict_from. A date before the first refit, or in a year without a recipe, has no rows.
    """
    spans = refits.withColumn("until", F.lead("predict_from").over(Window.orderBy("predict_from")))
    dates = rows.select("date").distinct().join(F.broadcast(spans), (F.col("date") >= F.col("predict_from")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    dates = dates.withColumn("year", F.year("date")).join(F.broadcast(chosen.select("year", "recipe")), "year")
    known = dates.join(fits.select(F.col("fit").alias("refit"), "recipe", "beta"), ["refit", "recipe"]).select("date", "refit", "recipe", "beta")
    return rows.join(F.broadcast(known), "date").select("date", "sid", predicted(names, F.col("beta")).alias("prediction"), "recipe", "refit").where("prediction IS NOT NULL")


def nested_selection(rows: DataFrame, names: Sequence[str], target: str, recipes: Sequence[Recipe], years: DataFrame, refits: DataFrame, least: int, block: int, least_blocks: int, error_block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """What each year chose, and the predictions of its refits. rows: date, sid, label_end, the columns and the target, as ranked_panel() makes them."""
    daily = date_moments(rows, names, target)
    running = running_moments(daily)
    folds = fitted(running, fold_spans(daily, least, block), names, recipes)
    ic = validation_ic(rows, daily, folds, names, target, least, block)
    chosen = store.materialized(select_recipes(ic, daily, years, recipes, least, block, least_blocks, error_block))
    fits = fitted(running, refit_spans(daily, refits, least, most), names, recipes)
    return chosen, walk_forward(rows, fits, refits, chosen, names)
