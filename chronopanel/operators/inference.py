"""Statistical inference: ranks, corrections for many tests, block bootstraps, autocorrelation-robust regressions.

Bootstraps draw block starts by an integer hash of seed, replicate and block, so that any engine draws the same; a
replicate is a group, and the draws are joined to the series by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import order_statistics as od
from chronopanel.sources import store


def auc(rows: DataFrame, score: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, n_positive, auc) by average ranks."""
    return od.area_under_curve(rows, score, outcome, keys)


def average_precision(rows: DataFrame, score: str, outcome: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, average_precision): mean precision at the positives, best score first, ties by `tie`."""
    over = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    have = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("y", F.col(outcome).cast("int"))
    have = have.withColumn("p", F.sum("y").over(over.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(over))
    return have.groupBy(*keys).agg(F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("average_precision"))


def spearman(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, spearman): correlation of average ranks."""
    return od.spearman(rows, a, b, keys)


def calibration(rows: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) of equal-width bins of probabilities."""
    have = rows.where(F.col(p).isNotNull() & F.col(outcome).isNotNull())
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return have.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("rate"))


def _ranked(tests: DataFrame, p: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """tests with rank_ by p within the keys (rows without p last), m_ (rows with p), part_ and spans_.

    Rows are sorted over all tasks and written with the range they fall in, so that a family of any size is dealt to
    as many ranges as it fills. Only families of several ranges (two of each range at most) need counts carried over.
    """
    dealt = store.materialized(tests.repartitionByRange(*keys, F.col(p).asc_nulls_last(), F.col(tie)).withColumn("part_", F.spark_partition_id()))
    family, part = Window.partitionBy(*keys), Window.partitionBy(*keys, "part_")
    sizes = dealt.groupBy(*keys, "part_").agg(F.count("*").alias("rows_"), F.count(p).alias("n_"))
    before = F.sum("rows_").over(family.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_")
    spanning = sizes.select(*keys, "part_", before.alias("before_"), F.sum("n_").over(family).alias("all_"), F.count("*").over(family).alias("parts_")).where("parts_ > 1").drop("parts_")
    local = dealt.withColumn("rank_", F.row_number().over(part.orderBy(F.col(p).asc_nulls_last(), tie))).withColumn("n_", F.count(p).over(part))
    rank, m = F.col("rank_") + F.coalesce("before_", F.lit(0)), F.coalesce("all_", "n_")
    return _with_carried(local, spanning, keys).select(*tests.columns, "part_", rank.alias("rank_"), m.alias("m_"), F.col("before_").isNotNull().alias("spans_"))


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what is carried over to their family and range, null where nothing is."""
    theirs = carried.select(*(F.col(k).alias(f"of_{k}_") for k in (*keys, "part_")), *(c for c in carried.columns if c not in (*keys, "part_")))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}_")) for k in (*keys, "part_")]
    return rows.join(F.broadcast(theirs), same, "left")


def with_false_discovery_rate(tests: DataFrame, p: str, tie: str, keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """tests with q values within the keys; rows without p have none. Equal p go by `tie`. No family is one task."""
    ranked = _ranked(tests, p, tie, keys).withColumn("x_", F.col(p) * F.col("m_") / F.col("rank_"))
    least = ranked.where("spans_").groupBy(*keys, "part_").agg(F.min("x_").alias("x_"))
    carried = least.select(*keys, "part_", F.min("x_").over(Window.partitionBy(*keys).orderBy(F.col("part_").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later_"))
    within = F.min("x_").over(Window.partitionBy(*keys, "part_").orderBy(F.col("rank_").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = _with_carried(ranked.withColumn("x_", within), carried, keys)
    return rows.select(*tests.columns, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "x_", "later_")).alias(name))


def with_holm(tests: DataFrame, p: str, tie: str, keys: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """tests with step-down adjusted p values within the keys. No family is one task."""
    ranked = _ranked(tests, p, tie, keys).withColumn("x_", (F.col("m_") - F.col("rank_") + 1) * F.col(p))
    most = ranked.where("spans_").groupBy(*keys, "part_").agg(F.max("x_").alias("x_"))
    carried = most.select(*keys, "part_", F.max("x_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier_"))
    within = F.max("x_").over(Window.partitionBy(*keys, "part_").orderBy("rank_").rowsBetween(Window.unboundedPreceding, 0))
    rows = _with_carried(ranked.withColumn("x_", within), carried, keys)
    return rows.select(*tests.columns, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.greatest("x_", "earlier_"))).alias(name))


def block_draws(n: DataFrame, replicates: int, block: int, seed: int, circular: bool = True) -> DataFrame:
    """(replicate, place): positions 0 .. n-1 drawn in blocks, about n for each replicate. n: one row with a long column n."""
    reps = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    blocks = reps.select("n", "replicate", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))).alias("b"))
    room = F.col("n") if circular else F.col("n") - block + 1
    # a linear congruence that any SQL engine can follow
    start = F.pmod(F.col("replicate").cast("long") * 1103515245 + F.col("b") * 12345 * (F.col("replicate") % 97 + 1) + seed, F.lit(2147483647)) % room
    steps = blocks.select("n", "replicate", F.col("b"), start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    return steps.where(F.col("b") * block + F.col("k") < F.col("n")).select("replicate", F.pmod(F.col("start") + F.col("k"), F.col("n")).alias("place"))


def block_bootstrap(series: DataFrame, statistic: Column, replicates: int = 200, block: int = 20, seed: int = 7, circular: bool = True) -> DataFrame:
    """(replicate, value) of a statistic over block draws of a series (place from 0, ...)."""
    n = series.agg(F.count("*").alias("n"))
    drawn = block_draws(n, replicates, block, seed, circular)
    return drawn.join(F.broadcast(series), "place").groupBy("replicate").agg(statistic.alias("value"))


def interval(replicates: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(lower, upper, standard_error, p_not_above_0) of bootstrap values; p = (1 + those at or below 0) / (count + 1)."""
    below = F.sum((F.col("value") <= 0).cast("int"))
    return replicates.agg(F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(high)).alias("upper"), F.stddev_samp("value").alias("standard_error"), ((1 + below) / (F.count("value") + 1)).alias("p_not_above_0"))


def overlapping_block_error(series: DataFrame, x: str, block: int) -> DataFrame:
    """(n, mean, standard_error): from the spread of means of overlapping blocks. series: idx, x."""
    over = Window.orderBy("idx").rowsBetween(-(block - 1), 0)
    means = series.select(x, F.when(F.count(x).over(over) == block, F.avg(x).over(over)).alias("block_mean"))
    return means.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_pop("block_mean") * F.sqrt(F.lit(block) / F.count(x))).alias("standard_error"))


def robust_slope(series: DataFrame, y: str, x: str, lags: int) -> DataFrame:
    """(n, slope, intercept, standard_error, t): least squares with Newey-West errors of the slope, Bartlett weights. series: idx, y, x.

    Moments and lagged products are sums over one window; only they leave it.
    """
    rows = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("idx", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    everything = Window.partitionBy()
    mean_x, mean_y = F.avg("x").over(everything), F.avg("y").over(everything)
    centred = rows.select("idx", "x", "y", (F.col("x") - mean_x).alias("dx"), (F.col("y") - mean_y).alias("dy"))
    slope = F.sum(F.col("dx") * F.col("dy")).over(everything) / F.sum(F.col("dx") ** 2).over(everything)
    scored = centred.withColumn("slope", slope).withColumn("u", F.col("dx") * (F.col("dy") - F.col("slope") * F.col("dx")))
    over = Window.orderBy("idx")
    lagged = scored.select("*", *(F.lag("u", k).over(over).alias(f"u{k}") for k in range(1, lags + 1)))
    total = F.sum(F.col("u") ** 2)
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    error = F.sqrt(total) / F.sum(F.col("dx") ** 2)
    out = lagged.agg(F.count("*").alias("n"), F.max("slope").alias("slope"), (F.avg("y") - F.max("slope") * F.avg("x")).alias("intercept"), error.alias("standard_error"))
    return out.withColumn("t", F.try_divide("slope", "standard_error"))


def text_seed(text: Column) -> Column:
    """A seed below 2**32 from a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def bootstrap_rank_correlation(series: DataFrame, x: str, y: str, replicates: int = 200, block: int = 20, seed: int = 7) -> DataFrame:
    """(replicate, value): rank correlation over block draws; ranks are taken anew in each replicate. series: place from 0, x, y."""
    drawn = block_draws(series.agg(F.count("*").alias("n")), replicates, block, seed).join(F.broadcast(series), "place")
    ranked = drawn.select("replicate", C.average_rank(F.col(x), ["replicate"]).alias("a"), C.average_rank(F.col(y), ["replicate"]).alias("b"))
    return ranked.groupBy("replicate").agg(F.corr("a", "b").alias("value"))


def state_contrast(rows: DataFrame, score: str, outcome: str, lags: int, least: int = 60, least_t: float = 1.96) -> DataFrame:
    """(n, contrast, standard_error, t, passes): the outcome in the upper third of the score over that in the lower, with robust errors; passes with enough rows and t.

    rows: one series, idx. Equal scores go to thirds by idx, the earlier one first.
    """
    third = od.with_tile(rows, [score, "idx"], 3, "third").where("third <> 2")
    out = robust_slope(third.withColumn("is_high", (F.col("third") == 3).cast("double")), outcome, "is_high", lags)
    passes = (F.col("n") >= least) & (F.abs("t") > least_t)
    return out.select("n", F.col("slope").alias("contrast"), "standard_error", "t", passes.alias("passes"))


def interaction(rows: DataFrame, outcome: str, a: str, b: str, lags: int) -> DataFrame:
    """(n, did, standard_error, t): difference in differences of two booleans, with errors robust to `lags` neighbours. rows: one series, idx.

    In a model of all four cells the interaction is a weighted sum of the outcomes, and its errors are those of the weighted residuals.
    """
    cell = Window.partitionBy(a, b)
    y = F.col(outcome)
    sign = F.when(F.col(a) == F.col(b), 1.0).otherwise(-1.0) / F.count("*").over(cell)
    scored = rows.select("idx", (sign * y).alias("part"), (sign * (y - F.avg(y).over(cell))).alias("u"))
    over = Window.orderBy("idx")
    lagged = scored.select("*", *(F.lag("u", k).over(over).alias(f"u{k}") for k in range(1, lags + 1)))
    total = F.sum(F.col("u") ** 2)
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    out = lagged.agg(F.count("*").alias("n"), F.sum("part").alias("did"), F.sqrt(total).alias("standard_error"))
    return out.withColumn("t", F.try_divide("did", "standard_error"))
