"""Volatility, regimes, states and weekly features of single series and of names.

A series is one row for each session; windows over a whole series therefore hold thousands of rows, however large the
panel behind it is. Where there are many series, `keys` part them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def _over(keys: Sequence[str] = (), order: str = "idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def realized_volatility(r: Column, window: int, keys: Sequence[str] = ()) -> Column:
    """Sample deviation of the last returns, annualised; null without a full window."""
    return C.rolling(r, F.stddev_samp, window, _over(keys)) * 252**0.5


def volatility_target(volatility: Column, target: float = 0.15, cap: float = 1.0) -> Column:
    return F.when(volatility > 0, F.least(F.lit(cap), target / volatility))


def empirical_percentile(x: Column, lookback: int, least: int, keys: Sequence[str] = ()) -> Column:
    """Share of the last values, the present one included, that aren't above it; the frame is bounded by the lookback."""
    past = F.collect_list(x).over(_over(keys).rowsBetween(-(lookback - 1), 0))
    return F.when(x.isNotNull() & (F.size(past) >= least), F.size(F.filter(past, lambda v: v <= x)) / F.size(past))


def mid_rank_percentile(x: Column, least: int, keys: Sequence[str] = (), lookback: int = 2600) -> Column:
    """(values below + half of the equal ones) / values, over strictly earlier rows."""
    past = F.collect_list(x).over(_over(keys).rowsBetween(-lookback, -1))
    below, same = F.size(F.filter(past, lambda v: v < x)), F.size(F.filter(past, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(past) >= least), (below + 0.5 * same) / F.size(past))


def hysteresis(x: Column, enter: float, leave: float, keys: Sequence[str] = ()) -> Column:
    """True from above `enter` until below `leave`; nulls keep the state; false at first."""
    signal = F.when(x > enter, True).when(x < leave, False)
    return F.coalesce(F.last(signal, True).over(_over(keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def lagged_quartile(x: Column, history: int, keys: Sequence[str] = ()) -> Column:
    """1 to 4 by the quartiles of the strictly earlier `history` values; null without all of them."""
    frame = _over(keys).rowsBetween(-history, -1)
    q = [F.percentile(x, F.lit(p)).over(frame) for p in (0.25, 0.5, 0.75)]
    level = F.when(x <= q[0], 1).when(x <= q[1], 2).when(x <= q[2], 3).otherwise(4)
    return F.when(x.isNotNull() & (F.count(x).over(frame) == history), level)


def derisked(quartile: Column, volatility: Column, upper: Column) -> Column:
    """1 outside the highest quartile; in it, the third quartile over the volatility, at most 1."""
    return F.when(quartile.isNull(), None).when(quartile < 4, 1.0).otherwise(F.least(F.lit(1.0), upper / volatility))


def ewma_variance(r: Column, decay: float = 0.94, keys: Sequence[str] = ()) -> Column:
    return C.exponential_mean(r * r, decay, _over(keys))


def volatility_forecasts(series: DataFrame, horizon: int = 21, decay: float = 0.94) -> DataFrame:
    """(date, idx, persistence, ewma, realised): annualised forecasts, and what came over the horizon. series: date, idx, r."""
    over = _over()
    ahead = over.rowsBetween(1, horizon)
    realised = F.when(F.count("r").over(ahead) == horizon, F.sqrt(252.0 / horizon * F.sum(F.col("r") * F.col("r")).over(ahead)))
    behind = over.rowsBetween(-(horizon - 1), 0)
    persistence = F.when(F.count("r").over(behind) == horizon, F.sqrt(252.0 / horizon * F.sum(F.col("r") * F.col("r")).over(behind)))
    return series.select("date", "idx", persistence.alias("persistence"), F.sqrt(252.0 * ewma_variance(F.col("r"), decay)).alias("ewma"), realised.alias("realised"))


def forecast_metrics(forecasts: DataFrame, names: Sequence[str] = ("persistence", "ewma")) -> DataFrame:
    """(model, n, qlike, mae, variance_r2, correlation) on the rows where all are there and above 0."""
    common = forecasts.where(" AND ".join(f"{c} > 0" for c in [*names, "realised"]))
    long = common.unpivot(["realised"], list(names), "model", "forecast")
    ratio = (F.col("realised") / F.col("forecast")) ** 2
    v, f = F.col("realised") ** 2, F.col("forecast") ** 2
    r2 = 1 - F.sum((v - f) ** 2) / (F.var_pop(v) * F.count("*"))
    return long.groupBy("model").agg(F.count("*").alias("n"), F.avg(ratio - F.log(ratio) - 1).alias("qlike"), F.avg(F.abs(F.col("realised") - F.col("forecast"))).alias("mae"), r2.alias("variance_r2"), F.corr("realised", "forecast").alias("correlation"))


def weekly_features(market: DataFrame) -> DataFrame:
    """Features of the market series at week ends. market: date, idx, week_last, close, volume."""
    over = _over()
    close = F.col("close")
    r = C.simple_return(close, F.lag("close").over(over))
    rows = market.select("*", r.alias("r"))
    rv21, rv126 = realized_volatility(F.col("r"), 21), realized_volatility(F.col("r"), 126)
    down = C.rolling(F.when(F.col("r").isNotNull(), F.when(F.col("r") < 0, F.col("r") ** 2).otherwise(0.0)), F.sum, 63, over)
    everything = C.rolling(F.col("r") ** 2, F.sum, 63, over)
    made = {
        "return_21": C.simple_return(close, F.lag("close", 21).over(over)),
        "return_126": C.simple_return(close, F.lag("close", 126).over(over)),
        "trend_50_200": C.rolling(close, F.avg, 50, over) / C.rolling(close, F.avg, 200, over) - 1,
        "drawdown_252": close / C.rolling(close, F.max, 252, over) - 1,
        "rv_21": rv21,
        "rv_126": rv126,
        "log_rv_ratio": F.log(rv21 / rv126),
        "downside_share_63": down / everything,
        "skewness_63": F.when(F.count("r").over(over.rowsBetween(-62, 0)) == 63, C.sample_skewness(F.col("r"), over.rowsBetween(-62, 0))),
        "kurtosis_126": F.when(F.count("r").over(over.rowsBetween(-125, 0)) == 126, C.sample_kurtosis(F.col("r"), over.rowsBetween(-125, 0))),
    }
    return rows.select("date", "week_last", *(c.alias(n) for n, c in made.items())).where("week_last").drop("week_last")


def volume_scores(market: DataFrame) -> DataFrame:
    """(date, down_volume_share, volume_surge) at week ends: share of money that moved on falling days, and short over median volume."""
    over = _over()
    rows = market.select("date", "idx", "week_last", (F.col("close") * F.col("volume")).alias("money"), C.simple_return(F.col("close"), F.lag("close").over(over)).alias("r"))
    frame = over.rowsBetween(-20, 0)
    share = F.when(F.count("r").over(frame) == 21, F.sum(F.when(F.col("r") < 0, F.col("money")).otherwise(0.0)).over(frame) / F.sum("money").over(frame))
    surge = F.log(C.rolling(F.col("money"), F.avg, 21, over) / C.rolling(F.col("money"), lambda x: F.percentile(x, F.lit(0.5)), 252, over))
    return rows.select("date", "week_last", share.alias("down_volume_share"), surge.alias("volume_surge")).where("week_last").drop("week_last")


def reentry_indicators(market: DataFrame) -> DataFrame:
    """(date, rv_21, threshold, above_average, confirmed): volatility, its strictly past third quartile, and two closes above the 21-session mean."""
    over = _over()
    rows = market.select("date", "idx", "close", C.simple_return(F.col("close"), F.lag("close").over(over)).alias("r"))
    rows = rows.select("*", realized_volatility(F.col("r"), 21).alias("rv_21"), (F.col("close") > C.rolling(F.col("close"), F.avg, 21, over)).alias("above_average"))
    threshold = C.trailing(F.col("rv_21"), lambda x: F.percentile(x, F.lit(0.75)), 756, over)
    return rows.select("date", "rv_21", threshold.alias("threshold"), "above_average", (F.col("above_average") & F.lag("above_average").over(over)).alias("confirmed"))


def runs(states: DataFrame, state: str = "state", order: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, run, state, first, last, length) of runs of equal states; rows without a state break runs and are in none."""
    over = _over(keys, order)
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(over)) | (F.row_number().over(over) == 1)
    numbered = states.withColumn("run", C.run_id(changed, over)).where(F.col(state).isNotNull())
    return numbered.groupBy(*keys, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def longest_run(states: DataFrame, condition: str, order: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, longest): most rows in a row for which the condition holds."""
    marked = states.withColumn("holds", F.coalesce(F.expr(condition), F.lit(False)))
    return runs(marked, "holds", order, keys).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("holds"), F.col("length"))), F.lit(0)).alias("longest"))


def tercile(percentile: Column) -> Column:
    return F.when(percentile.isNull(), None).when(percentile <= 1 / 3, "low").when(percentile <= 2 / 3, "mid").otherwise("high")


def dispersion(spine: DataFrame) -> DataFrame:
    """(date, n, dispersion): 1.4826 times the median absolute deviation of the names' daily returns."""
    r = spine.select("date", C.simple_return(F.col("close"), F.lag("close").over(Window.partitionBy("sid").orderBy("idx"))).alias("r")).where("r IS NOT NULL")
    centre = r.groupBy("date").agg(F.percentile("r", F.lit(0.5)).alias("centre"))
    return r.join(F.broadcast(centre), "date").groupBy("date").agg(F.count("*").alias("n"), (1.4826 * F.percentile(F.abs(F.col("r") - F.col("centre")), F.lit(0.5))).alias("dispersion"))


def yearly_threshold_states(series: DataFrame, x: str, least: int = 260) -> DataFrame:
    """(date, threshold, state): above the third quartile of all rows before the year began; below `least` rows, or without x, the state stays."""
    years = series.select(F.year("date").alias("y")).distinct()
    past = F.broadcast(years).join(series.select(F.year("date").alias("of"), F.col(x).alias("v")).where("v IS NOT NULL"), F.col("of") < F.col("y"))
    thresholds = past.groupBy("y").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.75)).alias("t")).select("y", F.when(F.col("n") >= least, F.col("t")).alias("threshold"))
    joined = series.withColumn("y", F.year("date")).join(F.broadcast(thresholds), "y", "left")
    over = _over().rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("date", "threshold", F.last(F.col(x) > F.col("threshold"), True).over(over).alias("state"))


def eligibility(features: DataFrame, names: Sequence[str], least_rows: int, most_missing: float, most_missing_run: int) -> DataFrame:
    """(feature, first, last, n_rows, missing_share, longest_gap, status) of each feature between its first and last value."""
    long = features.unpivot(["date", "idx"], list(names), "feature", "value")
    span = long.where("value IS NOT NULL").groupBy("feature").agg(F.min("idx").alias("from"), F.max("idx").alias("to"), F.min("date").alias("first"), F.max("date").alias("last"))
    inside = long.join(F.broadcast(span), "feature").where("idx BETWEEN from AND to")
    gaps = longest_run(inside, "value IS NULL", "idx", ["feature"]).withColumnRenamed("longest", "longest_gap")
    counts = inside.groupBy("feature", "first", "last").agg(F.count("*").alias("n_rows"), (F.sum(F.col("value").isNull().cast("int")) / F.count("*")).alias("missing_share"))
    status = F.when(F.col("n_rows") < least_rows, "too_short").when(F.col("missing_share") > most_missing, "too_sparse").when(F.col("longest_gap") > most_missing_run, "gap_too_long").otherwise("eligible")
    return counts.join(gaps, "feature").withColumn("status", status)


def weekly_long(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, arm_id, value, value_available, missing_reason) from one column for each arm."""
    long = features.unpivot(["date"], list(names), "arm_id", "value")
    return long.select("date", "arm_id", "value", F.col("value").isNotNull().alias("value_available"), F.when(F.col("value").isNull(), "not_available").alias("missing_reason"))
