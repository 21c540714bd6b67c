"""Performance, drawdown and conditional statistics of return series and of panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import order_statistics as od


def _drawdowns(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """returns with nav and dd, the fall from the running peak, the start at 1 included."""
    over = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where("r IS NOT NULL").withColumn("nav", F.exp(F.sum(F.log1p("r")).over(over)))
    return rows.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(over)) - 1)


def _longest_underwater(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("dd") < 0, 0).otherwise(1)).over(over)
    return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.sum((F.col("dd") < 0).cast("long")).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_underwater"))


def summary(returns: DataFrame, keys: Sequence[str] = (), periods: int = 252) -> DataFrame:
    """Per key: observations, total return, CAGR, volatility, Sharpe (over 0 and over rf), Sortino, deepest and longest drawdown, Calmar.

    returns: keys, idx, r, rf; null returns don't count.
    """
    keys = list(keys)
    rows = _drawdowns(returns, keys)
    n, log_total = F.count("*"), F.sum(F.log1p("r"))
    excess = F.col("r") - F.col("rf")
    downside = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") ** 2).otherwise(0.0)))
    cagr = F.exp(log_total * periods / n) - 1
    made = rows.groupBy(*keys).agg(
        n.alias("observations"),
        (F.exp(log_total) - 1).alias("total_return"),
        cagr.alias("cagr"),
        (F.stddev_samp("r") * periods**0.5).alias("volatility"),
        (F.avg("r") / F.stddev_samp("r") * periods**0.5).alias("sharpe_0"),
        (F.avg(excess) / F.stddev_samp(excess) * periods**0.5).alias("sharpe_rf"),
        (F.avg("r") * periods**0.5 / downside).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        (cagr / F.abs(F.min("dd"))).alias("calmar"),
    )
    longest = _longest_underwater(rows, keys)
    return made.join(longest, keys) if keys else made.crossJoin(longest)


def relative(returns: DataFrame, keys: Sequence[str] = (), periods: int = 252) -> DataFrame:
    """Per key: excess, geometric excess, beta, alpha, tracking error, information ratio of r against b on rows where both are there."""
    rows = returns.where("r IS NOT NULL AND b IS NOT NULL")
    active = F.col("r") - F.col("b")
    beta = F.covar_samp("r", "b") / F.var_samp("b")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        (F.avg(active) * periods).alias("excess"),
        F.expm1((F.sum(F.log1p("r")) - F.sum(F.log1p("b"))) * periods / F.count("*")).alias("geometric_excess"),
        beta.alias("beta"),
        ((F.avg("r") - beta * F.avg("b")) * periods).alias("alpha"),
        (F.stddev_samp(active) * periods**0.5).alias("tracking_error"),
        (F.avg(active) / F.stddev_samp(active) * periods**0.5).alias("information_ratio"),
    )


def risk_profile(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: ulcer and pain index, share under water, value at risk and expected shortfall at 95 %, extremes, skewness, kurtosis, hit rate."""
    keys = list(keys)
    rows = _drawdowns(returns, keys)
    cut = rows.groupBy(*keys).agg(F.percentile("r", F.lit(0.05)).alias("cut"), F.percentile("dd", F.lit(0.05)).alias("dd_cut"))
    rows = rows.join(F.broadcast(cut), keys) if keys else rows.crossJoin(F.broadcast(cut))
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("dd") ** 2)).alias("ulcer"),
        F.avg(F.abs("dd")).alias("pain"),
        F.avg((F.col("dd") < 0).cast("double")).alias("underwater_share"),
        F.max("cut").alias("var_95"),
        F.avg(F.when(F.col("r") <= F.col("cut"), F.col("r"))).alias("es_95"),
        F.avg(F.when(F.col("dd") <= F.col("dd_cut"), F.col("dd"))).alias("cdar_95"),
        F.min("r").alias("worst_day"),
        F.max("r").alias("best_day"),
        C.sample_skewness(F.col("r")).alias("skewness"),
        C.sample_kurtosis(F.col("r")).alias("kurtosis"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
    )


def annual_returns(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return returns.where("r IS NOT NULL").groupBy(*keys, F.year("date").alias("year")).agg(F.count("*").alias("n"), F.expm1(F.sum(F.log1p("r"))).alias("annual_return"))


def by_state(returns: DataFrame, state: str = "state") -> DataFrame:
    """(state, n, mean, median, win_rate, es_10, worst): es_10 is the mean of the worst tenth, rounded up."""
    rows = returns.where(F.col("r").isNotNull() & F.col(state).isNotNull())
    place = F.row_number().over(Window.partitionBy(state).orderBy("r", "idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy(state))
    rows = rows.withColumn("is_tail", place <= F.ceil(0.1 * n))
    return rows.groupBy(state).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(F.when(F.col("is_tail"), F.col("r"))).alias("es_10"), F.min("r").alias("worst"))


def interaction(panel: DataFrame, a: str, b: str, x: str) -> DataFrame:
    """(contrast, n): mean high-high less high-low less low-high plus low-low; a and b are booleans."""
    cell = lambda p, q: F.avg(F.when((F.col(a) == p) & (F.col(b) == q), F.col(x)))
    return panel.agg((cell(True, True) - cell(True, False) - cell(False, True) + cell(False, False)).alias("contrast"), F.count(x).alias("n"))


def leave_one_year_out(panel: DataFrame, x: str) -> DataFrame:
    """(left_out, mean, same_sign): means without each year, and whether they have the sign of the whole mean. Sums by year first."""
    years = panel.where(F.col(x).isNotNull()).groupBy(F.year("date").alias("y")).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    everything = Window.partitionBy()
    rest = (F.sum("s").over(everything) - F.col("s")) / F.nullif(F.sum("n").over(everything) - F.col("n"), F.lit(0))
    whole = F.sum("s").over(everything) / F.sum("n").over(everything)
    return years.select(F.col("y").alias("left_out"), rest.alias("mean"), (F.signum(rest) == F.signum(whole)).alias("same_sign"))


def universe_audit(spine: DataFrame, flag: str = "month_last") -> DataFrame:
    """(date, sid, has_21, has_255, has_next_open, exclusion_reason): which signals a name has what it takes for."""
    over = Window.partitionBy("sid").orderBy("idx")
    ok = lambda c: F.coalesce(c > 0, F.lit(False))
    rows = spine.select("date", "sid", flag, ok(F.col("close")).alias("now"), ok(F.lag("close", 21).over(over)).alias("l21"), ok(F.lag("close", 255).over(over)).alias("l255"), ok(F.lead("open").over(over)).alias("next_open")).where(flag)
    reason = F.concat_ws("|", F.when(~F.col("now"), "no_close"), F.when(~F.col("l21"), "no_close_21"), F.when(~F.col("l255"), "no_close_255"), F.when(~F.col("next_open"), "no_next_open"))
    return rows.select("date", "sid", (F.col("now") & F.col("l21")).alias("has_21"), (F.col("now") & F.col("l255")).alias("has_255"), F.col("next_open").alias("has_next_open"), F.nullif(reason, F.lit("")).alias("exclusion_reason"))


def audit_summary(audit: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return audit.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("has_21").cast("long")).alias("n_21"), rate("has_21").alias("rate_21"), rate("has_255").alias("rate_255"), rate("has_next_open").alias("rate_next_open"))


def rank_ic(panel: DataFrame, score: str, target: str, keys: Sequence[str] = ("date",), least: int = 3) -> DataFrame:
    """(keys, n, ic): rank correlation of score and target among rows where both are there."""
    rows = panel.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    rows = rows.select(*keys, C.average_rank(F.col(score), keys).alias("a"), C.average_rank(F.col(target), keys).alias("b"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), C.finite(F.corr("a", "b")).alias("ic")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ic.where("ic IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n_dates"), F.percentile("ic", F.lit(0.5)).alias("median_ic"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))


def with_quantile_group(rows: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """rows with 1 to n by linear quantiles of the whole column, right-closed; null where there is no value."""
    cuts = od.quantiles(rows, [value], {f"q{k}": k / n for k in range(1, n)})
    group = reduce(add, (F.when(F.col(value) > F.col(f"{value}_q{k}"), 1).otherwise(0) for k in range(1, n)), F.lit(1))
    return rows.crossJoin(F.broadcast(cuts)).select(*rows.columns, F.when(F.col(value).isNotNull(), group).alias(name))


def alert_quality(panel: DataFrame, score: str, outcome: str, share: float = 0.75) -> DataFrame:
    """(n, n_alerts, precision, recall, lift) of scores above their quantile against a boolean outcome."""
    rows = panel.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    cut = od.quantiles(rows, [score], {"cut": share}).withColumnRenamed(f"{score}_cut", "cut")
    rows = rows.crossJoin(F.broadcast(cut)).select((F.col(score) > F.col("cut")).alias("a"), F.col(outcome).alias("y"))
    hit = F.sum((F.col("a") & F.col("y")).cast("long"))
    alerts, events = F.sum(F.col("a").cast("long")), F.sum(F.col("y").cast("long"))
    return rows.agg(F.count("*").alias("n"), alerts.alias("n_alerts"), F.try_divide(hit, alerts).alias("precision"), F.try_divide(hit, events).alias("recall"), F.try_divide(hit * F.count("*"), alerts * events).alias("lift"))
