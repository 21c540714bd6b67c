"""Summaries of paths, panels and cells, one grouped plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def longest_underwater(rows: DataFrame, keys: Sequence[str] = (), drawdown: str = "dd") -> DataFrame:
    """(keys, longest, ended_idx): the longest run of sessions below the peak, and where the first such run ends. rows: keys, idx, drawdown."""
    keys = list(keys)
    over = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("island", F.sum((F.coalesce(F.col(drawdown), F.lit(0.0)) >= 0).cast("long")).over(over)).where(F.col(drawdown) < 0)
    runs = runs.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.max("idx").alias("last"))
    best = F.max(F.struct("n", (-F.col("last")).alias("minus")))
    return runs.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.n").alias("longest"), (-F.col("b.minus")).alias("ended_idx"))


def benchmark_returns(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, b) on the dates of a strategy: the first from open to close, the rest from the close of the strategy's date before. prices: date, open, close."""
    over = Window.orderBy("date")
    rows = dates.select("date").distinct().join(prices.select("date", "open", "close"), "date", "left")
    rows = rows.withColumn("before", F.lag("close").over(over)).withColumn("n", F.row_number().over(over))
    return rows.select("date", (F.col("close") / F.when(F.col("n") == 1, F.col("open")).otherwise(F.col("before")) - 1).alias("b"))


def relative_growth(returns: DataFrame, keys: Sequence[str] = (), periods: int = 252) -> DataFrame:
    """(keys, n, growth): a year's growth of r against b."""
    rows = returns.where("r > -1 AND b > -1")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.expm1((F.sum(F.log1p("r")) - F.sum(F.log1p("b"))) * periods / F.count("*")).alias("growth"))


def path_summary(periods: DataFrame, keys: Sequence[str], per_year: int) -> DataFrame:
    """(keys, n, cagr, information_ratio, max_drawdown, mean_turnover, cost_drag) of periodic returns. periods: keys, idx, r, b, turnover, cost."""
    keys = list(keys)
    over = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = periods.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(over)))
    rows = rows.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(over)) - 1)
    active = F.col("r") - F.col("b")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.expm1(F.sum(F.log1p("r")) * per_year / F.count("*")).alias("cagr"),
        (F.avg(active) / F.nullif(F.stddev_samp(active), F.lit(0.0)) * per_year**0.5).alias("information_ratio"),
        F.min("dd").alias("max_drawdown"),
        F.avg("turnover").alias("mean_turnover"),
        (F.sum("cost") * per_year / F.count("*")).alias("cost_drag"),
    )


def calendar_summary(nav: DataFrame, keys: Sequence[str] = (), days: float = 365.2425) -> DataFrame:
    """(keys, first, last, cagr, beta, turnover): growth a year by calendar days, slope against the market, turnover a year. nav: keys, date, nav, r, b, turnover."""
    years = F.datediff(F.max("date"), F.min("date")) / days
    growth = F.max_by("nav", "date") / F.min_by("nav", "date")
    return nav.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), (F.pow(growth, 1 / years) - 1).alias("cagr"), (F.covar_samp("r", "b") / F.var_samp("b")).alias("beta"), (F.sum("turnover") / years).alias("turnover"))


def coverage(audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_expected, n_excused, n_valid, coverage, adjusted): valid rows over expected ones, and over those without an excuse."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    made = audit.groupBy(*keys).agg(F.count("*").alias("n_expected"), count("is_excused").alias("n_excused"), count("is_valid").alias("n_valid"))
    share = lambda n: F.col("n_valid") / F.nullif(n, F.lit(0))
    return made.select(*keys, "n_expected", "n_excused", "n_valid", share(F.col("n_expected")).alias("coverage"), share(F.col("n_expected") - F.col("n_excused")).alias("adjusted"))


def worklist(audit: DataFrame, least: float) -> DataFrame:
    """(sid, coverage, last_valid, tags): names below the least coverage or with a fault, and why, joined by bars."""
    made = audit.groupBy("sid").agg((F.sum(F.col("is_valid").cast("long")) / F.count("*")).alias("coverage"), F.max(F.when(F.col("is_valid"), F.col("date"))).alias("last_valid"), F.max("date").alias("last"), F.max(F.col("is_fault")).alias("is_fault"))
    tags = F.concat_ws("|", F.when(F.col("coverage") < least, "low_coverage"), F.when(F.col("last_valid").isNull(), "no_history"), F.when(F.datediff("last", "last_valid") > 30, "ends_early"), F.when(F.col("is_fault"), "fault"))
    return made.select("sid", "coverage", "last_valid", tags.alias("tags")).where("tags <> ''")


def active_wealth(returns: DataFrame, spans: Sequence[tuple[str, str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, span, n, wealth): what r over b compounds to in each named span of dates (first, last)."""
    of = F.array(*(F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)) for name, a, b in spans))
    rows = returns.where("r IS NOT NULL AND b IS NOT NULL").withColumn("span", F.explode(F.filter(of, lambda x: x.isNotNull())))
    return rows.groupBy(*keys, "span").agg(F.count("*").alias("n"), F.exp(F.sum(F.log1p("r") - F.log1p("b"))).alias("wealth"))


def information_ratio(rows: DataFrame, keys: Sequence[str], x: str, per_year: int) -> DataFrame:
    """(keys, n, ratio): the mean over the deviation, a year."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * per_year**0.5).alias("ratio"))


def joint_episodes(rows: DataFrame, states: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, states, n_episodes, n_rows): runs of neighbouring idx in which all states stay as they are."""
    over = Window.partitionBy(*keys, *states).orderBy("idx")
    new = rows.withColumn("is_new", F.coalesce(F.col("idx") - F.lag("idx").over(over) > 1, F.lit(True)).cast("long"))
    return new.groupBy(*keys, *states).agg(F.sum("is_new").alias("n_episodes"), F.count("*").alias("n_rows"))


def difference_in_differences(rows: DataFrame, outcome: str, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, did): (mean of both - mean of left alone) - (mean of right alone - mean of neither); left, right: booleans."""
    a, b = F.col(left), F.col(right)
    mean = lambda c: F.avg(F.when(c, F.col(outcome)))
    return rows.groupBy(*keys).agg(F.count(outcome).alias("n"), ((mean(a & b) - mean(a & ~b)) - (mean(~a & b) - mean(~a & ~b))).alias("did"))


def yearly_contributions(rows: DataFrame, outcome: str, left: str, right: str) -> DataFrame:
    """(year, n, contribution): what each year adds to the difference in differences, with the counts of all years as divisors. rows: date, ..."""
    a, b = F.col(left), F.col(right)
    cells = rows.where(F.col(outcome).isNotNull()).withColumn("cell", F.concat_ws("", a.cast("int").cast("string"), b.cast("int").cast("string")))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("whole"))
    sign = F.when(F.col("cell").isin("11", "00"), 1.0).otherwise(-1.0)
    return cells.join(F.broadcast(sizes), "cell").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.sum(sign * F.col(outcome) / F.col("whole")).alias("contribution"))


def time_break(rows: DataFrame, x: str, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, before, after, changes_sign): means before a date and from it on."""
    late = F.col("date") >= F.lit(at).cast("date")
    made = rows.groupBy(*keys).agg(F.avg(F.when(~late, F.col(x))).alias("before"), F.avg(F.when(late, F.col(x))).alias("after"))
    return made.withColumn("changes_sign", F.col("before") * F.col("after") < 0)


def names_per_date(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows, n_dates, median_names): rows, their dates, and the median number of names of a date."""
    daily = rows.groupBy(*keys, "date").agg(F.count("*").alias("rows"), F.countDistinct("sid").alias("names"))
    return daily.groupBy(*keys).agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_dates"), F.percentile("names", F.lit(0.5)).alias("median_names"))


def cell_contrast(rows: DataFrame, low: str, high: str, outcome: str, veto: float) -> DataFrame:
    """(n_cell, cell_mean, rest_mean, contrast, is_vetoed): the outcome where both conditions hold against where they don't; vetoed if it is worse by more than `veto`."""
    cell = F.col(low) & F.col(high)
    made = rows.agg(F.sum(cell.cast("long")).alias("n_cell"), F.avg(F.when(cell, F.col(outcome))).alias("cell_mean"), F.avg(F.when(~cell, F.col(outcome))).alias("rest_mean"))
    return made.withColumn("contrast", F.col("cell_mean") - F.col("rest_mean")).withColumn("is_vetoed", F.col("contrast") < -veto)


def attribution(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_defended, benefit, missed): losses that defence spared, and gains that it missed. rows: keys, is_defended, excess."""
    out = F.col("is_defended")
    return rows.groupBy(*keys).agg(F.sum(out.cast("long")).alias("n_defended"), F.sum(F.when(out & (F.col("excess") < 0), -F.col("excess")).otherwise(0.0)).alias("benefit"), F.sum(F.when(out & (F.col("excess") > 0), F.col("excess")).otherwise(0.0)).alias("missed"))


def alert_metrics(rows: DataFrame, keys: Sequence[str], alert: str, event: str) -> DataFrame:
    """(keys, n, alert_share, precision, recall, lift) of alerts for events."""
    a, e = F.col(alert), F.col(event)
    count = lambda c: F.sum(c.cast("long"))
    made = rows.where(a.isNotNull() & e.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), count(a).alias("n_a"), count(e).alias("n_e"), count(a & e).alias("n_ae"))
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return made.select(*keys, "n", rate("n_a", "n").alias("alert_share"), rate("n_ae", "n_a").alias("precision"), rate("n_ae", "n_e").alias("recall"), (rate("n_ae", "n_a") / F.try_divide("n_e", "n")).alias("lift"))


def error_skill(rows: DataFrame, keys: Sequence[str], prediction: str, target: str, naive: str) -> DataFrame:
    """(keys, n, mae, naive_mae, skill): mean absolute errors, and one less their ratio."""
    have = rows.where(F.col(prediction).isNotNull() & F.col(target).isNotNull() & F.col(naive).isNotNull())
    made = have.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(prediction) - F.col(target))).alias("mae"), F.avg(F.abs(F.col(naive) - F.col(target))).alias("naive_mae"))
    return made.withColumn("skill", 1 - F.try_divide("mae", "naive_mae"))


def rank_ic_by_date(rows: DataFrame, x: str, y: str, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, n, rank_ic): rank correlation over the names of each date with `least` of them. Ranks are taken within a date, so dates are dealt apart."""
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = [*keys, "date"]
    ranked = have.select(*at, C.average_rank(F.col(x), at).alias("rx"), C.average_rank(F.col(y), at).alias("ry"))
    return ranked.groupBy(*at).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rank_ic")).where(F.col("n") >= least)


def importance(rows: DataFrame, keys: Sequence[str], value: str = "importance") -> DataFrame:
    """(keys, n, mean, deviation)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def quintiles(rows: DataFrame, score: Column, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quintile, n, mean): the outcome by fifths of the score within the keys."""
    ranked = rows.withColumn("quintile", F.ntile(5).over(Window.partitionBy(*keys).orderBy(score)))
    return ranked.groupBy(*keys, "quintile").agg(F.count(outcome).alias("n"), F.avg(outcome).alias("mean"))
