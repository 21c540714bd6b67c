"""Cross-sectional market factors over a (date, sid) spine.

All factors of a panel share one window: names are dealt out by sid and sorted by session once. The spine must hold
every session of every name, so that frames of rows are frames of sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.functions.regression import delay_of_windows


def _over() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("idx")


def _past() -> WindowSpec:
    return _over().rowsBetween(Window.unboundedPreceding, 0)


def _lag(n: int, x: str = "close") -> Column:
    return F.lag(x, n).over(_over())


def _full_year() -> Column:
    valid = F.count(F.when(F.col("close") > 0, 1)).over(_over().rowsBetween(-255, 0))
    return F.when(valid == 256, C.simple_return(F.col("close"), _lag(255)))


#: Running sums over a name's past, from which sums over any window are differences; a window of 1260 rows costs no more than one of 2.
_SUMS = {"n": "1.0", "x": "r3", "y": "m3", "xx": "r3 * r3", "yy": "m3 * m3", "xy": "r3 * m3"}


def _correlation(n: int, least: int) -> Column:
    """Correlation of r3 and m3 over the last n sessions in which both are there."""
    s = {k: F.col(f"sum_{k}") - F.coalesce(_lag(n, f"sum_{k}"), F.lit(0.0)) for k in _SUMS}
    spread = lambda a, aa: s["n"] * s[aa] - s[a] * s[a]
    root = F.sqrt(F.greatest(spread("x", "xx"), F.lit(0.0)) * F.greatest(spread("y", "yy"), F.lit(0.0)))
    return F.when(s["n"] >= least, F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], root))


def _volume_shock() -> Column:
    past = F.collect_list("volume").over(_over().rowsBetween(-49, 0))
    less, equal = F.size(F.filter(past, lambda v: v < F.col("volume"))), F.size(F.filter(past, lambda v: v == F.col("volume")))
    return F.when((F.size(past) == 50) & F.col("volume").isNotNull(), (less + (equal + 1) / 2.0) / 50)


#: Raw value and sign of the score (1: high is good), from close, volume, split, r (daily return), r3, m3 (3-day log returns of name and market), r1, m1.
FACTORS: dict[str, tuple[Callable[[], Column], int]] = {
    "return_255": (_full_year, 1),
    "momentum_12_1": (lambda: C.simple_return(_lag(21), _lag(252)), 1),
    "momentum_12_7": (lambda: C.simple_return(_lag(126), _lag(252)), 1),
    "high_ratio_252": (lambda: F.col("adjusted") / C.rolling(F.col("adjusted"), F.max, 252, _over()), 1),
    "reversal_21": (lambda: C.simple_return(F.col("close"), _lag(21)), -1),
    "beta": (lambda: _correlation(1260, 750) * C.rolling(F.col("r1"), F.stddev_samp, 252, _over(), 120) / C.rolling(F.col("m1"), F.stddev_samp, 252, _over(), 120), -1),
    "max_21": (lambda: C.rolling(F.col("r"), F.max, 21, _over()), -1),
    "illiquidity_252": (lambda: C.rolling(F.abs("r") / (F.col("close") * F.col("volume")), F.avg, 252, _over()), 1),
    "volume_shock_50": (_volume_shock, 1),
    "volatility_21": (lambda: C.rolling(F.col("r"), F.stddev_samp, 21, _over()) * 252**0.5, -1),
    "log_momentum_255_0": (lambda: C.log_return(F.col("close"), _lag(255)), 1),
    "log_momentum_255_21": (lambda: C.log_return(_lag(21), _lag(255)), 1),
    "log_reversal_21": (lambda: C.log_return(F.col("close"), _lag(21)), -1),
}


def daily_inputs(spine: DataFrame, market: DataFrame) -> DataFrame:
    """spine with daily and 3-day returns of the name and of the market (date, close)."""
    series = Window.orderBy("idx")
    m = market.select("idx", F.log("close").alias("lm"))
    m = m.select("idx", (F.col("lm") - F.lag("lm", 3).over(series)).alias("m3"), (F.col("lm") - F.lag("lm").over(series)).alias("m1"))
    out = spine if "split" in spine.columns else spine.withColumn("split", F.lit(0.0))
    out = out.join(F.broadcast(m), "idx", "left")  # one row for each session
    known = F.max(F.col("split").isNull().cast("int")).over(_past()) == 0
    factor = F.exp(F.sum(F.log(F.when(F.col("split") > 0, F.col("split")).otherwise(1.0))).over(_past()))
    out = out.select(
        "*",
        C.simple_return(F.col("close"), _lag(1)).alias("r"),
        C.log_return(F.col("close"), _lag(3)).alias("r3"),
        C.log_return(F.col("close"), _lag(1)).alias("r1"),
        F.when(known, F.col("close") * factor).alias("adjusted"),
    )
    both = F.col("r3").isNotNull() & F.col("m3").isNotNull()
    return out.select("*", *(F.coalesce(F.sum(F.when(both, F.expr(x))).over(_past()), F.lit(0.0)).alias(f"sum_{k}") for k, x in _SUMS.items()))


def factor_table(daily: DataFrame, names: Sequence[str], at: Column) -> DataFrame:
    """(signal_date, sid, factor_id, raw_value, score, eligible, missing_reason) on the sessions where `at` holds."""
    wide = daily.select("date", "sid", at.alias("wanted"), *(C.finite(FACTORS[n][0]()).alias(n) for n in names)).where("wanted")
    long = wide.unpivot(["date", "sid"], list(names), "factor_id", "raw_value")
    sign = F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, FACTORS[n][1]))), F.col("factor_id"))
    eligible = F.col("raw_value").isNotNull()
    return long.select(F.col("date").alias("signal_date"), "sid", "factor_id", "raw_value", (sign * F.col("raw_value")).alias("score"), eligible.alias("eligible"), F.when(~eligible, F.lit("insufficient_history")).alias("missing_reason"))


def calendar_month_momentum(spine: DataFrame) -> DataFrame:
    """(month, sid, score): log ratio of the month-end closes one and twelve months back; constant within the month."""
    ends = spine.where("month_last").select("sid", F.trunc("date", "month").alias("of"), "close")
    month = ends.select("sid", F.col("of").alias("month"))
    back = lambda k, name: ends.select("sid", F.add_months("of", k).alias("month"), F.col("close").alias(name))
    return month.join(back(1, "near"), ["sid", "month"], "left").join(back(12, "far"), ["sid", "month"], "left").select("month", "sid", C.log_return(F.col("near"), F.col("far")).alias("score"))


def same_month_return(spine: DataFrame, market: DataFrame, years: int = 5, least: int = 3) -> DataFrame:
    """(date, sid, score): mean excess return of the coming calendar month in earlier years, at month ends."""
    over = Window.partitionBy("sid").orderBy("idx")
    ends = market.where("month_last").select("idx", F.col("close").alias("market_close"))
    monthly = spine.where("month_last").join(F.broadcast(ends), "idx")
    excess = C.simple_return(F.col("close"), F.lag("close").over(over)) - C.simple_return(F.col("market_close"), F.lag("market_close").over(over))
    monthly = monthly.select("date", "sid", "idx", excess.alias("x"))
    lags = F.array(*(F.lag("x", 12 * k - 1).over(over) for k in range(1, years + 1)))
    have = F.filter(lags, lambda v: v.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda s, v: s + v) / F.size(have)
    return monthly.select("date", "sid", F.when(F.size(have) >= least, mean).alias("score"))


def price_delay(spine: DataFrame, market: DataFrame, weeks: int = 52) -> DataFrame:
    """(date, sid, delay) at week ends: how much of a name's return lags of the market explain. A window holds `weeks` rows."""
    series = Window.orderBy("idx")
    m = market.where("week_last").select("idx", F.col("close").alias("mc"))
    m = m.select("idx", C.simple_return(F.col("mc"), F.lag("mc").over(series)).alias("x0"))
    m = m.select("*", *(F.lag("x0", k).over(series).alias(f"x{k}") for k in range(1, 5)))
    weekly = spine.where("week_last").select("date", "sid", "idx", "close")
    weekly = weekly.select("*", C.simple_return(F.col("close"), F.lag("close").over(_over())).alias("y")).join(F.broadcast(m), "idx")
    rows = F.collect_list(F.array(*(F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("y", "x0", "x1", "x2", "x3", "x4")))).over(_over().rowsBetween(-(weeks - 1), 0))
    return weekly.select("date", "sid", F.pandas_udf(delay_of_windows, "double")(rows).alias("delay"))
