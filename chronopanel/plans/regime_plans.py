"""Windows, volatility, regimes and states (WIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import regimes as rg
from chronopanel.plans import registry as R
from chronopanel.plans.registry import query
from chronopanel.sources import panel

_NO = ""
_RET = f"CASE WHEN LAG(close) OVER (ORDER BY idx) > 0 THEN close / LAG(close) OVER (ORDER BY idx) - 1 END"
SERIES = f"WITH {R.MARKET}, s AS (SELECT *, {_RET} AS r FROM m)"


def _roll(fn, x, n, least=None):
    return R.rolling(fn, x, n, least, _NO)


RV21 = f"{_roll('STDDEV_SAMP', 'r', 21)} * SQRT(252)"
VOL = f"{SERIES}, v AS (SELECT *, ({_roll('STDDEV_SAMP', 'r', 21)}) * SQRT(252) AS rv FROM s)"


def series(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    return m.withColumn("r", C.simple_return(F.col("close"), F.lag("close").over(Window.orderBy("idx"))))


def volatility(spark, sf_dir):
    return series(spark, sf_dir).withColumn("rv", rg.realized_volatility(F.col("r"), 21))


def _rounded(df, *names, digits=8):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


@query("win_01_realized_volatility", f"{VOL} SELECT date, ROUND(rv, 8) AS rv FROM v")
def realized(spark, sf_dir):
    return volatility(spark, sf_dir).select("date", F.round("rv", 8).alias("rv"))


@query(
    "win_02_name_volatility",
    f"""WITH {R.spine(R.SIZE_GROUP)}, s AS (SELECT *, {R.ret('close', R.lag('close'))} AS r FROM spine) SELECT * FROM (SELECT date, sid, ROUND(({R.rolling('STDDEV_SAMP', 'r', 21)}) * SQRT(252), 8) AS rv, week_last FROM s) AS q WHERE week_last""".replace("SELECT * FROM (SELECT date", "SELECT date, sid, rv FROM (SELECT date"),
)
def names(spark, sf_dir):
    s = panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)).withColumn("r", C.simple_return(F.col("close"), F.lag("close").over(panel.by_name())))
    return s.select("date", "sid", "week_last", F.round(rg.realized_volatility(F.col("r"), 21, ["sid"]), 8).alias("rv")).where("week_last").drop("week_last")


@query("win_03_volatility_target", f"{VOL} SELECT date, CASE WHEN rv > 0 THEN ROUND(LEAST(1.0, 3.0 / rv), 8) END AS allocation FROM v WHERE week_last".replace("FROM v WHERE", "FROM v WHERE"))
def target(spark, sf_dir):
    return volatility(spark, sf_dir).select("date", "week_last", F.round(rg.volatility_target(F.col("rv"), 3.0), 8).alias("allocation")).where("week_last").drop("week_last")


_PCT = f"{VOL}, l AS (SELECT *, list_filter(LIST(ROUND(rv, 10)) OVER (ORDER BY idx ROWS BETWEEN 755 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS k FROM v), p AS (SELECT *, CASE WHEN rv IS NOT NULL AND len(k) >= 252 THEN len(list_filter(k, lambda x: x <= ROUND(rv, 10))) / len(k) END AS pct FROM l)"


def percentiles(spark, sf_dir):
    v = volatility(spark, sf_dir).withColumn("rv", F.round("rv", 10))
    return v.withColumn("pct", rg.empirical_percentile(F.col("rv"), 756, 252))


@query("win_04_empirical_percentile", f"{_PCT} SELECT date, ROUND(pct, 8) AS pct FROM p")
def percentile(spark, sf_dir):
    return percentiles(spark, sf_dir).select("date", F.round("pct", 8).alias("pct"))


_STATE = f"{_PCT}, h AS (SELECT *, COALESCE(LAST_VALUE(CASE WHEN pct > 0.8 THEN true WHEN pct < 0.6 THEN false END IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS is_high FROM p)"


def states(spark, sf_dir):
    return percentiles(spark, sf_dir).withColumn("is_high", rg.hysteresis(F.col("pct"), 0.8, 0.6))


@query("win_05_hysteresis_state", f"{_STATE} SELECT date, is_high FROM h")
def hysteresis(spark, sf_dir):
    return states(spark, sf_dir).select("date", "is_high")


@query("win_07_regime_allocation", f"{_STATE} SELECT date, CAST(CASE WHEN is_high THEN 0.0 ELSE 1.0 END AS DOUBLE) AS allocation FROM h WHERE month_last")
def allocation(spark, sf_dir):
    return states(spark, sf_dir).where("month_last").select("date", F.when(F.col("is_high"), 0.0).otherwise(1.0).alias("allocation"))


_Q = f"""{VOL}, q AS (SELECT *, {', '.join(f"QUANTILE_CONT(rv, {p}) OVER (ORDER BY idx ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING) AS q{i}" for i, p in enumerate((0.25, 0.5, 0.75)))}, COUNT(rv) OVER (ORDER BY idx ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING) AS n FROM v),
k AS (SELECT *, CASE WHEN rv IS NOT NULL AND n = 756 THEN CASE WHEN rv <= q0 THEN 1 WHEN rv <= q1 THEN 2 WHEN rv <= q2 THEN 3 ELSE 4 END END AS quartile FROM q)"""


@query("win_08_lagged_quartile", f"{_Q} SELECT date, quartile FROM k")
def quartile(spark, sf_dir):
    return volatility(spark, sf_dir).select("date", rg.lagged_quartile(F.col("rv"), 756).alias("quartile"))


_E = 0.94


@query(
    "win_11_ewma_variance",
    f"""{SERIES}, l AS (SELECT *, list_filter(LIST(r * r) OVER (ORDER BY idx ROWS BETWEEN 447 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS k FROM s)
SELECT date, CASE WHEN len(k) > 0 THEN ROUND(list_reduce(k, lambda v, x: 0.94 * v + 0.06 * x), 8) END AS variance FROM l""",
)
def ewma(spark, sf_dir):
    return series(spark, sf_dir).select("date", F.round(rg.ewma_variance(F.col("r"), _E), 8).alias("variance"))


@query("win_15_derisked_allocation", f"{_Q} SELECT date, CASE WHEN quartile < 4 THEN 1.0 WHEN quartile = 4 THEN ROUND(LEAST(1.0, q2 / rv), 8) END AS allocation FROM k WHERE week_last")
def derisked(spark, sf_dir):
    v = volatility(spark, sf_dir)
    frame = Window.orderBy("idx").rowsBetween(-756, -1)
    made = rg.derisked(rg.lagged_quartile(F.col("rv"), 756), F.col("rv"), F.percentile("rv", F.lit(0.75)).over(frame))
    return v.select("date", "week_last", F.round(made, 8).alias("allocation")).where("week_last").drop("week_last")


_FC = f"""{SERIES}, l AS (SELECT *, list_filter(LIST(r * r) OVER (ORDER BY idx ROWS BETWEEN 447 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS k FROM s),
f AS (SELECT date, idx, CASE WHEN COUNT(r) OVER b = 21 THEN SQRT(252.0 / 21 * SUM(r * r) OVER b) END AS persistence, CASE WHEN len(k) > 0 THEN SQRT(252.0 * list_reduce(k, lambda v, x: 0.94 * v + (1 - 0.94) * x)) END AS ewma,
  CASE WHEN COUNT(r) OVER a = 21 THEN SQRT(252.0 / 21 * SUM(r * r) OVER a) END AS realised FROM l WINDOW b AS (ORDER BY idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), a AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))"""


@query("win_18_volatility_forecasts", f"{_FC} SELECT date, ROUND(persistence, 8) AS persistence, ROUND(ewma, 8) AS ewma, ROUND(realised, 8) AS realised FROM f")
def forecasts(spark, sf_dir):
    return _rounded(rg.volatility_forecasts(series(spark, sf_dir)).drop("idx"), "persistence", "ewma", "realised")


@query(
    "win_19_forecast_metrics",
    f"""{_FC}, c AS (SELECT * FROM f WHERE persistence > 0 AND ewma > 0 AND realised > 0), g AS (SELECT 'persistence' AS model, persistence AS p, realised AS y FROM c UNION ALL SELECT 'ewma', ewma, realised FROM c)
SELECT model, COUNT(*) AS n, ROUND(AVG((y / p) ** 2 - LN((y / p) ** 2) - 1), 7) AS qlike, ROUND(AVG(ABS(y - p)), 7) AS mae, ROUND(1 - SUM((y ** 2 - p ** 2) ** 2) / (VAR_POP(y ** 2) * COUNT(*)), 6) AS variance_r2, ROUND(CORR(y, p), 7) AS correlation FROM g GROUP BY model""",
)
def metrics(spark, sf_dir):
    out = rg.forecast_metrics(rg.volatility_forecasts(series(spark, sf_dir)))
    return out.select("model", "n", F.round("qlike", 7).alias("qlike"), F.round("mae", 7).alias("mae"), F.round("variance_r2", 6).alias("variance_r2"), F.round("correlation", 7).alias("correlation"))


@query("win_20_activation_date", f"{_FC} SELECT MIN(date) AS activation_date FROM f JOIN (SELECT date FROM s WHERE week_last) AS w USING (date) WHERE persistence > 0 AND ewma > 0")
def activation(spark, sf_dir):
    f = rg.volatility_forecasts(series(spark, sf_dir))
    weeks = panel.market(spark, sf_dir).where("week_last").select("date")
    return f.join(weeks, "date").where("persistence > 0 AND ewma > 0").agg(F.min("date").alias("activation_date"))


_W = lambda n: f"(ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_FEATURES = {
    "return_21": "close / NULLIF(LAG(close, 21) OVER (ORDER BY idx), 0) - 1",
    "return_126": "close / NULLIF(LAG(close, 126) OVER (ORDER BY idx), 0) - 1",
    "trend_50_200": f"({_roll('AVG', 'close', 50)}) / ({_roll('AVG', 'close', 200)}) - 1",
    "drawdown_252": f"close / ({_roll('MAX', 'close', 252)}) - 1",
    "rv_21": f"({_roll('STDDEV_SAMP', 'r', 21)}) * SQRT(252)",
    "rv_126": f"({_roll('STDDEV_SAMP', 'r', 126)}) * SQRT(252)",
    "log_rv_ratio": f"LN(({_roll('STDDEV_SAMP', 'r', 21)}) / ({_roll('STDDEV_SAMP', 'r', 126)}))",
    "downside_share_63": f"CASE WHEN COUNT(r) OVER {_W(63)} = 63 THEN SUM(CASE WHEN r < 0 THEN r * r ELSE 0.0 END) OVER {_W(63)} / SUM(r * r) OVER {_W(63)} END",
    "skewness_63": f"CASE WHEN COUNT(r) OVER {_W(63)} = 63 THEN SKEWNESS(r) OVER {_W(63)} END",
    "kurtosis_126": f"CASE WHEN COUNT(r) OVER {_W(126)} = 126 THEN KURTOSIS(r) OVER {_W(126)} END",
}
_WF = f"{SERIES}, wf AS (SELECT date, week_last, {', '.join(f'{e} AS {n}' for n, e in _FEATURES.items())} FROM s)"


@query("win_22_weekly_features", f"{_WF} SELECT date, {', '.join(f'ROUND({n}, 6) AS {n}' for n in _FEATURES)} FROM wf WHERE week_last")
def features(spark, sf_dir):
    return _rounded(rg.weekly_features(panel.market(spark, sf_dir)), *_FEATURES, digits=6)


@query("win_23_defence_scores", f"{_WF} SELECT date, ROUND(-trend_50_200, 6) AS weak_trend, ROUND(-drawdown_252, 6) AS drawdown, ROUND(log_rv_ratio, 6) AS rising_volatility FROM wf WHERE week_last")
def defence(spark, sf_dir):
    w = rg.weekly_features(panel.market(spark, sf_dir))
    return w.select("date", F.round(-F.col("trend_50_200"), 6).alias("weak_trend"), F.round(-F.col("drawdown_252"), 6).alias("drawdown"), F.round("log_rv_ratio", 6).alias("rising_volatility"))


@query(
    "win_24_volume_scores",
    f"""{SERIES}, d AS (SELECT *, close * volume AS money FROM s), w AS (SELECT date, week_last, CASE WHEN COUNT(r) OVER {_W(21)} = 21 THEN SUM(CASE WHEN r < 0 THEN money ELSE 0.0 END) OVER {_W(21)} / SUM(money) OVER {_W(21)} END AS a,
  LN(({_roll('AVG', 'money', 21)}) / (CASE WHEN COUNT(money) OVER {_W(252)} >= 252 THEN MEDIAN(money) OVER {_W(252)} END)) AS b FROM d)
SELECT date, ROUND(a, 7) AS down_volume_share, ROUND(b, 7) AS volume_surge FROM w WHERE week_last""",
)
def volumes(spark, sf_dir):
    return _rounded(rg.volume_scores(panel.market(spark, sf_dir)), "down_volume_share", "volume_surge", digits=7)


@query(
    "win_25_reentry_indicators",
    f"""{VOL}, a AS (SELECT *, close > ({_roll('AVG', 'close', 21)}) AS above FROM v)
SELECT date, ROUND(rv, 8) AS rv_21, ROUND(CASE WHEN COUNT(rv) OVER p >= 756 THEN QUANTILE_CONT(rv, 0.75) OVER p END, 8) AS threshold, above AS above_average, above AND LAG(above) OVER (ORDER BY idx) AS confirmed FROM a WINDOW p AS (ORDER BY idx ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING)""",
)
def reentry(spark, sf_dir):
    return _rounded(rg.reentry_indicators(panel.market(spark, sf_dir)), "rv_21", "threshold")


_MID = f"""{SERIES}, l AS (SELECT date, idx, week_last, ROUND(close, 6) AS x, LIST(ROUND(close, 6)) OVER (ORDER BY idx ROWS BETWEEN 2600 PRECEDING AND 1 PRECEDING) AS k FROM s),
c AS (SELECT *, CASE WHEN len(k) >= 260 THEN (len(list_filter(k, lambda v: v < x)) + 0.5 * len(list_filter(k, lambda v: v = x))) / len(k) END AS pct FROM l)"""


@query("win_27_mid_rank_percentile", f"{_MID} SELECT date, ROUND(pct, 8) AS pct, CASE WHEN pct IS NULL THEN NULL WHEN pct <= 1 / 3 THEN 'low' WHEN pct <= 2 / 3 THEN 'mid' ELSE 'high' END AS tercile FROM c WHERE week_last")
def mid_rank(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("x", F.round("close", 6)).withColumn("pct", rg.mid_rank_percentile(F.col("x"), 260))
    return s.where("week_last").select("date", F.round("pct", 8).alias("pct"), rg.tercile(F.col("pct")).alias("tercile"))


@query(
    "win_29_state_runs",
    f"""{_STATE}, n AS (SELECT *, SUM(CASE WHEN is_high IS DISTINCT FROM w OR idx = 1 THEN 1 ELSE 0 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, LAG(is_high) OVER (ORDER BY idx) AS w FROM h) AS q)
SELECT CAST(run AS BIGINT) AS run, is_high, MIN(idx) AS first, MAX(idx) AS last, COUNT(*) AS length FROM n GROUP BY run, is_high""",
)
def state_runs(spark, sf_dir):
    return rg.runs(states(spark, sf_dir), "is_high")


@query(
    "win_37_longest_gap",
    f"""WITH {R.spine()}, b AS (SELECT sid, idx, close IS NULL AS gone FROM spine), i AS (SELECT sid, idx - ROW_NUMBER() OVER (PARTITION BY sid ORDER BY idx) AS g FROM b WHERE gone), c AS (SELECT sid, COUNT(*) AS n FROM i GROUP BY sid, g)
SELECT s.sid, COALESCE(MAX(n), 0) AS longest FROM (SELECT DISTINCT sid FROM px) AS s LEFT JOIN c USING (sid) GROUP BY s.sid""",
)
def longest_gap(spark, sf_dir):
    return rg.longest_run(panel.spine(panel.prices(spark, sf_dir)), "close IS NULL", "idx", ["sid"])


@query(
    "win_30_dispersion",
    f"""WITH {R.spine()}, d AS (SELECT date, {R.ret('close', R.lag('close'))} AS r FROM spine), e AS (SELECT * FROM d WHERE r IS NOT NULL), c AS (SELECT date, MEDIAN(r) AS m FROM e GROUP BY date)
SELECT date, COUNT(*) AS n, ROUND(1.4826 * MEDIAN(ABS(r - m)), 8) AS dispersion FROM e JOIN c USING (date) GROUP BY date""",
)
def dispersion(spark, sf_dir):
    return _rounded(rg.dispersion(panel.spine(panel.prices(spark, sf_dir))), "dispersion")


@query(
    "win_31_yearly_threshold_state",
    f"""{VOL}, t AS (SELECT y.y, CASE WHEN COUNT(*) >= 260 THEN QUANTILE_CONT(rv, 0.75) END AS threshold FROM (SELECT DISTINCT YEAR(date) AS y FROM v) AS y JOIN v ON YEAR(v.date) < y.y WHERE rv IS NOT NULL GROUP BY y.y)
SELECT date, ROUND(threshold, 8) AS threshold, LAST_VALUE(rv > threshold IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS state FROM v LEFT JOIN t ON t.y = YEAR(date)""",
)
def yearly_threshold(spark, sf_dir):
    return _rounded(rg.yearly_threshold_states(volatility(spark, sf_dir), "rv"), "threshold")


@query(
    "win_35_rolling_and_calendar",
    f"{SERIES} SELECT YEAR(date) AS year, QUARTER(date) AS quarter, COUNT(r) AS n, ROUND(AVG(r), 8) AS mean, ROUND(STDDEV_SAMP(r), 8) AS deviation, ROUND(SUM(LN(1 + r)), 8) AS log_growth FROM s GROUP BY 1, 2",
)
def calendar_sums(spark, sf_dir):
    s = series(spark, sf_dir)
    out = s.groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("deviation"), F.sum(F.log1p("r")).alias("log_growth"))
    return _rounded(out, "mean", "deviation", "log_growth")


_ARMS = ["return_126", "drawdown_252", "rv_126"]


@query("win_38_weekly_long", f"{_WF} " + " UNION ALL ".join(f"SELECT date, '{n}' AS arm_id, ROUND({n}, 6) AS value, {n} IS NOT NULL AS value_available, CASE WHEN {n} IS NULL THEN 'not_available' END AS missing_reason FROM wf WHERE week_last" for n in _ARMS))
def long(spark, sf_dir):
    return rg.weekly_long(_rounded(rg.weekly_features(panel.market(spark, sf_dir)), *_ARMS, digits=6), _ARMS)


@query(
    "win_36_eligibility",
    f"""{_WF}, n AS (SELECT ROW_NUMBER() OVER (ORDER BY date) AS idx, * FROM wf WHERE week_last), g AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, date, idx, {n} AS value FROM n" for n in _ARMS)}),
p AS (SELECT feature, MIN(idx) AS a, MAX(idx) AS b, MIN(date) AS first, MAX(date) AS last FROM g WHERE value IS NOT NULL GROUP BY feature)
SELECT feature, first, last, COUNT(*) AS n_rows, 0.0::DOUBLE AS missing_share, 0 AS longest_gap, CASE WHEN COUNT(*) < 315 THEN 'too_short' ELSE 'eligible' END AS status FROM g JOIN p USING (feature) WHERE idx BETWEEN a AND b GROUP BY ALL""",
)
def eligible(spark, sf_dir):
    w = rg.weekly_features(panel.market(spark, sf_dir)).withColumn("idx", F.row_number().over(Window.orderBy("date")))
    return rg.eligibility(w, _ARMS, 315, 0.1, 4)
