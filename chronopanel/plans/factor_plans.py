"""Market factors (FAC) and the ranking of their scores (RNK)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import market_factors as mf
from chronopanel.operators import ranking as rk
from chronopanel.plans import registry as R
from chronopanel.plans.registry import query
from chronopanel.sources import panel

_SPLIT = "CASE WHEN idx % 400 = 0 THEN 2.0 ELSE 0.0 END"


def _daily(spark, sf_dir, sid):
    spine = panel.spine(panel.prices(spark, sf_dir, sid)).withColumn("split", F.when(F.col("idx") % 400 == 0, 2.0).otherwise(0.0))
    return mf.daily_inputs(spine, panel.market(spark, sf_dir))


def _base(sid: str) -> str:
    m = f"{R.MARKET_BARS}, mk AS (SELECT date, LN(close) - LN(LAG(close, 3) OVER (ORDER BY date)) AS m3, LN(close) - LN(LAG(close) OVER (ORDER BY date)) AS m1 FROM bars)"
    return f"""WITH {R.spine(sid)}, {m},
b0 AS (SELECT spine.*, m3, m1, {R.ret('close', R.lag('close'))} AS r, {R.lret('close', R.lag('close', 3))} AS r3, {R.lret('close', R.lag('close'))} AS r1,
  close * EXP(SUM(LN(CASE WHEN {_SPLIT} > 0 THEN {_SPLIT} ELSE 1.0 END)) OVER (PARTITION BY sid ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS adjusted FROM spine LEFT JOIN mk USING (date)),
base AS (SELECT *, r3 + m3 AS both3 FROM b0)"""


_BETA = f"""({R.rolling('COUNT', 'both3', 1260, 750)} IS NOT NULL)::INT * CORR(r3, m3) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW)
  * ({R.rolling('STDDEV_SAMP', 'r1', 252, 120)}) / ({R.rolling('STDDEV_SAMP', 'm1', 252, 120)})"""
_BETA = _BETA.replace(f"({R.rolling('COUNT', 'both3', 1260, 750)} IS NOT NULL)::INT *", f"CASE WHEN COUNT(both3) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW) >= 750 THEN 1.0 END *")
_SHOCK = """(SELECT CASE WHEN len(p) = 50 AND volume IS NOT NULL THEN (len(list_filter(p, lambda v: v < volume)) + (len(list_filter(p, lambda v: v = volume)) + 1) / 2.0) / 50 END
  FROM (SELECT list_filter(LIST(volume) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL) AS p) AS q)"""


def _sql(sid: str, expression: str, sign: int) -> str:
    return f"""{_base(sid)}, f AS (SELECT date, sid, month_last, {expression} AS v FROM base)
SELECT date AS signal_date, sid, ROUND(v, 8) AS raw_value, ROUND({sign} * v, 8) AS score, v IS NOT NULL AS eligible, CASE WHEN v IS NULL THEN 'insufficient_history' END AS missing_reason FROM f WHERE month_last"""


_SHOCK_SQL = f"""{_base(R.SIZE_GROUP)}, p AS (SELECT date, sid, month_last, volume, LIST(volume) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM base),
q AS (SELECT *, list_filter(l, lambda v: v IS NOT NULL) AS k FROM p),
f AS (SELECT *, CASE WHEN len(k) = 50 AND volume IS NOT NULL THEN (len(list_filter(k, lambda v: v < volume)) + (len(list_filter(k, lambda v: v = volume)) + 1) / 2.0) / 50 END AS v FROM q)
SELECT date AS signal_date, sid, ROUND(v, 8) AS raw_value, ROUND(v, 8) AS score, v IS NOT NULL AS eligible, CASE WHEN v IS NULL THEN 'insufficient_history' END AS missing_reason FROM f WHERE month_last"""

_MAX_CLOSE = R.rolling("MAX", "adjusted", 252)
#: query, factor, panel, SQL of the raw value
_FACTORS = [
    ("fac_01_return_255", "return_255", "SIZE_GROUP", f"CASE WHEN COUNT(CASE WHEN close > 0 THEN 1 END) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) = 256 THEN {R.ret('close', R.lag('close', 255))} END"),
    ("fac_02_momentum_12_1", "momentum_12_1", "BRAND", R.ret(R.lag("close", 21), R.lag("close", 252))),
    ("fac_03_momentum_12_7", "momentum_12_7", "BRAND", R.ret(R.lag("close", 126), R.lag("close", 252))),
    ("fac_04_high_ratio", "high_ratio_252", "SIZE_GROUP", f"adjusted / ({_MAX_CLOSE})"),
    ("fac_05_reversal_21", "reversal_21", "BRAND", R.ret("close", R.lag("close", 21))),
    ("fac_07_beta", "beta", "SIZE_GROUP", _BETA),
    ("fac_08_max_21", "max_21", "SIZE_GROUP", R.rolling("MAX", "r", 21)),
    ("fac_17_log_momentum_255_0", "log_momentum_255_0", "BRAND", R.lret("close", R.lag("close", 255))),
    ("fac_17_log_momentum_255_21", "log_momentum_255_21", "BRAND", R.lret(R.lag("close", 21), R.lag("close", 255))),
    ("fac_19_log_reversal_21", "log_reversal_21", "BRAND", R.lret("close", R.lag("close", 21))),
]


def _factor(name: str, sid: str):
    def run(spark, sf_dir):
        out = mf.factor_table(_daily(spark, sf_dir, getattr(panel, sid)), [name], F.col("month_last"))
        return out.select("signal_date", "sid", F.round("raw_value", 8).alias("raw_value"), F.round("score", 8).alias("score"), "eligible", "missing_reason")

    return run


for _name, _id, _sid, _raw in _FACTORS:
    query(_name, _sql(getattr(R, _sid), _raw, mf.FACTORS[_id][1]))(_factor(_id, _sid))
query("fac_13_volume_shock", _SHOCK_SQL)(_factor("volume_shock_50", "SIZE_GROUP"))


_ILLIQUID = R.rolling("AVG", "x", 252)


@query("fac_09_illiquidity", f"{_base(R.SIZE_GROUP)}, a AS (SELECT *, ABS(r) / (close * volume) AS x FROM base), f AS (SELECT date, sid, month_last, {_ILLIQUID} AS v FROM a) SELECT date AS signal_date, sid, ROUND(v * 1e6, 8) AS scaled FROM f WHERE month_last")
def illiquidity(spark, sf_dir):
    out = mf.factor_table(_daily(spark, sf_dir, panel.SIZE_GROUP), ["illiquidity_252"], F.col("month_last"))
    return out.select("signal_date", "sid", F.round(F.col("raw_value") * 1e6, 8).alias("scaled"))


@query(
    "fac_06_same_month",
    f"""{_base(R.BRAND)}, e AS (SELECT spine.date, sid, idx, spine.close, bars.close AS mc FROM spine JOIN bars USING (date) WHERE month_last),
x AS (SELECT date, sid, idx, {R.ret('close', R.lag('close'))} - {R.ret('mc', R.lag('mc'))} AS x FROM e),
l AS (SELECT date, sid, [{', '.join(R.lag('x', 12 * k - 1) for k in range(1, 6))}] AS l FROM x),
k AS (SELECT date, sid, list_filter(l, lambda v: v IS NOT NULL) AS k FROM l)
SELECT date, sid, CASE WHEN len(k) >= 3 THEN ROUND(list_sum(k) / len(k), 8) END AS score FROM k""".replace(f"- {R.ret('mc', R.lag('mc'))}", f"- ({R.ret('mc', R.lag('mc'))})").replace(f"{R.ret('close', R.lag('close'))} -", f"({R.ret('close', R.lag('close'))}) -"),
)
def same_month(spark, sf_dir):
    out = mf.same_month_return(panel.spine(panel.prices(spark, sf_dir)), panel.market(spark, sf_dir))
    return out.withColumn("score", F.round("score", 8))


@query("fac_10_price_delay")
def price_delay(spark, sf_dir):
    return mf.price_delay(panel.spine(panel.prices(spark, sf_dir)), panel.market(spark, sf_dir))


_PANEL_IDS = ["momentum_12_1", "momentum_12_7", "reversal_21", "log_momentum_255_0"]
_PANEL_SQL = [R.ret(R.lag("close", 21), R.lag("close", 252)), R.ret(R.lag("close", 126), R.lag("close", 252)), f"-({R.ret('close', R.lag('close', 21))})", R.lret("close", R.lag("close", 255))]
_LONG = f"""{_base(R.BRAND)}, wide AS (SELECT date, sid, month_last, {', '.join(f'{e} AS {n}' for n, e in zip(_PANEL_IDS, _PANEL_SQL, strict=True))} FROM base),
long AS ({' UNION ALL '.join(f"SELECT date, sid, '{n}' AS factor_id, ROUND({n}, 8) AS score FROM wide WHERE month_last" for n in _PANEL_IDS)})"""


def _long(spark, sf_dir):
    out = mf.factor_table(_daily(spark, sf_dir, panel.BRAND), _PANEL_IDS, F.col("month_last"))
    return out.select(F.col("signal_date").alias("date"), "sid", "factor_id", F.round("score", 8).alias("score"))


@query("fac_00_factor_table", f"{_LONG} SELECT date, sid, factor_id, score, score IS NOT NULL AS eligible FROM long")
def factor_panel(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("eligible", F.col("score").isNotNull())


@query(
    "fac_18_calendar_month_momentum",
    f"""WITH {R.spine()}, e AS (SELECT sid, {R.month('date')} AS of, close FROM spine WHERE month_last)
SELECT e.of AS month, e.sid, ROUND({R.lret('n.close', 'f.close')}, 8) AS score FROM e LEFT JOIN e n ON n.sid = e.sid AND n.of + INTERVAL 1 MONTH = e.of LEFT JOIN e f ON f.sid = e.sid AND f.of + INTERVAL 12 MONTH = e.of""",
)
def month_momentum(spark, sf_dir):
    return mf.calendar_month_momentum(panel.spine(panel.prices(spark, sf_dir))).withColumn("score", F.round("score", 8))


_VOL = R.rolling("STDDEV_SAMP", "r", 21)


@query(
    "fac_20_risk_adjusted_momentum",
    f"""{_base(R.SIZE_GROUP)}, f AS (SELECT date, sid, month_last, {R.lret('close', R.lag('close', 255))} AS m, ({_VOL}) * SQRT(252) AS v FROM base)
SELECT date, sid, CASE WHEN v > 0 THEN ROUND(m / v, 8) END AS score FROM f WHERE month_last""",
)
def risk_adjusted(spark, sf_dir):
    out = mf.factor_table(_daily(spark, sf_dir, panel.SIZE_GROUP), ["log_momentum_255_0", "volatility_21"], F.col("month_last"))
    wide = out.groupBy(F.col("signal_date").alias("date"), "sid").pivot("factor_id", ["log_momentum_255_0", "volatility_21"]).agg(F.first("raw_value"))
    return wide.select("date", "sid", F.when(F.col("volatility_21") > 0, F.round(F.col("log_momentum_255_0") / F.col("volatility_21"), 8)).alias("score"))


@query("fac_21_centered_rank", f"{_LONG} SELECT date, sid, factor_id, CASE WHEN COUNT(score) OVER (PARTITION BY factor_id, date) >= 2 THEN ROUND(2.0 * ({R.avg_rank('score', 'factor_id, date')} - 1) / (COUNT(score) OVER (PARTITION BY factor_id, date) - 1) - 1, 8) END AS rank FROM long")
def centered(spark, sf_dir):
    return _long(spark, sf_dir).select("date", "sid", "factor_id", F.round(C.centered_rank(F.col("score"), ["factor_id", "date"]), 8).alias("rank"))


@query(
    "fac_22_neutral_filled",
    f"""{_LONG}, r AS (SELECT date, sid, factor_id, 2.0 * (1 - (ROW_NUMBER() OVER (PARTITION BY factor_id, date ORDER BY score DESC, sid) - 1.0) / COUNT(*) OVER (PARTITION BY factor_id, date)) - 1 AS c FROM long WHERE score IS NOT NULL)
SELECT date, sid, {', '.join(f"ROUND(COALESCE(MAX(CASE WHEN factor_id = '{n}' THEN c END), 0.0), 8) AS {n}" for n in _PANEL_IDS)}, COUNT(*) AS n_available FROM r GROUP BY date, sid HAVING COUNT(*) >= 3""",
)
def neutral(spark, sf_dir):
    long = _long(spark, sf_dir).where("score IS NOT NULL")
    part = Window.partitionBy("factor_id", "date")
    c = 2.0 * (1 - (F.row_number().over(part.orderBy(F.col("score").desc(), "sid")) - 1.0) / F.count(F.lit(1)).over(part)) - 1
    wide = long.withColumn("c", c).groupBy("date", "sid").agg(*(F.round(F.coalesce(F.max(F.when(F.col("factor_id") == n, F.col("c"))), F.lit(0.0)), 8).alias(n) for n in _PANEL_IDS), F.count("*").alias("n_available"))
    return wide.where("n_available >= 3")


_ONE = f"{_LONG}, s AS (SELECT date, sid, score FROM long WHERE factor_id = 'momentum_12_7')"
_RANKED = f"{_ONE}, k AS (SELECT *, CASE WHEN score IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, sid) END AS rank FROM s)"


def _scores(spark, sf_dir):
    return _long(spark, sf_dir).where("factor_id = 'momentum_12_7'").select("date", "sid", "score")


@query("rnk_01_top_5", f"{_RANKED} SELECT date, sid, score, rank, COALESCE(rank <= 5, false) AS selected, CASE WHEN score IS NULL THEN 'missing_score' END AS exclusion_reason FROM k")
def top_5(spark, sf_dir):
    return rk.rank_and_select(_scores(spark, sf_dir), 5)


@query(
    "rnk_02_winner_loser",
    f"""{_ONE}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC, sid) AS best, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score, sid) AS worst, COUNT(*) OVER (PARTITION BY date) AS n FROM s WHERE score IS NOT NULL)
SELECT date, sid, CAST(CASE WHEN best <= 4 THEN 0.125 ELSE -0.125 END AS DOUBLE) AS weight FROM k WHERE n >= 8 AND (best <= 4 OR worst <= 4)""",
)
def winner_loser(spark, sf_dir):
    return rk.winner_loser_weights(_scores(spark, sf_dir), 4)


@query(
    "rnk_06_date_metadata",
    f"""{_RANKED}, c AS (SELECT *, MAX(CASE WHEN rank = 10 THEN score END) OVER (PARTITION BY date) AS cut FROM k WHERE score IS NOT NULL)
SELECT date, COUNT(*) AS eligible_count, CAST(SUM(CASE WHEN score = cut THEN 1 ELSE 0 END) AS BIGINT) AS tied_at_cut, STRING_AGG(sid, '|' ORDER BY rank) FILTER (WHERE rank <= 10) AS top_sids FROM c GROUP BY date""",
)
def metadata(spark, sf_dir):
    return rk.date_metadata(_scores(spark, sf_dir), 10)


@query("rnk_07_ranking_rows", f"{_RANKED} SELECT date, COUNT(*) AS selected_count, COUNT(DISTINCT sid) AS unique_sids, true AS is_monotone FROM k WHERE rank <= 5 GROUP BY date")
def ranking_rows(spark, sf_dir):
    return rk.ranking_rows(_scores(spark, sf_dir), 5)


@query("rnk_08_equal_weights", f"{_ONE} SELECT date, sid, ROUND(1.0 / COUNT(*) OVER (PARTITION BY date), 10) AS weight FROM s WHERE score IS NOT NULL")
def equal(spark, sf_dir):
    return rk.equal_weights(_scores(spark, sf_dir).where("score IS NOT NULL")).withColumn("weight", F.round("weight", 10))


_LABELS = f"lab AS (SELECT date, sid, {R.ret('LEAD(close) OVER (PARTITION BY sid ORDER BY idx)', 'close')} AS label FROM spine WHERE month_last)"


def _ledger_sql(top: str) -> str:
    return f"""{_RANKED}, {_LABELS}, h AS (SELECT date, sid, COALESCE(label, 0.0) AS r, 1.0 / COUNT(*) OVER (PARTITION BY date) AS w FROM k JOIN lab USING (date, sid) WHERE {top}),
t AS (SELECT date, COUNT(*) AS n_names, SUM(w * r) AS gross_return FROM h GROUP BY date), n AS (SELECT *, LEAD(date) OVER (ORDER BY date) AS next_date FROM t),
d AS (SELECT next_date AS date, sid, w * (1 + r) / (1 + gross_return) AS was FROM h JOIN n USING (date) WHERE next_date IS NOT NULL),
u AS (SELECT date, SUM(ABS(COALESCE(w, 0.0) - COALESCE(was, 0.0))) AS turnover FROM h FULL JOIN d USING (date, sid) GROUP BY date)
SELECT date, n_names, ROUND(gross_return, 8) AS gross_return, ROUND(turnover, 8) AS turnover FROM t JOIN u USING (date)"""


def _ledger(spark, sf_dir, n):
    spine = panel.spine(panel.prices(spark, sf_dir))
    labels = spine.where("month_last").select("date", "sid", C.simple_return(F.lead("close").over(panel.by_name()), F.col("close")).alias("label"))
    out = rk.period_ledger(_scores(spark, sf_dir).join(labels, ["date", "sid"]), n)
    return out.select("date", "n_names", F.round("gross_return", 8).alias("gross_return"), F.round("turnover", 8).alias("turnover"))


@query("rnk_09_period_ledger", _ledger_sql("rank <= 5"))
def ledger_top(spark, sf_dir):
    return _ledger(spark, sf_dir, 5)


@query("rnk_10_equal_weight_ledger", _ledger_sql("label IS NOT NULL"))
def ledger_all(spark, sf_dir):
    return _ledger(spark, sf_dir, None)


@query(
    "rnk_11_switched_scores",
    f"""{_LONG}, st AS (SELECT date, idx % 2 = 0 AS is_high FROM cal)
SELECT date, sid, CASE WHEN is_high THEN b.score ELSE a.score END AS score FROM (SELECT * FROM long WHERE factor_id = 'momentum_12_7') a JOIN (SELECT * FROM long WHERE factor_id = 'reversal_21') b USING (date, sid) JOIN st USING (date)""",
)
def switched(spark, sf_dir):
    long = _long(spark, sf_dir)
    states = panel.market(spark, sf_dir).select("date", (F.col("idx") % 2 == 0).alias("is_high"))
    return rk.switched_scores(long.where("factor_id = 'momentum_12_7'"), long.where("factor_id = 'reversal_21'"), states)


@query(
    "rnk_12_pair_similarity",
    f"""{_LONG}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor_id, date ORDER BY score DESC, sid) <= 5 AS s, {R.avg_rank('score', 'factor_id, date')} AS r FROM long WHERE score IS NOT NULL),
d AS (SELECT a.factor_id AS a, b.factor_id AS b, date, CORR(a.r, b.r) AS c, SUM((a.s AND b.s)::INT) / SUM((a.s OR b.s)::INT)::DOUBLE AS j FROM k a JOIN k b USING (date, sid) WHERE a.factor_id < b.factor_id GROUP BY ALL)
SELECT a, b, ROUND(MEDIAN(CASE WHEN NOT isnan(c) THEN c END), 8) AS median_correlation, ROUND(MEDIAN(j), 8) AS median_overlap, COUNT(*) AS n_dates FROM d GROUP BY a, b""",
)
def similarity(spark, sf_dir):
    out = rk.pair_similarity(_long(spark, sf_dir), 5)
    return out.select("a", "b", F.round("median_correlation", 8).alias("median_correlation"), F.round("median_overlap", 8).alias("median_overlap"), "n_dates")


@query("val_21_nested_top_k", f"{_RANKED} SELECT date, COUNT(*) FILTER (WHERE rank <= 3) = 3 AND COUNT(*) FILTER (WHERE rank <= 5) = 5 AND COUNT(*) FILTER (WHERE rank <= 10) = 10 AS is_nested FROM k GROUP BY date")
def nested(spark, sf_dir):
    return rk.is_nested(rk.rank_and_select(_scores(spark, sf_dir), 10), [3, 5, 10])
