"""Forward targets (TGT), portfolio paths (SIM) and performance (AGG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import performance as pf
from chronopanel.operators import portfolio as po
from chronopanel.operators import ranking as rk
from chronopanel.operators import targets as tg
from chronopanel.plans import registry as R
from chronopanel.plans.regime_plans import SERIES, VOL, series, volatility
from chronopanel.plans.registry import query
from chronopanel.sources import panel, store


def rounded(df, digits=8):
    """df with its double columns rounded."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _logged(df, name):
    """A value that grows without bound, as its rounded logarithm."""
    return df.select(*(F.round(F.log(name), 7).alias(f"log_{name}") if c == name else F.col(c) for c in df.columns))


_CASH = f"WITH {R.MARKET}, mc AS (SELECT *, COALESCE(SUM(LN(1 + rf)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM m), w AS (SELECT date AS signal_date, idx + 1 AS a, ROW_NUMBER() OVER (ORDER BY date) AS week FROM m WHERE week_last AND next_session IS NOT NULL)"


def _horizon(h: int) -> str:
    return f"""{_CASH}, d AS (SELECT *, LEAD(a, {h}) OVER (ORDER BY week) AS b FROM w), e AS (SELECT signal_date, a, b, x.open AS oa, x.cb AS ca, y.open AS ob, y.cb AS cb FROM d JOIN mc x ON x.idx = a JOIN mc y ON y.idx = b),
p AS (SELECT signal_date, LN(ob) - LN(oa) AS t, LN(ob) - LN(oa) - (e.cb - ca) AS te, MIN(LN(close) - LN(oa)) AS low, ARG_MIN(date, {{'s': LN(close) - LN(oa), 'd': date}}) AS worst_date FROM e JOIN mc ON idx >= a AND idx < b GROUP BY 1, 2, 3),
o AS (SELECT signal_date, te AS terminal_excess, LEAST(0.0, low, t) AS worst, worst_date, te < 0 AS is_negative FROM p)"""


for _h in (1, 4, 13, 26):
    query(f"tgt_04_outcomes_{_h}w", f"{_horizon(_h)} SELECT signal_date, ROUND(terminal_excess, 8) AS terminal_excess, ROUND(worst, 8) AS worst, worst_date, is_negative FROM o")(
        lambda spark, sf_dir, h=_h: rounded(tg.horizon_outcomes(panel.market(spark, sf_dir), h))
    )


@query("tgt_05_adverse_excursions", f"{_horizon(13)} SELECT signal_date, ROUND(-worst, 8) AS mae_log, ROUND(1 - EXP(worst), 8) AS mae_simple, ROUND(GREATEST(1 - EXP(worst) - 0.05, 0.0), 8) AS beyond_5, ROUND(GREATEST(1 - EXP(worst) - 0.10, 0.0), 8) AS beyond_10, worst_date FROM o")
def excursions(spark, sf_dir):
    return rounded(tg.adverse_excursions(panel.market(spark, sf_dir)))


def _outcome(h: int) -> str:
    """The rows of _horizon(h) as a subquery."""
    return f"({_horizon(h)} SELECT * FROM o)"


_DEV = f"""{_CASH}, one AS (SELECT signal_date, terminal_excess, is_negative FROM {_outcome(1)} AS q), four AS (SELECT signal_date, worst FROM {_outcome(4)} AS q),
j AS (SELECT w.signal_date, terminal_excess, is_negative, worst, LEAD(w.signal_date, 4) OVER (ORDER BY week) AS e FROM w LEFT JOIN one USING (signal_date) LEFT JOIN four USING (signal_date)),
dv AS (SELECT *, CASE WHEN signal_date >= DATE '2000-06-30' OR e >= DATE '2000-06-30' THEN 'withheld' WHEN terminal_excess IS NULL OR worst IS NULL THEN 'censored' ELSE 'available' END AS status FROM j)"""


@query("tgt_01_development_targets", f"{_DEV} SELECT signal_date, CASE WHEN status = 'available' THEN ROUND(terminal_excess, 8) END AS excess_1w, CASE WHEN status = 'available' THEN is_negative END AS is_negative, CASE WHEN status = 'available' THEN ROUND(worst, 8) END AS worst_4w, status FROM dv")
def development_targets(spark, sf_dir):
    return rounded(tg.development_targets(panel.market(spark, sf_dir), "2000-06-30"))


@query("val_20_contract_faults", f"{_DEV}, k AS (SELECT COUNT(*) AS n FROM dv WHERE signal_date < DATE '1996-01-01') SELECT 'feature_only' AS fault, 0::BIGINT AS n UNION ALL SELECT 'target_only', n FROM k UNION ALL SELECT 'shown_in_lockbox', 0 UNION ALL SELECT 'worst_above_0', 0")
def contract_faults(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    features = tg.weekly_decisions(m).where("signal_date >= DATE'1996-01-01'")
    return tg.contract_faults(features, tg.development_targets(m, "2000-06-30"), "2000-06-30")


_NAMES = f"""WITH {R.spine(R.SIZE_GROUP)}, {R.MARKET_BARS}, mr AS (SELECT date, idx, month_last, next_session, (1 + idx % 7) * 0.00001 AS rf FROM cal), mc AS (SELECT *, COALESCE(SUM(LN(1 + rf)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM mr),
g AS (SELECT date AS signal_date, idx + 1 AS a, LEAD(idx + 1) OVER (ORDER BY date) AS b FROM mc WHERE month_last AND next_session IS NOT NULL),
e AS (SELECT signal_date, x.sid, {R.ret('y.open', 'x.open')} - (EXP(q.cb - p.cb) - 1) AS excess FROM g JOIN mc p ON p.idx = a JOIN mc q ON q.idx = b JOIN spine x ON x.idx = a JOIN spine y ON y.idx = b AND y.sid = x.sid),
nt AS (SELECT signal_date, sid, excess, ({R.avg_rank('ROUND(excess, 10)', 'signal_date')}) / COUNT(excess) OVER (PARTITION BY signal_date) AS target_rank FROM e)""".replace(f"{R.ret('y.open', 'x.open')} -", f"({R.ret('y.open', 'x.open')}) -")


def _targets(spark, sf_dir):
    return tg.name_targets(panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)), panel.market(spark, sf_dir))


@query("tgt_07_name_targets", f"{_NAMES} SELECT signal_date, sid, ROUND(excess, 8) AS excess, ROUND(target_rank, 8) AS target_rank FROM nt")
def name_targets(spark, sf_dir):
    return rounded(_targets(spark, sf_dir))


@query("tgt_08_centered_targets", f"{_NAMES} SELECT signal_date, sid, CASE WHEN COUNT(excess) OVER (PARTITION BY signal_date) >= 2 THEN ROUND(2.0 * ({R.avg_rank('ROUND(excess, 10)', 'signal_date')} - 1) / (COUNT(excess) OVER (PARTITION BY signal_date) - 1) - 1, 8) END AS centered FROM nt")
def centered_targets(spark, sf_dir):
    t = _targets(spark, sf_dir).withColumn("excess", F.round("excess", 10))
    return t.select("signal_date", "sid", F.round(C.centered_rank(F.col("excess"), ["signal_date"]), 8).alias("centered"))


@query(
    "tgt_10_yearly_folds",
    f"""{_CASH}, l AS (SELECT *, LEAD(signal_date, 4) OVER (ORDER BY signal_date) AS le FROM w), y AS (SELECT DISTINCT YEAR(signal_date) AS outer_year FROM w WHERE YEAR(signal_date) >= 1997)
SELECT outer_year, COUNT(*) FILTER (WHERE YEAR(le) < outer_year) AS n_train, MAX(signal_date) FILTER (WHERE YEAR(le) < outer_year) AS train_last, COUNT(*) FILTER (WHERE YEAR(signal_date) = outer_year) AS n_test FROM l, y GROUP BY outer_year""",
)
def folds(spark, sf_dir):
    return tg.yearly_folds(tg.weekly_decisions(panel.market(spark, sf_dir)), 1997)


@query(
    "tgt_11_inner_folds",
    f"""{_CASH}, n AS (SELECT MAX(week) AS n FROM w), f AS (SELECT CAST(FLOOR((n - week) / 52) AS INT) AS fold, MIN(week) AS a, MIN(signal_date) AS validation_first, MAX(signal_date) AS validation_last, COUNT(*) AS size FROM w, n GROUP BY 1)
SELECT fold, validation_first, validation_last, GREATEST(a - 6, 0) AS n_train FROM f WHERE size = 52 AND fold < 5""",
)
def inner(spark, sf_dir):
    return tg.inner_folds(tg.weekly_decisions(panel.market(spark, sf_dir)))


# ---- portfolio paths: a monthly book of the two best of five names by 21-session reversal
_BOOK = f"""WITH {R.spine(R.SIZE_GROUP)}, f AS (SELECT date, idx, sid, month_last, next_session, ROUND(-({R.ret('close', R.lag('close', 21))}), 8) AS score FROM spine),
k AS (SELECT idx + 1 AS r, sid, ROW_NUMBER() OVER (PARTITION BY idx ORDER BY score DESC, sid) AS n FROM f WHERE month_last AND next_session IS NOT NULL AND score IS NOT NULL),
tg AS (SELECT r, sid, 0.4 AS weight FROM k WHERE n <= 2),
mr AS (SELECT date, idx, (1 + idx % 7) * 0.00001 AS rf FROM cal), mc AS (SELECT *, SUM(LN(1 + rf)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cash FROM mr),
mk AS (SELECT r, LEAD(r) OVER (ORDER BY r) AS nr FROM (SELECT DISTINCT r FROM tg) AS q),
dy AS (SELECT mc.date, mc.idx, cash, COALESCE(LAG(cash) OVER (ORDER BY mc.idx), 0.0) AS cb FROM mc),
dp AS (SELECT dy.*, r, nr FROM dy JOIN mk ON dy.idx >= r AND (nr IS NULL OR dy.idx < nr)),
h AS (SELECT tg.r, tg.sid, weight, open AS bought FROM tg JOIN spine ON spine.sid = tg.sid AND spine.idx = tg.r WHERE open > 0),
dl AS (SELECT h.r, h.sid, dp.idx, h.weight, bought, h.weight * COALESCE(LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY h.sid, h.r ORDER BY dp.idx ROWS UNBOUNDED PRECEDING), bought) / bought AS value FROM h JOIN dp ON dp.r = h.r JOIN spine ON spine.sid = h.sid AND spine.idx = dp.idx),
pd AS (SELECT dp.r, nr, cb AS cs, COALESCE((SELECT SUM(weight) FROM h WHERE h.r = dp.r), 0.0) AS s FROM dp WHERE idx = dp.r),
la AS (SELECT sid, r, ARG_MAX(value, idx) AS lv, MAX(weight) AS weight, MAX(bought) AS bought FROM dl GROUP BY sid, r),
en AS (SELECT la.sid, la.r, nr, CASE WHEN open > 0 THEN weight * open / bought ELSE lv END AS g FROM la JOIN pd USING (r) LEFT JOIN spine ON spine.sid = la.sid AND spine.idx = nr WHERE nr IS NOT NULL),
tt AS (SELECT pd.r, pd.nr, COALESCE((SELECT SUM(g) FROM en WHERE en.r = pd.r), 0.0) + (1 - s) * EXP(dy.cb - cs) AS total FROM pd JOIN dy ON dy.idx = pd.nr),
dr AS (SELECT en.sid, en.nr AS r, g / total AS was FROM en JOIN tt ON tt.r = en.r),
tu AS (SELECT r, SUM(ABS(COALESCE(weight, 0.0) - COALESCE(was, 0.0))) AS turnover FROM h FULL JOIN dr USING (sid, r) GROUP BY r),
st AS (SELECT pd.r, COALESCE(turnover, 0.0) AS turnover, COALESCE(tt.total, 1.0) AS total FROM pd LEFT JOIN tu USING (r) LEFT JOIN tt ON tt.nr = pd.r),"""


def _bs(cost: str) -> str:
    return f"""{_BOOK} bs AS (SELECT *, {cost} * turnover AS share, EXP(SUM(LN(total) + LN(1 - {cost} * turnover)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)) AS base FROM st),
nav AS (SELECT dp.date, dp.idx, base * (COALESCE(SUM(value), 0.0) + (1 - s) * EXP(dp.cash - cs)) AS nav FROM dp JOIN pd USING (r) JOIN bs USING (r) LEFT JOIN dl ON dl.idx = dp.idx AND dl.r = dp.r GROUP BY dp.date, dp.idx, base, s, dp.cash, cs)"""


def _targets_of_book(spine):
    score = F.round(-C.simple_return(F.col("close"), F.lag("close", 21).over(panel.by_name())), 8)
    scored = spine.select("date", "idx", "sid", "month_last", "next_session", score.alias("score")).where("month_last AND next_session IS NOT NULL AND score IS NOT NULL")
    return rk.rank_and_select(scored, 2).where("selected").select((F.col("idx") + 1).alias("execution_idx"), "sid", F.lit(0.4).alias("weight"))


def _book(spark, sf_dir, cost=0.0):
    spine = store.materialized(panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)))
    return po.book_values(_targets_of_book(spine), spine, store.materialized(panel.market(spark, sf_dir)), cost)


@query("sim_02_book_values", f"{_bs('0.001')} SELECT date, idx, ROUND(LN(nav), 7) AS log_nav FROM nav")
def book_values(spark, sf_dir):
    return _logged(_book(spark, sf_dir, 10.0)[0], "nav")


@query("sim_02_rebalances", f"{_bs('0.001')} SELECT r AS execution_idx, ROUND(turnover, 7) AS turnover, ROUND(LN(base / (1 - share)), 7) AS log_pretrade_nav, ROUND(share, 8) AS cost_share FROM bs")
def rebalances(spark, sf_dir):
    out = _book(spark, sf_dir, 10.0)[1]
    return out.select("execution_idx", F.round("turnover", 7).alias("turnover"), F.round(F.log("pretrade_nav"), 7).alias("log_pretrade_nav"), F.round("cost_share", 8).alias("cost_share"))


@query(
    "sim_03_cost_replay",
    f"""{_bs('0.0')}, c AS (SELECT UNNEST([0.0, 5.0, 20.0]::DOUBLE[]) AS cost_bps) SELECT cost_bps, date, idx, ROUND(LN(nav) + SUM(LN(1 - cost_bps / 1e4 * COALESCE(turnover, 0.0))) OVER (PARTITION BY cost_bps ORDER BY idx ROWS UNBOUNDED PRECEDING), 7) AS log_nav FROM nav CROSS JOIN c LEFT JOIN bs ON bs.r = idx""",
)
def cost_replay(spark, sf_dir):
    nav, steps = _book(spark, sf_dir)
    return _logged(po.replay_linear_cost(nav, steps, [0.0, 5.0, 20.0]), "nav")


@query("sim_34_holding_periods", f"{_bs('0.0')} SELECT r AS execution_idx, ROUND(LEAD(base) OVER (ORDER BY r) / base - 1, 7) AS period_return FROM bs")
def holding_periods(spark, sf_dir):
    return rounded(po.holding_periods(_book(spark, sf_dir)[1]), 7)


_DD = """, pk AS (SELECT *, MAX(v) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS peak FROM x), il AS (SELECT *, (v >= peak)::INT AS ip, SUM((v >= peak)::INT) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island, v / peak - 1 AS dd FROM pk),
sp AS (SELECT island, date AS peak_date, idx AS pi FROM il WHERE ip = 1), lo AS (SELECT island, ARG_MIN({'d': date, 'i': idx}, {'a': dd, 'b': idx}) AS low, MIN(dd) AS depth, MIN(date) FILTER (WHERE dd <= -0.05) AS first_5, MIN(date) FILTER (WHERE dd <= -0.10) AS first_10 FROM il WHERE ip = 0 GROUP BY island)
SELECT a.peak_date, low.d AS trough_date, b.peak_date AS recovery_date, ROUND(depth, 7) AS depth, low.i - a.pi AS decline, b.pi - low.i AS recovery, first_5, first_10 FROM lo JOIN sp a USING (island) LEFT JOIN sp b ON b.island = lo.island + 1"""


@query("sim_26_book_drawdowns", f"{_bs('0.0')}, x AS (SELECT date, idx, ROUND(nav, 9) AS v FROM nav) {_DD}")
def book_drawdowns(spark, sf_dir):
    nav = _book(spark, sf_dir)[0].withColumn("nav", F.round("nav", 9))
    return rounded(po.drawdown_episodes(nav), 7)


@query("sim_25_market_drawdowns", f"WITH {R.MARKET}, x AS (SELECT date, idx, ROUND(close, 6) AS v FROM m) {_DD}")
def market_drawdowns(spark, sf_dir):
    m = panel.market(spark, sf_dir).select("date", "idx", F.round("close", 6).alias("close"))
    return rounded(po.drawdown_episodes(m, "close"), 7)


@query("sim_28_fixed_mix", f"{SERIES} SELECT date, idx, ROUND(EXP(SUM(LN(1 + 0.02 * COALESCE(r, 0.0) + (1 - 0.02) * rf)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)), 7) AS nav FROM s")
def fixed(spark, sf_dir):
    return rounded(po.fixed_mix(series(spark, sf_dir), 0.02), 7)


@query("sim_29_same_volatility_mix", f"{SERIES}, v AS (SELECT LEAST(1.0, 0.01 / STDDEV_SAMP(r)) AS w FROM s) SELECT date, idx, ROUND(EXP(SUM(LN(1 + w * COALESCE(r, 0.0) + (1 - w) * rf)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)), 7) AS nav FROM s, v")
def same_volatility(spark, sf_dir):
    s = series(spark, sf_dir)
    w = s.agg(F.least(F.lit(1.0), 0.01 / F.stddev_samp("r")).alias("w"))
    return rounded(po.fixed_mix(s.crossJoin(F.broadcast(w)), F.col("w")), 7)


@query("sim_35_daily_fee", "SELECT a AS annual, ROUND((1 + a) ** (1.0 / 252) - 1, 12) AS daily FROM (SELECT UNNEST([0.0, 0.01, 0.05]::DOUBLE[]) AS a) AS q")
def daily_fee(spark, sf_dir):
    return spark.sql("SELECT explode(array(0.0D, 0.01D, 0.05D)) AS annual").select("annual", F.round(F.pow(1 + F.col("annual"), F.lit(1.0 / 252)) - 1, 12).alias("daily"))


_RISK = f"""{VOL}, wk AS (SELECT ROW_NUMBER() OVER (ORDER BY idx) AS week, CASE WHEN rv IS NULL THEN NULL ELSE rv > 2.9 END AS risk FROM v WHERE week_last),
sa AS (SELECT week, risk, CASE WHEN COALESCE(LAST_VALUE(risk IGNORE NULLS) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING), false) THEN 'DEFENSE' ELSE 'NORMAL' END AS state FROM wk),
sb AS (SELECT *, LAG(state) OVER (ORDER BY week) AS w FROM sa), sc AS (SELECT *, SUM((state IS DISTINCT FROM w)::INT) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING) AS run FROM sb)"""


@query("sim_21_defence_states", f"{_RISK} SELECT week, risk, state, CASE WHEN w IS NULL OR w = state THEN 'hold' ELSE w || '>' || state END AS transition, ROW_NUMBER() OVER (PARTITION BY run ORDER BY week) AS age FROM sc")
def defence_states(spark, sf_dir):
    weekly = volatility(spark, sf_dir).where("week_last").select(F.row_number().over(Window.orderBy("idx")).alias("week"), (F.col("rv") > 2.9).alias("risk"))
    return po.defence_states(weekly)


@query(
    "sim_23_reentry_states",
    f"""{VOL.replace('WITH', 'WITH RECURSIVE', 1)}, wk AS (SELECT ROW_NUMBER() OVER (ORDER BY idx) AS week, rv > 3.1 AS alert, close > before AS confirmed, rv < 2.8 AS calm FROM (SELECT *, LAG(close, 5) OVER (ORDER BY idx) AS before FROM v) AS q WHERE week_last AND rv IS NOT NULL),
st AS (SELECT 0::BIGINT AS week, 'ARMED' AS state UNION ALL SELECT wk.week, CASE WHEN state = 'ARMED' AND alert THEN 'DEFENSE' WHEN state = 'DEFENSE' AND confirmed THEN 'RECOVERY' WHEN state = 'RECOVERY' AND alert THEN 'DEFENSE' WHEN state = 'RECOVERY' AND calm THEN 'ARMED' ELSE state END FROM st JOIN wk ON wk.week = st.week + 1)
SELECT week::INT AS week, state FROM st WHERE week > 0""",
)
def reentry_states(spark, sf_dir):
    v = volatility(spark, sf_dir).withColumn("up", F.col("close") > F.lag("close", 5).over(Window.orderBy("idx"))).where("week_last AND rv IS NOT NULL")
    return po.reentry_states(v.select(F.row_number().over(Window.orderBy("idx")).alias("week"), (F.col("rv") > 3.1).alias("alert"), F.col("up").alias("confirmed"), (F.col("rv") < 2.8).alias("calm")))


# ---- performance
_SUM = """dd AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY k ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS nav FROM rr WHERE r IS NOT NULL), de AS (SELECT *, nav / GREATEST(1.0, MAX(nav) OVER (PARTITION BY k ORDER BY idx ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM dd)"""


@query(
    "agg_01_summary",
    f"""{SERIES}, rr AS (SELECT YEAR(date) AS k, idx, r / 100 AS r, rf FROM s), {_SUM}, isl AS (SELECT k, dd, SUM(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY idx ROWS UNBOUNDED PRECEDING) AS i FROM de),
lu AS (SELECT k, MAX(n) AS longest_underwater FROM (SELECT k, i, SUM((dd < 0)::INT)::BIGINT AS n FROM isl GROUP BY k, i) AS q GROUP BY k)
SELECT k AS year, COUNT(*) AS observations, ROUND(EXP(SUM(LN(1 + r))) - 1, 6) AS total_return, ROUND(EXP(SUM(LN(1 + r)) * 252 / COUNT(*)) - 1, 6) AS cagr, ROUND(STDDEV_SAMP(r) * SQRT(252), 6) AS volatility, ROUND(AVG(r) / STDDEV_SAMP(r) * SQRT(252), 6) AS sharpe_0,
  ROUND(AVG(r - rf) / STDDEV_SAMP(r - rf) * SQRT(252), 6) AS sharpe_rf, ROUND(AVG(r) * SQRT(252) / SQRT(AVG(CASE WHEN r < 0 THEN r * r ELSE 0.0 END)), 6) AS sortino, ROUND(MIN(dd), 6) AS max_drawdown, ROUND((EXP(SUM(LN(1 + r)) * 252 / COUNT(*)) - 1) / ABS(MIN(dd)), 5) AS calmar, ANY_VALUE(longest_underwater) AS longest_underwater
FROM de JOIN lu USING (k) GROUP BY k""",
)
def summary(spark, sf_dir):
    s = series(spark, sf_dir).select(F.year("date").alias("year"), "idx", (F.col("r") / 100).alias("r"), "rf")
    return rounded(pf.summary(s, ["year"]), 6).withColumn("calmar", F.round("calmar", 5))


_REL = f"""{SERIES}, rr AS (SELECT YEAR(date) AS k, idx, r / 10 AS r, LAG(r) OVER (ORDER BY idx) / 20 AS b FROM s), rc AS (SELECT * FROM rr WHERE r IS NOT NULL AND b IS NOT NULL)"""


@query(
    "agg_04_relative",
    f"""{_REL} SELECT k AS year, COUNT(*) AS observations, ROUND(AVG(r - b) * 252, 6) AS excess, ROUND(EXP((SUM(LN(1 + r)) - SUM(LN(1 + b))) * 252 / COUNT(*)) - 1, 6) AS geometric_excess, ROUND(COVAR_SAMP(r, b) / VAR_SAMP(b), 6) AS beta,
  ROUND((AVG(r) - COVAR_SAMP(r, b) / VAR_SAMP(b) * AVG(b)) * 252, 6) AS alpha, ROUND(STDDEV_SAMP(r - b) * SQRT(252), 6) AS tracking_error, ROUND(AVG(r - b) / STDDEV_SAMP(r - b) * SQRT(252), 6) AS information_ratio FROM rc GROUP BY k""",
)
def relative(spark, sf_dir):
    s = series(spark, sf_dir).select(F.year("date").alias("year"), (F.col("r") / 10).alias("r"), (F.lag("r").over(Window.orderBy("idx")) / 20).alias("b"))
    return rounded(pf.relative(s, ["year"]), 6)


@query(
    "agg_06_risk_profile",
    f"""{SERIES}, rr AS (SELECT 0 AS k, idx, r / 10 AS r FROM s), {_SUM}, c AS (SELECT QUANTILE_CONT(r, 0.05) AS q, QUANTILE_CONT(dd, 0.05) AS dq FROM de)
SELECT ROUND(SQRT(AVG(dd * dd)), 7) AS ulcer, ROUND(AVG(ABS(dd)), 7) AS pain, ROUND(AVG((dd < 0)::INT), 7) AS underwater_share, ROUND(MAX(q), 7) AS var_95, ROUND(AVG(r) FILTER (WHERE r <= q), 7) AS es_95, ROUND(AVG(dd) FILTER (WHERE dd <= dq), 7) AS cdar_95,
  ROUND(MIN(r), 7) AS worst_day, ROUND(MAX(r), 7) AS best_day, ROUND(SKEWNESS(r), 5) AS skewness, ROUND(KURTOSIS(r), 5) AS kurtosis, ROUND(AVG((r > 0)::INT), 7) AS hit_rate FROM de, c""",
)
def risk_profile(spark, sf_dir):
    out = pf.risk_profile(series(spark, sf_dir).select("idx", (F.col("r") / 10).alias("r")))
    return rounded(out, 7).withColumns({"skewness": F.round("skewness", 5), "kurtosis": F.round("kurtosis", 5)})


@query("agg_39_annual_returns", f"{SERIES} SELECT YEAR(date) AS year, COUNT(r) AS n, ROUND(EXP(SUM(LN(1 + r / 100))) - 1, 7) AS annual_return FROM s WHERE r IS NOT NULL GROUP BY 1")
def annual(spark, sf_dir):
    return rounded(pf.annual_returns(series(spark, sf_dir).withColumn("r", F.col("r") / 100)), 7)


@query(
    "agg_15_by_state",
    f"""{VOL}, t AS (SELECT idx, r, CASE WHEN rv IS NULL THEN NULL WHEN rv > 2.9 THEN 'high' ELSE 'low' END AS state FROM v), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY r, idx) <= CEIL(0.1 * COUNT(*) OVER (PARTITION BY state)) AS tail FROM t WHERE r IS NOT NULL AND state IS NOT NULL)
SELECT state, COUNT(*) AS n, ROUND(AVG(r), 8) AS mean, ROUND(MEDIAN(r), 8) AS median, ROUND(AVG((r > 0)::INT), 8) AS win_rate, ROUND(AVG(r) FILTER (WHERE tail), 8) AS es_10, ROUND(MIN(r), 8) AS worst FROM o GROUP BY state""",
)
def by_state(spark, sf_dir):
    v = volatility(spark, sf_dir).withColumn("state", F.when(F.col("rv") > 2.9, "high").when(F.col("rv").isNotNull(), "low"))
    return rounded(pf.by_state(v))


@query(
    "agg_31_interaction",
    f"""{VOL}, t AS (SELECT rv > 2.9 AS a, idx % 2 = 0 AS b, r FROM v WHERE rv IS NOT NULL)
SELECT ROUND(AVG(r) FILTER (WHERE a AND b) - AVG(r) FILTER (WHERE a AND NOT b) - AVG(r) FILTER (WHERE NOT a AND b) + AVG(r) FILTER (WHERE NOT a AND NOT b), 8) AS contrast, COUNT(r) AS n FROM t""",
)
def interaction(spark, sf_dir):
    v = volatility(spark, sf_dir).where("rv IS NOT NULL").select((F.col("rv") > 2.9).alias("a"), (F.col("idx") % 2 == 0).alias("b"), "r")
    return rounded(pf.interaction(v, "a", "b", "r"))


@query(
    "agg_33_leave_one_year_out",
    f"""{SERIES}, y AS (SELECT YEAR(date) AS y, SUM(r) AS s, COUNT(r) AS n FROM s WHERE r IS NOT NULL GROUP BY 1)
SELECT y AS left_out, ROUND((SUM(s) OVER () - s) / (SUM(n) OVER () - n), 8) AS mean, SIGN((SUM(s) OVER () - s)) = SIGN(SUM(s) OVER ()) AS same_sign FROM y""",
)
def leave_out(spark, sf_dir):
    return rounded(pf.leave_one_year_out(series(spark, sf_dir), "r"))


_AUDIT = f"""WITH {R.spine()}, a AS (SELECT date, sid, month_last, COALESCE(close > 0, false) AS c0, COALESCE({R.lag('close', 21)} > 0, false) AS c21, COALESCE({R.lag('close', 255)} > 0, false) AS c255, COALESCE(LEAD(open) OVER (PARTITION BY sid ORDER BY idx) > 0, false) AS nx FROM spine),
au AS (SELECT date, sid, c0 AND c21 AS has_21, c0 AND c255 AS has_255, nx AS has_next_open, NULLIF(CONCAT_WS('|', CASE WHEN NOT c0 THEN 'no_close' END, CASE WHEN NOT c21 THEN 'no_close_21' END, CASE WHEN NOT c255 THEN 'no_close_255' END, CASE WHEN NOT nx THEN 'no_next_open' END), '') AS exclusion_reason FROM a WHERE month_last)"""


@query("agg_17_universe_audit", f"{_AUDIT} SELECT * FROM au")
def audit(spark, sf_dir):
    return pf.universe_audit(panel.spine(panel.prices(spark, sf_dir)))


@query("agg_18_audit_summary", f"{_AUDIT} SELECT date, COUNT(*) AS n, SUM(has_21::INT)::BIGINT AS n_21, ROUND(AVG(has_21::INT), 8) AS rate_21, ROUND(AVG(has_255::INT), 8) AS rate_255, ROUND(AVG(has_next_open::INT), 8) AS rate_next_open FROM au GROUP BY date")
def audit_summary(spark, sf_dir):
    return rounded(pf.audit_summary(audit(spark, sf_dir)))


_IC = f"""WITH {R.spine()}, p AS (SELECT date, idx, sid, month_last, ROUND({R.ret('close', R.lag('close', 21))}, 8) AS score FROM spine), q AS (SELECT *, ROUND({R.ret('LEAD(close) OVER (PARTITION BY sid ORDER BY idx)', 'close')}, 8) AS target FROM (SELECT spine.date, spine.idx, spine.sid, close FROM spine WHERE month_last) AS e),
b AS (SELECT date, sid, score, target FROM p JOIN q USING (date, sid) WHERE score IS NOT NULL AND target IS NOT NULL), k AS (SELECT date, {R.avg_rank('score', 'date')} AS a, {R.avg_rank('target', 'date')} AS b FROM b),
ic AS (SELECT date, COUNT(*) AS n, CORR(a, b) AS ic FROM k GROUP BY date HAVING COUNT(*) >= 3)"""


def _ic(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    score = spine.select("date", "sid", "month_last", F.round(C.simple_return(F.col("close"), F.lag("close", 21).over(panel.by_name())), 8).alias("score")).where("month_last")
    ends = spine.where("month_last").select("date", "sid", F.round(C.simple_return(F.lead("close").over(panel.by_name()), F.col("close")), 8).alias("target"))
    return pf.rank_ic(score.join(ends, ["date", "sid"]), "score", "target")


@query("agg_51_rank_ic", f"{_IC} SELECT date, n, CASE WHEN NOT isnan(ic) THEN ROUND(ic, 7) END AS ic FROM ic")
def ic(spark, sf_dir):
    return rounded(_ic(spark, sf_dir), 7)


@query("agg_51_ic_summary", f"{_IC} SELECT COUNT(*) AS n_dates, ROUND(MEDIAN(ic), 7) AS median_ic, ROUND(AVG(ic), 7) AS mean_ic, ROUND(AVG((ic > 0)::INT), 7) AS positive_share FROM ic WHERE NOT isnan(ic)")
def ic_summary(spark, sf_dir):
    return rounded(pf.ic_summary(_ic(spark, sf_dir)), 7)


@query(
    "agg_48_alert_quality",
    f"""{VOL}, t AS (SELECT ROUND(rv, 9) AS rv, LEAD(r) OVER (ORDER BY idx) < -0.1 AS y FROM v), u AS (SELECT * FROM t WHERE rv IS NOT NULL AND y IS NOT NULL), c AS (SELECT QUANTILE_CONT(rv, 0.75) AS cut FROM u)
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE rv > cut) AS n_alerts, ROUND(COUNT(*) FILTER (WHERE rv > cut AND y) / COUNT(*) FILTER (WHERE rv > cut), 8) AS precision, ROUND(COUNT(*) FILTER (WHERE rv > cut AND y) / COUNT(*) FILTER (WHERE y), 8) AS recall,
  ROUND(COUNT(*) FILTER (WHERE rv > cut AND y) * COUNT(*) / (COUNT(*) FILTER (WHERE rv > cut) * COUNT(*) FILTER (WHERE y)), 8) AS lift FROM u, c""",
)
def alert_quality(spark, sf_dir):
    v = volatility(spark, sf_dir).select(F.round("rv", 9).alias("rv"), (F.lead("r").over(Window.orderBy("idx")) < -0.1).alias("y"))
    return rounded(pf.alert_quality(v, "rv", "y"))
