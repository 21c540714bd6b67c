"""Paths side by side, gates, entities and further facts (SIM, AGG, JON, FUN, MOD, PIT, TGT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import calendar as cal
from chronopanel.operators import comparison as cp
from chronopanel.operators import entities as en
from chronopanel.operators import fundamentals as fu
from chronopanel.operators import performance as pf
from chronopanel.operators import point_in_time as pit
from chronopanel.operators import portfolio as po
from chronopanel.operators import ranking as rk
from chronopanel.operators import regimes as rg
from chronopanel.plans import registry as R
from chronopanel.plans.factor_plans import _LONG, _long
from chronopanel.plans.inference_plans import _DB, _SO, _database, _so
from chronopanel.plans.pit_plans import INTERVALS, intervals
from chronopanel.plans.portfolio_plans import _bs, rounded
from chronopanel.plans.regime_plans import _FC, _STATE, SERIES, VOL, series, states, volatility
from chronopanel.plans.registry import query
from chronopanel.sources import panel, store

_MOM = f"{_LONG}, {INTERVALS}, mb AS (SELECT date, sid FROM cal JOIN iv ON effective_from <= date AND (effective_to IS NULL OR date < effective_to) WHERE month_last), sc AS (SELECT date, sid, score FROM long JOIN mb USING (date, sid) WHERE factor_id = 'reversal_21' AND score IS NOT NULL)"


def _members(spark, sf_dir):
    months = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").where("month_last").select("date")
    return pit.members_on(intervals(spark, sf_dir), months)


@query(
    "rnk_03_scheduled_targets",
    f"""{_MOM}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC, sid) AS rank, COUNT(*) OVER (PARTITION BY date) AS n FROM sc)
SELECT date AS signal_date, next_session AS execution_date, sid, ROUND(1.0 / LEAST(5, n), 10) AS weight, n < 5 AS is_short FROM k JOIN cal USING (date) WHERE rank <= 5 AND next_session IS NOT NULL""",
)
def scheduled_targets(spark, sf_dir):
    calendar = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate")
    scores = _long(spark, sf_dir).where("factor_id = 'reversal_21'").select(F.col("date").alias("signal_date"), "sid", "score")
    return rounded(cp.scheduled_targets(cal.rebalance_schedule(calendar, "monthly"), _members(spark, sf_dir), scores, 5), 10)


@query(
    "rnk_05_target_faults",
    f"""{_MOM}, t AS (SELECT date, sid FROM long WHERE factor_id = 'reversal_21' AND score IS NOT NULL UNION ALL SELECT date, sid FROM long WHERE factor_id = 'reversal_21' AND score IS NOT NULL AND sid LIKE '%5'),
f AS (SELECT t.date AS signal_date, t.sid, CASE WHEN COUNT(*) OVER (PARTITION BY t.date, t.sid) > 1 THEN 'repeated' WHEN mb.sid IS NULL THEN 'not_a_member' END AS fault FROM t LEFT JOIN mb USING (date, sid)) SELECT * FROM f WHERE fault IS NOT NULL""",
)
def target_faults(spark, sf_dir):
    t = _long(spark, sf_dir).where("factor_id = 'reversal_21' AND score IS NOT NULL").select(F.col("date").alias("signal_date"), "sid", F.lit(0.1).alias("weight"))
    return cp.target_faults(t.unionByName(t.where("sid LIKE '%5'")), _members(spark, sf_dir))


def _grid(spark, sf_dir):
    """Books of the one, two and three best of five names, as one grid of paths."""
    spine = store.materialized(panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)))
    score = F.round(-C.simple_return(F.col("close"), F.lag("close", 21).over(panel.by_name())), 8)
    scored = spine.select("date", "idx", "sid", "month_last", "next_session", score.alias("score")).where("month_last AND next_session IS NOT NULL AND score IS NOT NULL")
    widths = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    targets = rk.rank_and_select(scored, 3).where("selected").withColumn("width", widths).where("rank <= width").select("width", (F.col("idx") + 1).alias("execution_idx"), "sid", (F.lit(0.9) / F.col("width")).alias("weight"))
    return po.book_values(targets, spine, store.materialized(panel.market(spark, sf_dir)), 0.0, ["width"])


def _width(k: int) -> str:
    """Ends of the path of the k best, for each cost."""
    book = _bs("0.0").replace("0.4 AS weight FROM k WHERE n <= 2", f"0.9::DOUBLE / {k} AS weight FROM k WHERE n <= {k}")
    paths = f"{book}, c AS (SELECT UNNEST([0.0, 10.0]::DOUBLE[]) AS cost_bps) SELECT cost_bps, idx, LN(nav) + SUM(LN(1 - cost_bps / 1e4 * COALESCE(turnover, 0.0))) OVER (PARTITION BY cost_bps ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ln FROM nav CROSS JOIN c LEFT JOIN bs ON bs.r = idx"
    return f"SELECT {k} AS width, cost_bps, COUNT(*) AS n, ROUND(ARG_MAX(ln, idx), 7) AS log_final FROM ({paths}) AS p GROUP BY cost_bps"


@query("sim_36_path_grid", " UNION ALL ".join(map(_width, (1, 2, 3))))
def grid(spark, sf_dir):
    nav, steps = _grid(spark, sf_dir)
    out = po.replay_linear_cost(nav, steps, [0.0, 10.0], ["width"])
    return out.groupBy("width", "cost_bps").agg(F.count("*").alias("n"), F.round(F.log(F.max_by("nav", "idx")), 7).alias("log_final"))


# ---- overlays on the market series: full exposure when calm, a third when not
_OV = f"{_STATE}, ov AS (SELECT date, idx, r / 100 AS r, rf, CASE WHEN is_high THEN 0.3 ELSE 1.0 END AS exposure FROM h WHERE r IS NOT NULL)"


def _overlay(spark, sf_dir):
    s = states(spark, sf_dir).where("r IS NOT NULL")
    return s.select("date", "idx", (F.col("r") / 100).alias("r"), "rf", F.when(F.col("is_high"), 0.3).otherwise(1.0).alias("exposure"))


@query("win_06_regime_chain", f"{_STATE} SELECT date, ROUND(pct, 8) AS pct, is_high, CASE WHEN is_high THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS allocation FROM h WHERE week_last")
def regime_chain(spark, sf_dir):
    return states(spark, sf_dir).where("week_last").select("date", F.round("pct", 8).alias("pct"), "is_high", F.when(F.col("is_high"), 0.0).otherwise(1.0).alias("allocation"))


@query("agg_10_overlay_decomposition", f"{_OV} SELECT CAST(YEAR(date) AS INT) AS year, ROUND(SUM(GREATEST(-(1 - exposure) * r, 0.0)), 8) AS defence_benefit, ROUND(SUM(GREATEST((1 - exposure) * r, 0.0)), 8) AS missed_upside, ROUND(SUM(-(1 - exposure) * r), 8) AS net, ROUND(AVG(exposure), 8) AS mean_exposure FROM ov GROUP BY 1")
def decomposition(spark, sf_dir):
    return rounded(cp.overlay_decomposition(_overlay(spark, sf_dir).withColumn("year", F.year("date")), ["year"]))


_PATHS = f"{_OV}, pa AS (SELECT date, idx, EXP(SUM(LN(1 + exposure * r + (1 - exposure) * rf)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS nav FROM ov), pb AS (SELECT date, idx, EXP(SUM(LN(1 + 0.6 * r + 0.4 * rf)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS nav FROM ov), rl AS (SELECT pa.date, idx, LN(pa.nav) - LN(pb.nav) AS log_ratio FROM pa JOIN pb USING (idx))"


def _relative(spark, sf_dir):
    o = _overlay(spark, sf_dir)
    return cp.relative_path(po.fixed_mix(o, F.col("exposure")), po.fixed_mix(o, 0.6))


@query("agg_14_relative_path", f"{_PATHS} SELECT date, idx, ROUND(log_ratio, 8) AS log_ratio, ROUND(log_ratio - COALESCE(LAG(log_ratio) OVER (ORDER BY idx), 0.0), 8) AS change FROM rl")
def relative_path(spark, sf_dir):
    return rounded(_relative(spark, sf_dir))


_EPI = "ep AS (SELECT UNNEST([1, 2]) AS episode, UNNEST([DATE '1996-06-01', DATE '1999-01-01']) AS first, UNNEST([DATE '1997-05-31', DATE '2000-06-30']) AS last)"


def _episodes(spark):
    return spark.sql("SELECT * FROM VALUES (1, DATE'1996-06-01', DATE'1997-05-31'), (2, DATE'1999-01-01', DATE'2000-06-30') AS t(episode, first, last)")


@query("agg_26_worst_relative_fall", f"{_PATHS}, {_EPI}, f AS (SELECT episode, log_ratio - MAX(log_ratio) OVER (PARTITION BY episode ORDER BY idx ROWS UNBOUNDED PRECEDING) AS fall FROM rl JOIN ep ON date BETWEEN first AND last) SELECT episode, ROUND(EXP(MIN(fall)) - 1, 8) AS worst FROM f GROUP BY episode")
def worst_fall(spark, sf_dir):
    return rounded(cp.worst_relative_fall(_relative(spark, sf_dir), _episodes(spark)))


_TWO = f"{_OV}, tw AS (SELECT YEAR(date)::INT AS year, 'overlay' AS path, exposure * r + (1 - exposure) * rf AS x FROM ov UNION ALL SELECT YEAR(date)::INT, 'naked', r FROM ov), ag AS (SELECT year, path, AVG(x) * 252 AS mean, STDDEV_SAMP(x) * SQRT(252) AS vol FROM tw GROUP BY year, path)"


@query("agg_07_side_by_side", f"{_TWO} SELECT a.year, ROUND(a.mean, 7) AS overlay_mean, ROUND(a.vol, 7) AS overlay_vol, ROUND(b.mean, 7) AS naked_mean, ROUND(b.vol, 7) AS naked_vol, ROUND(a.mean - b.mean, 7) AS delta_mean, ROUND(a.vol - b.vol, 7) AS delta_vol FROM ag a JOIN ag b USING (year) WHERE a.path = 'overlay' AND b.path = 'naked'")
def side_by_side(spark, sf_dir):
    o = _overlay(spark, sf_dir).withColumn("overlay", F.col("exposure") * F.col("r") + (1 - F.col("exposure")) * F.col("rf"))
    long = o.select(F.year("date").alias("year"), "overlay", F.col("r").alias("naked")).unpivot(["year"], ["overlay", "naked"], "path", "x")
    metrics = long.groupBy("year", "path").agg((F.avg("x") * 252).alias("mean"), (F.stddev_samp("x") * 252**0.5).alias("vol"))
    return rounded(cp.side_by_side(metrics, "path", ["overlay", "naked"], ["mean", "vol"], ["year"]), 7)


@query("agg_35_gates", f"{_TWO}, w AS (SELECT a.year, a.mean - b.mean AS dm, a.vol - b.vol AS dv FROM ag a JOIN ag b USING (year) WHERE a.path = 'overlay' AND b.path = 'naked') SELECT year, 'calmer' AS gate, dv < -0.01 AS passes FROM w UNION ALL SELECT year, 'richer', dm > 0 FROM w")
def gates(spark, sf_dir):
    return cp.gates(side_by_side(spark, sf_dir), {"calmer": "delta_vol < -0.01", "richer": "delta_mean > 0"}, ["year"])


@query("agg_30_year_concentration", f"{SERIES}, y AS (SELECT YEAR(date) AS y, SUM(r) AS s FROM s WHERE r IS NOT NULL GROUP BY 1) SELECT ROUND(SUM(s), 8) AS total, ROUND(MAX(ABS(s)) / SUM(ABS(s)), 8) AS largest_share FROM y")
def concentration(spark, sf_dir):
    return rounded(cp.year_concentration(series(spark, sf_dir), "r"))


@query("agg_42_loss_concentration", f"{SERIES}, l AS (SELECT r, ROW_NUMBER() OVER (ORDER BY r, idx) <= CEIL(0.05 * COUNT(*) OVER ()) AS w FROM s WHERE r < 0) SELECT COUNT(*) AS n, SUM(w::INT)::BIGINT AS n_worst, ROUND(SUM(r) FILTER (WHERE w) / SUM(r), 8) AS share_of_losses FROM l")
def losses(spark, sf_dir):
    return rounded(cp.loss_concentration(series(spark, sf_dir), "r", 0.05))


@query("agg_41_threshold_sensitivity", f"{_SO}, t AS (SELECT UNNEST([2.5, 2.8, 3.1]::DOUBLE[]) AS threshold) SELECT threshold, COUNT(*) FILTER (WHERE score > threshold) AS n_alerts, ROUND(AVG(y::INT) FILTER (WHERE score > threshold), 8) AS hit_rate, ROUND(AVG(y::INT), 8) AS base_rate FROM sh, t GROUP BY threshold")
def sensitivity(spark, sf_dir):
    return rounded(cp.threshold_sensitivity(_so(spark, sf_dir), "score", "y", [2.5, 2.8, 3.1]))


@query("pit_24_leave_one_event", f"{_SO}, {_EPI}, sp AS (SELECT score, x, date AS first, CAST(date + 7 AS DATE) AS last FROM sh), k AS (SELECT episode, score, x FROM sp JOIN ep ON sp.last < ep.first OR sp.first > ep.last), r AS (SELECT episode, {R.avg_rank('score', 'episode')} AS a, {R.avg_rank('x', 'episode')} AS b FROM k) SELECT episode, COUNT(*) AS n, ROUND(CORR(a, b), 8) AS spearman FROM r GROUP BY episode")
def leave_event(spark, sf_dir):
    from chronopanel.operators import inference as inf

    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").select("score", "x", F.col("date").alias("first"), F.date_add("date", 7).alias("last"))
    return rounded(inf.spearman(cp.without_overlap(rows, _episodes(spark)), "score", "x", ["episode"]))


@query("pit_19_event_anchors", f"{_EPI.replace('ep AS', 'WITH ep AS')}, {R.MARKET}, w AS (SELECT date FROM m WHERE week_last) SELECT episode, first, (SELECT MAX(date) FROM w WHERE date <= first) AS anchor FROM ep")
def anchors(spark, sf_dir):
    weeks = panel.market(spark, sf_dir).where("week_last").select("date")
    e = _episodes(spark)
    return e.join(F.broadcast(weeks), F.col("date") <= F.col("first"), "left").groupBy("episode", "first").agg(F.max("date").alias("anchor"))


@query("win_21_forecast_target", f"{_FC}, a AS (SELECT MIN(date) AS t FROM f WHERE persistence > 0 AND ewma > 0) SELECT f.date, CASE WHEN f.date < t THEN 1.0 ELSE ROUND(LEAST(1.0, 2.5 / ewma), 8) END AS allocation FROM f JOIN s USING (date), a WHERE week_last")
def forecast_target(spark, sf_dir):
    s = series(spark, sf_dir)
    f = rg.volatility_forecasts(s).join(s.select("date", "week_last"), "date")
    start = f.where("persistence > 0 AND ewma > 0").agg(F.min("date").alias("t"))
    made = F.when(F.col("date") < F.col("t"), 1.0).otherwise(F.round(rg.volatility_target(F.col("ewma"), 2.5), 8))
    return f.crossJoin(F.broadcast(start)).where("week_last").select("date", made.alias("allocation"))


@query("win_10_forecast_quartile", f"{_FC}, q AS (SELECT date, ewma, COUNT(ewma) OVER w AS n, {', '.join(f'QUANTILE_CONT(ewma, {p}) OVER w AS q{i}' for i, p in enumerate((0.25, 0.5, 0.75)))} FROM f WINDOW w AS (ORDER BY idx ROWS BETWEEN 756 PRECEDING AND 1 PRECEDING)) SELECT date, CASE WHEN ewma IS NOT NULL AND n = 756 THEN CASE WHEN ewma <= q0 THEN 1 WHEN ewma <= q1 THEN 2 WHEN ewma <= q2 THEN 3 ELSE 4 END END AS quartile FROM q")
def forecast_quartile(spark, sf_dir):
    f = rg.volatility_forecasts(series(spark, sf_dir))
    return f.select("date", rg.lagged_quartile(F.col("ewma"), 756).alias("quartile"))


@query("win_34_attack_scores", f"{VOL}, w AS (SELECT date, idx, rv FROM v WHERE week_last) SELECT date, ROUND(-rv, 8) AS level, ROUND(LAG(rv, 4) OVER (ORDER BY idx) - rv, 8) AS fall_4w FROM w")
def attack(spark, sf_dir):
    w = volatility(spark, sf_dir).where("week_last")
    return w.select("date", F.round(-F.col("rv"), 8).alias("level"), F.round(F.lag("rv", 4).over(Window.orderBy("idx")) - F.col("rv"), 8).alias("fall_4w"))


@query("tgt_06_label_autocorrelation", f"{_SO}, l AS (SELECT YEAR(date)::INT AS year, x, LAG(x) OVER (ORDER BY idx) AS b FROM sh) SELECT year, COUNT(*) AS n, ROUND(CORR(x, b), 8) AS autocorrelation FROM l GROUP BY year")
def autocorrelation(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").withColumn("b", F.lag("x").over(Window.orderBy("idx")))
    return rounded(rows.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.corr("x", "b").alias("autocorrelation")))


# ---- facts
_GP = """gf AS (SELECT o_custkey AS entity, YEAR(o_orderdate)::INT AS fiscal_year, ['revenue', 'cost', 'gross_profit'][o_orderkey % 3 + 1] AS metric_id, o_orderkey % 2 + 1 AS rank, ROUND(o_totalprice / 100000) AS value FROM orders),
su AS (SELECT entity, fiscal_year, metric_id, rank, MAX(value) AS value FROM gf GROUP BY 1, 2, 3, 4 HAVING COUNT(DISTINCT value) = 1),
al AS (SELECT a.entity, a.fiscal_year, a.value AS revenue, a.rank AS r1, c.value AS gross_profit, c.rank AS r3, b.value AS cost, b.rank AS r2 FROM su a JOIN su c ON c.entity = a.entity AND c.fiscal_year = a.fiscal_year AND c.metric_id = 'gross_profit' LEFT JOIN su b ON b.entity = a.entity AND b.fiscal_year = a.fiscal_year AND b.metric_id = 'cost' WHERE a.metric_id = 'revenue'),
mk AS (SELECT *, COALESCE(ABS(revenue - cost - gross_profit) <= GREATEST(1.0, 1e-6 * GREATEST(ABS(revenue), ABS(cost), ABS(gross_profit))), false) AS fits FROM al)"""


@query("fun_02_gross_profit_identity", f"WITH {_GP}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, fiscal_year ORDER BY fits DESC, r1, r2 NULLS LAST, r3) AS n FROM mk) SELECT entity, fiscal_year, revenue, CASE WHEN fits THEN cost ELSE GREATEST(0.0, revenue - gross_profit) END AS cost, gross_profit, CASE WHEN fits THEN 'reported' ELSE 'derived_cost' END AS status FROM k WHERE n = 1")
def identity_selection(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    kinds = F.array(F.lit("revenue"), F.lit("cost"), F.lit("gross_profit"))
    facts = o.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fiscal_year"), F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("metric_id"), (F.col("o_orderkey") % 2 + 1).alias("rank"), F.round(F.col("o_totalprice") / 100000).alias("value"))
    return fu.gross_profit_identity(facts)


_ME = """me AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS measured, CAST(o_orderdate + (o_orderkey % 5) * INTERVAL 1 DAY AS DATE) AS available, o_totalprice AS market_equity, o_orderkey % 4 <> 0 AS is_audited FROM orders), sg AS (SELECT UNNEST([DATE '1997-06-30', DATE '1998-12-31', DATE '2000-06-30']) AS signal_date),
la AS (SELECT signal_date, entity, MAX_BY({'m': measured, 'v': market_equity, 'a': is_audited}, {'m': measured, 'd': available, 'v': market_equity}) AS x FROM me JOIN sg ON measured <= signal_date AND available <= signal_date GROUP BY ALL),
eq AS (SELECT signal_date, entity, CASE WHEN signal_date - x.m > 90 THEN 'stale' WHEN NOT x.a THEN 'share_classes_not_audited' WHEN x.v <= 0 THEN 'nonpositive' END AS reason, x.v AS v FROM la)"""


def _equity(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    equity = o.select(F.col("o_custkey").alias("entity"), day.alias("measured"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("available"), F.col("o_totalprice").alias("market_equity"), (F.col("o_orderkey") % 4 != 0).alias("is_audited"))
    signals = spark.sql("SELECT explode(array(DATE'1997-06-30', DATE'1998-12-31', DATE'2000-06-30')) AS signal_date")
    return fu.market_equity_as_of(equity, signals, 90), signals


@query("pit_14_market_equity", f"WITH {_ME} SELECT signal_date, entity, CASE WHEN reason IS NULL THEN v END AS market_equity, reason FROM eq")
def market_equity(spark, sf_dir):
    return _equity(spark, sf_dir)[0]


@query("fun_12_book_to_market", f"WITH {_ME}, fi AS (SELECT signal_date, c_custkey AS entity, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS book FROM customer, sg), j AS (SELECT fi.*, v, CASE WHEN book IS NULL THEN 'missing_metric:book' WHEN eq.entity IS NULL THEN 'no_measurement' ELSE reason END AS why FROM fi LEFT JOIN eq USING (signal_date, entity)) SELECT signal_date, entity, CASE WHEN why IS NULL THEN ROUND(book / v, 8) END AS value, why AS reason FROM j")
def book_to_market(spark, sf_dir):
    equity, signals = _equity(spark, sf_dir)
    filings = panel.table(spark, sf_dir, "customer").crossJoin(F.broadcast(signals)).select("signal_date", F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("book"))
    return rounded(fu.ratio_to_equity(filings, equity, "book"))


@query("fun_17_readiness", f"{_DB}, d AS (SELECT factor_id, signal_date, COUNT(*) AS n, SUM(eligible::INT) AS e FROM fd GROUP BY 1, 2), w AS (SELECT factor_id, SUM(e) / SUM(n) AS c, COUNT(*) FILTER (WHERE e >= 5) AS k FROM d GROUP BY 1) SELECT factor_id, ROUND(c, 8) AS coverage, k AS n_covered_dates, CASE WHEN c < 0.34 THEN 'low_coverage' WHEN k < 60 THEN 'too_few_dates' ELSE 'ready' END AS status FROM w")
def readiness(spark, sf_dir):
    return rounded(fu.readiness(_database(spark, sf_dir), 0.34, 5, 60))


# ---- entities
_NORM = "lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"


_TOKENS = "string_split({}, ' ')"


@query(
    "jon_08_name_candidates",
    f"""WITH a AS (SELECT s_suppkey AS sid, {_NORM.format('s_name')} AS a FROM supplier), b AS (SELECT s_suppkey AS cik, {_NORM.format("CASE WHEN s_suppkey % 4 = 0 THEN replace(s_name, '#', ' East ') ELSE upper(replace(s_name, '#', ' - ')) END")} AS b FROM supplier),
ex AS (SELECT sid, cik FROM a JOIN b ON a = b), x AS (SELECT sid, {_TOKENS.format('a')} AS a FROM a WHERE sid NOT IN (SELECT sid FROM ex)), y AS (SELECT cik, {_TOKENS.format('b')} AS b FROM b),
near AS (SELECT sid, cik, ROUND(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) AS score FROM x JOIN y ON a[1] = b[1] AND a[-1] = b[-1])
SELECT sid, cik, 1.0::DOUBLE AS score, true AS is_exact FROM ex UNION ALL SELECT sid, cik, score, false FROM near WHERE score >= 0.5""",
)
def name_candidates(spark, sf_dir):
    """Every supplier, against a register of all of them in other spellings; each fourth has a word more."""
    s = panel.table(spark, sf_dir, "supplier")
    names = s.select(F.col("s_suppkey").alias("sid"), F.col("s_name").alias("name"))
    spelled = F.when(F.col("s_suppkey") % 4 == 0, F.regexp_replace("s_name", "#", " East ")).otherwise(F.upper(F.regexp_replace("s_name", "#", " - ")))
    return rounded(en.name_candidates(names, s.select(F.col("s_suppkey").alias("cik"), spelled.alias("name"))))


@query("jon_09_resolved_entities", "SELECT s_suppkey AS sid, CASE WHEN s_suppkey % 10 = 0 THEN 9000 + s_suppkey WHEN s_suppkey % 10 = 1 THEN 5000 + s_suppkey WHEN s_suppkey % 10 = 3 THEN 7000 + s_suppkey END AS cik, CASE s_suppkey % 10 WHEN 0 THEN 'override' WHEN 1 THEN 'ticker' WHEN 2 THEN 'ticker_conflict' WHEN 3 THEN 'name' ELSE 'unresolved' END AS method FROM supplier")
def resolved(spark, sf_dir):
    s = panel.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"))
    k = F.col("sid") % 10
    overrides = s.where(k == 0).select("sid", (F.col("sid") + 9000).alias("cik"))
    tickers = s.where(k.isin(0, 1, 2)).select("sid", (F.col("sid") + 5000).alias("cik")).unionByName(s.where(k == 2).select("sid", (F.col("sid") + 6000).alias("cik")))
    named = s.where(k.isin(3, 4)).select("sid", (F.col("sid") + 7000).alias("cik"), F.when(k == 3, 0.95).otherwise(0.93).alias("score"))
    rivals = s.where(k.isin(4, 5)).select("sid", (F.col("sid") + 8000).alias("cik"), F.when(k == 4, 0.92).otherwise(0.5).alias("score"))
    return en.resolve(s, overrides, tickers, named.unionByName(rivals))


@query("jon_10_aliases", "WITH x AS (SELECT p_brand AS sid, UPPER(p_brand) AS s FROM part UNION SELECT p_brand, 'X.' || UPPER(p_type) FROM part) SELECT DISTINCT sid, UNNEST([regexp_replace(s, '[._-]', '.', 'g'), regexp_replace(s, '[._-]', '-', 'g'), regexp_replace(s, '[._-]', '_', 'g')]) AS alias FROM x")
def aliases(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    master = p.select(F.col("p_brand").alias("sid"), F.col("p_brand").alias("ticker")).distinct()
    lineage = p.groupBy(F.col("p_brand").alias("canonical_sid")).agg(F.array_join(F.transform(F.collect_set("p_type"), lambda t: F.concat(F.lit("x."), t)), "|").alias("source_sid"))
    return en.aliases(master, lineage)


@query("jon_05_orphan_copies", "WITH f AS (SELECT o_orderkey AS accession, o_custkey AS k, ROUND(o_totalprice / 50000) AS v, o_orderkey % 3 <> 0 AS known FROM orders), c AS (SELECT *, SUM(known::INT) OVER (PARTITION BY k, v) AS n FROM f) SELECT accession, k, v, known FROM c WHERE known OR n <> 1")
def orphans(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("k"), F.round(F.col("o_totalprice") / 50000).alias("v"))
    return en.without_orphan_copies(facts, o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("accession")), ["k", "v"])[0]


@query("mod_06_one_standard_error", "WITH c AS (SELECT o_orderpriority AS fold, 'm' || (o_orderkey % 50) AS name, ROUND(AVG(o_totalprice) / 1000, 4) AS loss, 5.0::DOUBLE AS error, o_orderkey % 50 AS capacity FROM orders GROUP BY 1, 2, 5), b AS (SELECT *, MIN(loss) OVER (PARTITION BY fold) AS best FROM c) SELECT fold, name, loss, capacity FROM b WHERE loss <= best + 5.0 QUALIFY ROW_NUMBER() OVER (PARTITION BY fold ORDER BY capacity, loss, name) = 1")
def one_error(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 50
    c = o.groupBy(F.col("o_orderpriority").alias("fold"), k.alias("capacity")).agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("loss"))
    return cp.one_standard_error(c.select("fold", F.concat(F.lit("m"), F.col("capacity").cast("string")).alias("name"), "loss", F.lit(5.0).alias("error"), "capacity"), ["fold"])


@query("agg_16_annualised", f"{SERIES} SELECT QUARTER(date)::INT AS quarter, ROUND(AVG(r / 100) * 252, 7) AS mean, ROUND(STDDEV_SAMP(r / 100) * SQRT(252), 7) AS volatility, ROUND(AVG(r) / STDDEV_SAMP(r) * SQRT(252), 7) AS sharpe FROM s WHERE r IS NOT NULL GROUP BY 1")
def annualised(spark, sf_dir):
    s = series(spark, sf_dir).select(F.quarter("date").alias("quarter"), "idx", (F.col("r") / 100).alias("r"), "rf")
    return rounded(pf.summary(s, ["quarter"]).select("quarter", (F.col("sharpe_0") * F.col("volatility")).alias("mean"), "volatility", F.col("sharpe_0").alias("sharpe")), 7)
