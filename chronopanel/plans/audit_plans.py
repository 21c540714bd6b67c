"""Actions, audits, conditional tables and further joins (SIM, VAL, AGG, PIT, MOD, STA, SRC)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import actions as ac
from chronopanel.operators import calendar as cal
from chronopanel.operators import factor_database as db
from chronopanel.operators import models as mo
from chronopanel.operators import order_statistics as od
from chronopanel.operators import performance as pf
from chronopanel.plans import registry as R
from chronopanel.plans.factor_plans import _LONG, _long
from chronopanel.plans.inference_plans import _SO, _so
from chronopanel.plans.pit_plans import INTERVALS, intervals
from chronopanel.plans.portfolio_plans import _book, _bs, rounded
from chronopanel.plans.regime_plans import VOL, volatility
from chronopanel.plans.registry import query
from chronopanel.sources import panel, store

_ACT = "ca AS (SELECT sid || '-end' AS action_id, 500 + 40 * CAST(substr(sid, 7) AS INT) AS apply_idx, sid AS source_sid, CASE WHEN CAST(substr(sid, 7) AS INT) % 2 = 0 THEN 'Brand#1' END AS target_sid, 3.5::DOUBLE AS cash_per_share, CASE WHEN CAST(substr(sid, 7) AS INT) % 2 = 0 THEN 0.25::DOUBLE END AS target_per_share FROM (SELECT DISTINCT p_brand AS sid FROM part) AS q WHERE sid <> 'Brand#1')"


def _actions(spark, sf_dir):
    n = F.substring("sid", 7, 9).cast("int")
    brands = panel.table(spark, sf_dir, "part").select(F.col("p_brand").alias("sid")).distinct().where("sid <> 'Brand#1'")
    return brands.select(F.concat("sid", F.lit("-end")).alias("action_id"), (500 + 40 * n).alias("apply_idx"), F.col("sid").alias("source_sid"), F.when(n % 2 == 0, "Brand#1").alias("target_sid"), F.lit(3.5).alias("cash_per_share"), F.when(n % 2 == 0, 0.25).alias("target_per_share"))


@query(
    "sim_06_applied_actions",
    f"""WITH {R.spine()}, {_ACT}, h AS (SELECT idx, sid, volume AS shares FROM spine WHERE volume IS NOT NULL AND idx % 20 = 0), j AS (SELECT idx, CASE WHEN action_id IS NULL THEN sid ELSE COALESCE(target_sid, sid) END AS sid, CASE WHEN action_id IS NULL THEN shares ELSE shares * COALESCE(target_per_share, 0.0) END AS shares, CASE WHEN action_id IS NULL THEN 0.0 ELSE shares * cash_per_share END AS cash, action_id FROM h LEFT JOIN ca ON sid = source_sid AND idx = apply_idx)
SELECT idx, sid, ROUND(SUM(shares), 6) AS shares, ROUND(SUM(cash), 6) AS cash, MIN(action_id) AS action_id FROM j GROUP BY idx, sid""",
)
def applied(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    holdings = spine.where("volume IS NOT NULL AND idx % 20 = 0").select("idx", "sid", F.col("volume").alias("shares"))
    return rounded(ac.applied_actions(holdings, _actions(spark, sf_dir)), 6)


_KNOWN = "kn AS (SELECT *, LAST_VALUE(CASE WHEN close IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS ki, LAST_VALUE(close IGNORE NULLS) OVER w AS kc FROM spine WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("sim_09_price_policy", f"WITH {R.spine()}, {_KNOWN} SELECT idx, sid, CASE WHEN open > 0 THEN open WHEN idx - ki <= 2 THEN kc END AS price, CASE WHEN open > 0 THEN 'open' WHEN idx - ki <= 2 THEN 'carried' ELSE 'none' END AS source FROM kn WHERE month_last")
def price_policy(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    return ac.priced(spine.where("month_last").select("idx", "sid"), spine, 2)


@query("sim_11_pending_actions", f"WITH {R.spine()}, {_ACT} SELECT idx, sid FROM spine WHERE week_last AND EXISTS (SELECT 1 FROM ca WHERE source_sid = sid AND apply_idx > idx AND apply_idx <= idx + 25)")
def pending(spark, sf_dir):
    held = panel.spine(panel.prices(spark, sf_dir)).where("week_last").select("idx", "sid")
    return ac.pending(held, _actions(spark, sf_dir))


@query("sim_13_borrow_rates", f"WITH {R.px()} SELECT date, sid, CASE WHEN sid = 'Brand#2' AND DAY(date) % 2 = 0 THEN 0.03::DOUBLE WHEN DAY(date) % 5 = 0 THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END AS rate FROM px")
def borrow(spark, sf_dir):
    p = panel.prices(spark, sf_dir).select("date", "sid")
    by_name = p.where("sid = 'Brand#2' AND DAY(date) % 2 = 0").withColumn("rate", F.lit(0.03))
    by_date = p.select("date").distinct().where("DAY(date) % 5 = 0").withColumn("rate", F.lit(0.02))
    return ac.borrow_rates(p, by_name, by_date, 0.01)


@query("sim_32_pnl_bridge", f"{_bs('0.001')}, c AS (SELECT date, nav - COALESCE(LAG(nav) OVER (ORDER BY idx), 1.0) AS change FROM nav) SELECT YEAR(date)::INT AS year, COUNT(*) AS n, ROUND(LN(1 + ABS(SUM(change))), 5) AS log_change, 1 AS closes FROM c GROUP BY 1")
def bridge(spark, sf_dir):
    nav, steps = _book(spark, sf_dir, 10.0)
    out = ac.pnl_bridge(nav, steps)
    return out.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.round(F.log1p(F.abs(F.sum("change"))), 5).alias("log_change"), F.max((F.abs(F.col("market") + F.col("cost") - F.col("change")) <= 1e-9 * F.greatest(F.abs("change"), F.lit(1.0))).cast("int")).alias("closes"))


@query("sim_33_net_periods", f"{_bs('0.001')} SELECT r AS execution_idx, ROUND(LEAD(base / (1 - share)) OVER (ORDER BY r) / (base / (1 - share)) - 1, 7) AS net_return FROM bs")
def net_periods(spark, sf_dir):
    from chronopanel.operators import portfolio as po

    return rounded(po.holding_periods(_book(spark, sf_dir, 10.0)[1]).withColumnRenamed("period_return", "net_return"), 7)


@query("val_07_action_sessions", f"WITH {R.px()}, a AS (SELECT o_orderkey AS action_id, CAST(o_orderdate AS DATE) AS apply_session FROM orders), s AS (SELECT MIN(date) AS a, MAX(date) AS b FROM px WHERE DAY(date) <> 13) SELECT apply_session, action_id FROM a, s WHERE apply_session BETWEEN s.a AND s.b AND apply_session NOT IN (SELECT date FROM px WHERE DAY(date) <> 13)")
def action_sessions(spark, sf_dir):
    days = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").where("DAY(date) <> 13")
    acts = panel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), F.to_date("o_orderdate").alias("apply_session"))
    return ac.session_faults(acts, days)


_AHEAD = "CASE WHEN factor_id = 'reversal_21' THEN LEAD(score) OVER (PARTITION BY sid, factor_id ORDER BY date) ELSE score END"


@query("val_23_lookahead_found", f"{_LONG}, d AS (SELECT factor_id, COUNT(*) AS n_different FROM (SELECT s.date, s.sid, s.factor_id, s.b, c.a FROM (SELECT date, sid, factor_id, {_AHEAD} AS b FROM long) AS s JOIN (SELECT date, sid, factor_id, {_AHEAD} AS a FROM (SELECT date, sid, factor_id, CASE WHEN date > DATE '1998-06-30' THEN score + 1 ELSE score END AS score FROM long)) AS c USING (date, sid, factor_id) WHERE date <= DATE '1998-06-30' AND a IS DISTINCT FROM b) GROUP BY 1) SELECT factor_id, n_different FROM d")
def lookahead_found(spark, sf_dir):
    """A factor that takes the next signal's value is found out when what comes after a date is changed; the others aren't named."""
    from pyspark.sql import Window

    from chronopanel.plans.factor_plans import _long

    def leaky(rows):
        ahead = F.lead("score").over(Window.partitionBy("sid", "factor_id").orderBy("signal_date"))
        return rows.withColumn("score", F.when(F.col("factor_id") == "reversal_21", ahead).otherwise(F.col("score")))

    rows = _long(spark, sf_dir).select(F.col("date").alias("signal_date"), "sid", "factor_id", "score")
    changed = rows.withColumn("score", F.when(F.col("signal_date") > "1998-06-30", F.col("score") + 1).otherwise(F.col("score")))
    return db.different_past(leaky(rows), leaky(changed), "1998-06-30", ["signal_date", "sid", "factor_id"], ["score"]).groupBy("factor_id").agg(F.count("*").alias("n_different"))


@query("val_23_causality_audit", f"{_LONG} SELECT COUNT(*) AS n_a, COUNT(*) AS n_b, 0::BIGINT AS n_different FROM long WHERE date <= DATE '1998-06-30'")
def causality(spark, sf_dir):
    """Factors of prices that are cut off after a date, and the rest doubled, against those of all prices, up to that date."""
    from chronopanel.operators import market_factors as mf

    names = ["momentum_12_1", "momentum_12_7", "reversal_21", "log_momentum_255_0"]
    prices = panel.prices(spark, sf_dir)
    changed = prices.withColumn("close", F.when(F.col("date") > "1998-06-30", F.col("close") * 2).otherwise(F.col("close")))
    market = panel.market(spark, sf_dir)
    made = lambda p: mf.factor_table(mf.daily_inputs(panel.spine(p), market), names, F.col("month_last"))
    return db.same_past(made(prices), made(changed), "1998-06-30", ["signal_date", "sid", "factor_id"], ["score", "eligible"])


@query(
    "pit_17_temporal_support",
    f"""WITH {INTERVALS}, e AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS sid, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderpriority = '1-URGENT'), j AS (SELECT iv.sid, effective_from, COUNT(filed) AS n, MIN(filed) AS first, MAX(filed) AS last FROM iv LEFT JOIN e ON e.sid = iv.sid AND filed >= effective_from AND (effective_to IS NULL OR filed < effective_to) GROUP BY 1, 2)
SELECT sid, effective_from, n AS n_filings, first, last, CASE WHEN n = 0 THEN 'unsupported' WHEN n < 40 THEN 'thin' ELSE 'supported' END AS status FROM j""",
)
def support(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    e = panel.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("of_sid"), F.to_date("o_orderdate").alias("filed"))
    inside = (F.col("sid") == F.col("of_sid")) & (F.col("filed") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("filed") < F.col("effective_to")))
    found = F.broadcast(iv).join(e, inside).groupBy("sid", "effective_from").agg(F.count("*").alias("n"), F.min("filed").alias("first"), F.max("filed").alias("last"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "unsupported").when(n < 40, "thin").otherwise("supported")
    return iv.select("sid", "effective_from").join(found, ["sid", "effective_from"], "left").select("sid", "effective_from", n.alias("n_filings"), "first", "last", status.alias("status"))


@query(
    "agg_25_state_grid",
    f"""{VOL}, t AS (SELECT CASE WHEN rv <= 2.6 THEN 'low' WHEN rv <= 3.1 THEN 'mid' ELSE 'high' END AS a, CASE WHEN volume > 1000 THEN 'busy' ELSE 'quiet' END AS b, r FROM v WHERE rv IS NOT NULL)
SELECT a, b, COUNT(*) AS n, ROUND(AVG(r), 8) AS mean, ROUND(AVG((r > 0)::INT), 8) AS hit_rate FROM t GROUP BY GROUPING SETS ((a, b), (a), (b))""",
)
def state_grid(spark, sf_dir):
    v = volatility(spark, sf_dir).where("rv IS NOT NULL")
    t = v.select(F.when(F.col("rv") <= 2.6, "low").when(F.col("rv") <= 3.1, "mid").otherwise("high").alias("a"), F.when(F.col("volume") > 1000, "busy").otherwise("quiet").alias("b"), "r")
    out = t.groupingSets([[F.col("a"), F.col("b")], [F.col("a")], [F.col("b")]], F.col("a"), F.col("b")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    return rounded(out)


@query(
    "agg_43_top_and_rest",
    f"{_SO}, c AS (SELECT QUANTILE_CONT(score, 0.75) AS cut FROM sh) SELECT CASE WHEN score > cut THEN 'top' ELSE 'rest' END AS part, COUNT(*) AS n, ROUND(AVG(x), 8) AS mean, ROUND(MEDIAN(x), 8) AS median, ROUND(AVG(y::INT), 8) AS hit_rate FROM sh, c GROUP BY 1",
)
def top_and_rest(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    cut = od.quantiles(rows, ["score"], {"cut": 0.75})
    parts = rows.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col("score") > F.col("score_cut"), "top").otherwise("rest"))
    means = parts.groupBy("part").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("y").cast("double")).alias("hit_rate"))
    return rounded(means.join(od.quantiles(parts, ["x"], {"median": 0.5}, ["part"]).withColumnRenamed("x_median", "median"), "part"))


@query(
    "agg_48_quintiles",
    f"{_SO}, q AS (SELECT {', '.join(f'QUANTILE_CONT(score, {k / 5}) AS q{k}' for k in range(1, 5))} FROM sh), g AS (SELECT 1 + {' + '.join(f'(score > q{k})::INT' for k in range(1, 5))} AS quintile, x FROM sh, q) SELECT quintile, COUNT(*) AS n, ROUND(AVG(x), 8) AS mean FROM g GROUP BY quintile",
)
def quintiles(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    return rounded(pf.with_quantile_group(rows, "score", 5, "quintile").groupBy("quintile").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


@query(
    "agg_54_pooled_rank_correlation",
    f"{_LONG}, p AS (SELECT a.factor_id AS a, b.factor_id AS b, a.date, a.sid, a.score AS x, b.score AS y FROM long a JOIN long b USING (date, sid) WHERE a.factor_id < b.factor_id AND a.score IS NOT NULL AND b.score IS NOT NULL), k AS (SELECT a, b, {R.avg_rank('x', 'a, b')} AS rx, {R.avg_rank('y', 'a, b')} AS ry FROM p) SELECT a, b, COUNT(*) AS n, CASE WHEN COUNT(*) >= 100 AND NOT isnan(CORR(rx, ry)) THEN ROUND(CORR(rx, ry), 8) END AS spearman FROM k GROUP BY a, b",
)
def pooled(spark, sf_dir):
    return rounded(od.pairwise_spearman(_long(spark, sf_dir), "factor_id", "score", ["date", "sid"], 100))


@query(
    "agg_63_dimension_representatives",
    f"""{_LONG}, f AS (SELECT factor_id, CASE WHEN factor_id LIKE '%momentum%' THEN 'trend' ELSE 'reversal' END AS dimension, COUNT(score) AS n, ROUND(AVG((score > 0)::INT), 8) AS positive_share FROM long GROUP BY 1)
SELECT factor_id, dimension, n, positive_share, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY positive_share DESC, n DESC, factor_id) = 1 AS is_representative FROM f""",
)
def representatives(spark, sf_dir):
    f = _long(spark, sf_dir).groupBy("factor_id").agg(F.count("score").alias("n"), F.round(F.avg((F.col("score") > 0).cast("double")), 8).alias("positive_share"))
    f = f.withColumn("dimension", F.when(F.col("factor_id").contains("momentum"), "trend").otherwise("reversal"))
    first = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("positive_share").desc(), F.col("n").desc(), "factor_id"))
    return f.select("factor_id", "dimension", "n", "positive_share", (first == 1).alias("is_representative"))


@query(
    "mod_18_interactions",
    f"{_SO}, z AS (SELECT date, score, AVG(score) OVER () AS m, y, x FROM sh) SELECT date, ROUND(score - m, 8) AS main, ROUND((score - m) * (score - m), 7) AS square, ROUND((score - m) * (CASE WHEN MONTH(date) <= 6 THEN 1 ELSE -1 END), 8) AS by_half FROM z",
)
def interactions(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    centred = F.col("score") - F.avg("score").over(Window.partitionBy())
    return rows.select("date", centred.alias("c")).select("date", F.round("c", 8).alias("main"), F.round(F.col("c") * F.col("c"), 7).alias("square"), F.round(F.col("c") * F.when(F.month("date") <= 6, 1).otherwise(-1), 8).alias("by_half"))


@query(
    "mod_14_ridge_of_two",
    f"""{_SO}, q AS (SELECT score AS s, score * score AS q, x AS y FROM sh), c AS (SELECT AVG(s) AS ms, AVG(q) AS mq, AVG(y) AS my, COVAR_POP(s, s) * COUNT(*) + 1 AS ss, COVAR_POP(q, q) * COUNT(*) + 1 AS qq, COVAR_POP(s, q) * COUNT(*) AS sq, COVAR_POP(s, y) * COUNT(*) AS sy, COVAR_POP(q, y) * COUNT(*) AS qy FROM q),
b AS (SELECT ms, mq, my, (sy * qq - qy * sq) / (ss * qq - sq * sq) AS bs, (qy * ss - sy * sq) / (ss * qq - sq * sq) AS bq FROM c)
SELECT 'intercept' AS name, ROUND(my - bs * ms - bq * mq, 5) AS coefficient FROM b UNION ALL SELECT 'score', ROUND(bs, 5) FROM b UNION ALL SELECT 'square', ROUND(bq, 5) FROM b""",
)
def ridge_of_two(spark, sf_dir):
    """A ridge on two columns: one row of moments leaves Spark, the solution comes back."""
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").withColumn("square", F.col("score") ** 2)
    names = ["score", "square"]
    found = mo.ridge_moments(rows, names, "x").first().asDict()
    return rounded(spark.createDataFrame(list(zip(["intercept", *names], mo.solve_ridge(found, names, "x", 1.0), strict=True)), "name string, coefficient double"), 5)


@query(
    "sta_13_signed_ranks",
    f"{_SO}, b AS (SELECT FLOOR((ROW_NUMBER() OVER (ORDER BY idx) - 1) / 20) AS k, x FROM sh), bm AS (SELECT k, ROUND(AVG(x), 9) AS d FROM b GROUP BY k), r AS (SELECT d, {R.avg_rank('ABS(d)', 'NULL')} AS r FROM bm WHERE d <> 0) SELECT COUNT(*) AS n, SUM(r) FILTER (WHERE d > 0) AS w_plus, ROUND((SUM(r) FILTER (WHERE d > 0) - COUNT(*) * (COUNT(*) + 1) / 4) / SQRT(COUNT(*) * (COUNT(*) + 1) * (2 * COUNT(*) + 1) / 24), 8) AS z FROM r",
)
def signed_ranks(spark, sf_dir):
    """Signed-rank statistic of means of blocks of 20, and its normal score."""
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    k = F.floor((F.row_number().over(Window.orderBy("idx")) - 1) / 20)
    means = rows.withColumn("k", k).groupBy("k").agg(F.round(F.avg("x"), 9).alias("d")).where("d <> 0").withColumn("one", F.lit(1))
    ranked = means.withColumn("a", F.abs("d")).withColumn("r", C.average_rank(F.col("a"), ["one"]))
    n, w = F.count("*"), F.sum(F.when(F.col("d") > 0, F.col("r")))
    return ranked.agg(n.alias("n"), w.alias("w_plus"), F.round((w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 8).alias("z"))


@query("src_01_repeated_keys", "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1")
def repeated(spark, sf_dir):
    return store.repeated_keys(panel.table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("jon_12_path_reconciliation", f"{_bs('0.0')}, a AS (SELECT date, ROUND(LN(nav), 6) AS v FROM nav WHERE idx % 3 <> 0), b AS (SELECT date, ROUND(LN(nav), 6) + CASE WHEN idx % 5 = 0 THEN 1.0 ELSE 0.0 END AS v FROM nav WHERE idx % 2 = 0) SELECT date, ROUND(a.v, 6) AS a, ROUND(b.v, 6) AS b, ROUND(ABS(a.v - b.v), 5) AS difference, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' WHEN ABS(a.v - b.v) <= 0.01 THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b USING (date)")
def path_reconciliation(spark, sf_dir):
    nav = _book(spark, sf_dir)[0].select("date", "idx", F.round(F.log("nav"), 6).alias("v"))
    a = nav.where("idx % 3 <> 0").select("date", "v")
    b = nav.where("idx % 2 = 0").select("date", (F.col("v") + F.when(F.col("idx") % 5 == 0, 1.0).otherwise(0.0)).alias("v"))
    out = store.reconciliation(a, b, ["date"], "v", 0.01)
    return out.select("date", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("difference", 5).alias("difference"), "status")
