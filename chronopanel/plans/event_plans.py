"""Alerts and events (WIN, SIM, TGT), contracts of inputs (VAL, SRC, REP) and comparisons of paths (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import entities as en
from chronopanel.operators import events as ev
from chronopanel.operators import repair as rp
from chronopanel.operators import summaries as sm
from chronopanel.operators import validation as va
from chronopanel.plans import registry as R
from chronopanel.plans.portfolio_plans import _BOOK, _book, _bs, _targets_of_book, rounded
from chronopanel.plans.regime_plans import SERIES, VOL, series, volatility
from chronopanel.plans.registry import query
from chronopanel.plans.summary_plans import _PT, _paths
from chronopanel.sources import panel, store

_PAST = "(ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ALERT = f"{VOL}, x AS (SELECT date, idx, ROUND(rv, 9) AS rv FROM v), al AS (SELECT date, idx, rv, COUNT(rv) OVER {_PAST} AS n_past, CASE WHEN COUNT(rv) OVER {_PAST} >= 60 THEN (rv - AVG(rv) OVER {_PAST}) / NULLIF(STDDEV_SAMP(rv) OVER {_PAST}, 0) END AS z, CASE WHEN COUNT(rv) OVER {_PAST} >= 60 THEN QUANTILE_CONT(rv, 0.75) OVER {_PAST} END AS t FROM x)"


def _alerts(spark, sf_dir, quantile=0.75, low=False):
    return ev.past_position(volatility(spark, sf_dir).select("date", "idx", F.round("rv", 9).alias("rv")), "rv", 60, quantile, low)


@query("win_26_past_alerts", f"{_ALERT} SELECT date, n_past, ROUND(z, 6) AS z, ROUND(t, 7) AS threshold, rv > t AS alert FROM al")
def past_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("date", "n_past", F.round("z", 6).alias("z"), F.round("threshold", 7).alias("threshold"), "alert")


_EVENTS = "an AS (SELECT idx AS event_id, idx FROM v WHERE month_last AND idx % 3 = 0)"


def _anchors(spark, sf_dir):
    return series(spark, sf_dir).where("month_last AND idx % 3 = 0").select(F.col("idx").alias("event_id"), "idx")


@query("win_26_event_paths", f"{VOL}, {_EVENTS}, o AS (SELECT UNNEST([-52, -26, -13, 0]) AS o) SELECT event_id, o AS \"offset\", (an.idx + o)::INT AS idx, ROUND(rv, 8) AS value FROM an CROSS JOIN o LEFT JOIN v ON v.idx = an.idx + o")
def event_paths(spark, sf_dir):
    return rounded(ev.event_paths(volatility(spark, sf_dir), _anchors(spark, sf_dir), "rv", [-52, -26, -13, 0]))


@query("win_26_alert_leads", f"{_ALERT}, {_EVENTS} SELECT event_id, COUNT(al.idx) AS n_alerts, MAX(an.idx - al.idx) AS lead FROM an LEFT JOIN al ON al.idx <= an.idx AND al.idx > an.idx - 30 AND rv > t GROUP BY event_id")
def alert_leads(spark, sf_dir):
    return ev.alert_leads(_alerts(spark, sf_dir), _anchors(spark, sf_dir), 30)


@query("win_33_attack_state", f"{_ALERT.replace('0.75', '0.25')} SELECT date, rv < t AS alert FROM al WHERE t IS NOT NULL")
def attack_state(spark, sf_dir):
    return _alerts(spark, sf_dir, 0.25, True).where("threshold IS NOT NULL").select("date", "alert")


@query("sim_27_perfect_foresight", f"{SERIES}, p AS (SELECT idx, r / 100 AS r, rf, UNNEST([{{'policy': 'always', 'w': 1.0::DOUBLE}}, {{'policy': 'never', 'w': 0.0::DOUBLE}}, {{'policy': 'foresight', 'w': CASE WHEN r / 100 > rf THEN 1.0 ELSE 0.0 END::DOUBLE}}]) AS p FROM s WHERE r IS NOT NULL), t AS (SELECT idx, r, rf, p.policy AS policy, p.w AS w, ABS(p.w - COALESCE(LAG(p.w) OVER (PARTITION BY p.policy ORDER BY idx), 0.0)) AS turn FROM p), c AS (SELECT UNNEST([0.0, 10.0]::DOUBLE[]) AS cost_bps) SELECT policy, cost_bps, COUNT(*) AS n, SUM((turn > 0)::INT)::BIGINT AS n_changes, ROUND(SUM(LN(1 + w * r + (1 - w) * rf) + LN(1 - cost_bps / 1e4 * turn)), 7) AS log_growth FROM t CROSS JOIN c GROUP BY ALL")
def perfect_foresight(spark, sf_dir):
    return rounded(ev.perfect_foresight(series(spark, sf_dir).select("idx", (F.col("r") / 100).alias("r"), "rf"), [0.0, 10.0]), 7)


@query("tgt_12_monthly_refits", f"WITH {R.MARKET}, l AS (SELECT *, LAG(date, 21) OVER (ORDER BY idx) AS train_last FROM m) SELECT date AS refit, GREATEST(idx - 21, 0)::INT AS n_mature, train_last FROM l WHERE month_last AND GREATEST(idx - 21, 0) >= 100")
def monthly_refits(spark, sf_dir):
    out = ev.monthly_refits(panel.market(spark, sf_dir), 21, 100)
    return out.select("refit", F.col("n_mature").cast("int").alias("n_mature"), "train_last")


@query("tgt_09_forward_rank_ic", f"WITH {R.spine(R.SIZE_GROUP)}, f AS (SELECT date, sid, ROUND(-({R.ret('close', R.lag('close', 5))}), 8) AS x, ROUND({R.ret('LEAD(close, 5) OVER (PARTITION BY sid ORDER BY idx)', 'close')}, 8) AS y, month_last FROM spine), h AS (SELECT * FROM f WHERE month_last AND x IS NOT NULL AND y IS NOT NULL), k AS (SELECT date, {R.avg_rank('x', 'date')} AS rx, {R.avg_rank('y', 'date')} AS ry FROM h) SELECT date, COUNT(*) AS n, ROUND(CASE WHEN STDDEV_POP(rx) > 0 AND STDDEV_POP(ry) > 0 THEN CORR(rx, ry) END, 8) AS rank_ic FROM k GROUP BY date HAVING COUNT(*) >= 3")
def forward_ic(spark, sf_dir):
    from chronopanel.functions import columns as C

    close, over = F.col("close"), panel.by_name()
    rows = panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)).select("date", "sid", "month_last", F.round(-C.simple_return(close, F.lag(close, 5).over(over)), 8).alias("x"), F.round(C.simple_return(F.lead(close, 5).over(over), close), 8).alias("y"))
    return rounded(sm.rank_ic_by_date(rows.where("month_last"), "x", "y", 3))


@query("agg_65_probability_skill", f"WITH {_PT}, h AS (SELECT path, YEAR(date)::INT AS year, (b + 0.04) / 0.082 AS p, (r > 0)::INT::DOUBLE AS o FROM pt), g AS (SELECT path, year, COUNT(*) AS n, AVG((p - o) ** 2) AS brier, AVG(o) * (1 - AVG(o)) AS reference FROM h GROUP BY ALL) SELECT path, year, n, ROUND(brier, 8) AS brier, ROUND(reference, 8) AS reference, ROUND(1 - brier / NULLIF(reference, 0), 7) AS skill FROM g")
def probability_skill(spark, sf_dir):
    rows = _paths(spark, sf_dir).withColumn("year", F.year("date")).withColumn("p", (F.col("b") + 0.04) / 0.082).withColumn("up", F.col("r") > 0)
    out = ev.probability_skill(rows, ["path", "year"], "p", "up")
    return out.select("path", "year", "n", F.round("brier", 8).alias("brier"), F.round("reference", 8).alias("reference"), F.round("skill", 7).alias("skill"))


@query("agg_67_metric_deltas", f"WITH {_PT}, m AS (SELECT YEAR(date)::INT AS year, path, AVG(r) AS mean, AVG(turnover) AS turnover FROM pt GROUP BY ALL), p AS (SELECT * FROM (VALUES ('1-URGENT', '5-LOW'), ('2-HIGH', '1-URGENT')) AS t(treatment, parent)), j AS (SELECT a.year, treatment, parent, a.mean - b.mean AS d1, a.turnover - b.turnover AS d2 FROM m a JOIN p ON treatment = a.path JOIN m b ON b.path = parent AND b.year = a.year) SELECT year, treatment, parent, 'mean' AS metric, ROUND(d1, 8) AS delta FROM j UNION ALL SELECT year, treatment, parent, 'turnover', ROUND(d2, 8) FROM j")
def metric_deltas(spark, sf_dir):
    m = _paths(spark, sf_dir).groupBy(F.year("date").alias("year"), "path").agg(F.avg("r").alias("mean"), F.avg("turnover").alias("turnover"))
    parents = spark.createDataFrame([("1-URGENT", "5-LOW"), ("2-HIGH", "1-URGENT")], "treatment string, parent string")
    return rounded(ev.metric_deltas(m, parents, ["year"], ["mean", "turnover"]))


_OTHER_PATH = "ot AS (SELECT idx, nav * (1 + (idx % 7) * 0.01) AS nav FROM nav WHERE idx % 10 <> 0 UNION ALL SELECT idx + 1000000, nav FROM nav WHERE idx % 10 = 3)"


@query(
    "val_25_path_differences",
    f"{_bs('0.0').rstrip().rstrip(',')}, {_OTHER_PATH}, bo AS (SELECT a.idx % 3 AS third, a.nav AS a, b.nav AS b FROM (SELECT * FROM nav) AS a FULL JOIN ot AS b ON a.idx = b.idx) "
    "SELECT COUNT(*) AS n, COUNT(a) - SUM((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS n_only_a, COUNT(b) - SUM((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS n_only_b, ROUND(MAX(CASE WHEN a = b THEN 0 ELSE ABS(a - b) / GREATEST(ABS(a), ABS(b)) END), 6) AS max_difference, COUNT(a) = COUNT(*) AND COUNT(b) = COUNT(*) AND MAX(ABS(a - b) / GREATEST(ABS(a), ABS(b))) <= 1e-9 AS is_same FROM bo",
)
def path_differences(spark, sf_dir):
    """A path against itself with sessions left out, sessions that it hasn't, and values that are off by up to six parts in a hundred."""
    nav = _book(spark, sf_dir)[0].select("idx", "nav")
    other = nav.where("idx % 10 <> 0").withColumn("nav", F.col("nav") * (1 + (F.col("idx") % 7) * 0.01))
    other = other.unionByName(nav.where("idx % 10 = 3").withColumn("idx", (F.col("idx") + 1_000_000).cast("int")))
    return rounded(ev.path_differences(nav, other, 1e-9), 6)


@query("val_15_missing_execution_prices", f"{_BOOK.rstrip().rstrip(',')} SELECT tg.r AS execution_idx, tg.sid FROM tg LEFT JOIN spine ON spine.sid = tg.sid AND spine.idx = tg.r AND open > 0 AND NOT (spine.sid = 'G1') WHERE spine.sid IS NULL")
def missing_execution_prices(spark, sf_dir):
    spine = store.materialized(panel.spine(panel.prices(spark, sf_dir, panel.SIZE_GROUP)))
    return va.missing_execution_prices(_targets_of_book(spine), spine.where("sid <> 'G1'"))


@query("val_11_calendar_faults", f"WITH {R.MARKET}, f AS (SELECT date, CASE WHEN idx % 50 <> 0 THEN month_last END AS month_last, week_last FROM m UNION ALL SELECT date, month_last, week_last FROM m WHERE idx % 100 = 1), n AS (SELECT COUNT(*) AS n FROM (SELECT date FROM f GROUP BY date HAVING COUNT(*) > 1) AS q) SELECT 'repeated' AS fault, n FROM n UNION ALL SELECT 'null:month_last', SUM((month_last IS NULL)::INT)::BIGINT FROM f UNION ALL SELECT 'null:week_last', 0")
def calendar_faults(spark, sf_dir):
    c = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate")
    rows = c.select("date", F.when(F.col("idx") % 50 != 0, F.col("month_last")).alias("month_last"), "week_last").union(c.where("idx % 100 = 1").select("date", "month_last", "week_last"))
    return va.calendar_faults(rows, ["month_last", "week_last"])


@query("val_13_benchmark_faults", "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE DAY(l_shipdate) <> 2), f AS (SELECT o.date, CASE WHEN k % 10 < 3 THEN 'both_closes' WHEN k % 10 > 8 THEN 'no_close' WHEN COUNT(*) OVER (PARTITION BY o.date) > 1 THEN 'repeated' WHEN c.date IS NULL THEN 'no_session' END AS fault FROM o LEFT JOIN c ON c.date = o.date) SELECT date, fault FROM f WHERE fault IS NOT NULL")
def benchmark_faults(spark, sf_dir):
    k = F.col("o_orderkey") % 10
    rows = panel.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date"), F.when(k < 6, 1.0).alias("close"), F.when((k < 3) | k.between(6, 8), 2.0).alias("tr_close"))
    days = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").where("DAY(date) <> 2")
    return va.benchmark_faults(rows, days, ("close", "tr_close"))


_MAPS = "mp AS (SELECT c_custkey AS sid, 'S' || (c_custkey % 900) AS symbol, DATE '1994-01-01' + (c_custkey % 2500)::INT AS effective_from, CASE WHEN c_custkey % 4 = 0 THEN DATE '1994-01-01' + (c_custkey % 2500 + 500)::INT END AS effective_to FROM customer UNION ALL SELECT c_custkey, 'T' || c_custkey, DATE '1997-01-01', NULL FROM customer WHERE c_custkey % 11 = 0)"


def _maps(spark, sf_dir):
    c = F.col("c_custkey")
    day = lambda n: F.date_add(F.to_date(F.lit("1994-01-01")), n.cast("int"))
    t = panel.table(spark, sf_dir, "customer")
    rows = t.select(c.alias("sid"), F.concat(F.lit("S"), (c % 900).cast("string")).alias("symbol"), day(c % 2500).alias("effective_from"), F.when(c % 4 == 0, day(c % 2500 + 500)).alias("effective_to"))
    return rows.union(t.where("c_custkey % 11 = 0").select(c, F.concat(F.lit("T"), c.cast("string")), F.to_date(F.lit("1997-01-01")), F.lit(None).cast("date")))


@query("src_25_mapping_faults", f"WITH {_MAPS}, k AS (SELECT *, GREATEST(effective_from, DATE '1995-01-01') >= LEAST(COALESCE(effective_to, DATE '1999-01-01'), DATE '1999-01-01') AS gone FROM mp), a AS (SELECT sid, COUNT(DISTINCT symbol) AS n1 FROM k WHERE NOT gone GROUP BY 1), b AS (SELECT symbol, COUNT(DISTINCT sid) AS n2 FROM k WHERE NOT gone GROUP BY 1), f AS (SELECT k.sid, k.symbol, CASE WHEN gone THEN 'outside' WHEN n1 > 1 THEN 'several_symbols' WHEN n2 > 1 THEN 'symbol_reused' END AS fault FROM k LEFT JOIN a ON a.sid = k.sid LEFT JOIN b ON b.symbol = k.symbol) SELECT * FROM f WHERE fault IS NOT NULL")
def mapping_faults(spark, sf_dir):
    return va.mapping_faults(_maps(spark, sf_dir), "1995-01-01", "1999-01-01")


@query("src_26_rekeyed_history", f"WITH {_MAPS}, h AS (SELECT CAST(o_orderdate AS DATE) AS date, 'S' || (o_custkey % 900) AS symbol, o_totalprice AS close FROM orders) SELECT sid, COUNT(*) AS n, ROUND(SUM(close), 2) AS total FROM h JOIN mp USING (symbol) WHERE effective_from <= date AND (effective_to IS NULL OR date < effective_to) GROUP BY sid")
def rekeyed(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    rows = o.select(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("S"), (F.col("o_custkey") % 900).cast("string")).alias("symbol"), F.col("o_totalprice").alias("close"))
    return rounded(en.rekeyed_totals(rows, _maps(spark, sf_dir), "close"), 2)


@query("src_30_hashed_rows", f"""WITH {R.MARKET} SELECT date, date + INTERVAL 21 HOUR AS available_at, sha256('["' || strftime(date, '%Y-%m-%d') || '","' || CAST(volume::BIGINT AS VARCHAR) || '","snap"]') AS record_hash FROM m""")
def hashed_rows(spark, sf_dir):
    m = panel.market(spark, sf_dir).select("date", F.col("volume").cast("long").alias("volume"))
    return store.hashed_rows(m, ["date", "volume"], "snap", 21)


@query("rep_01_identities", "SELECT c_custkey AS source_sid, CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 100000 ELSE c_custkey END AS canonical_sid, CASE WHEN c_custkey % 10 = 0 THEN 'override' ELSE 'own' END AS status FROM customer")
def identities(spark, sf_dir):
    c = panel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_sid"))
    overrides = c.where("source_sid % 10 = 0").select("source_sid", (F.col("source_sid") + 100000).alias("canonical_sid"))
    return rp.identities(c, overrides)


@query("rep_03_ordered_donors", "WITH p AS (SELECT DISTINCT o_custkey AS sid, o_orderpriority AS donor, MIN(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS priority FROM orders) SELECT sid, string_agg(donor, '|' ORDER BY priority, donor) AS donors FROM p GROUP BY sid")
def ordered_donors(spark, sf_dir):
    pairs = panel.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid"), F.col("o_orderpriority").alias("donor")).agg(F.min("o_orderkey").alias("priority"))
    return rp.ordered_donors(pairs)
