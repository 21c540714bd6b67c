"""Summaries (AGG), joins with a contract (JON) and tests of states (STA)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import contracts as ct
from chronopanel.operators import inference as inf
from chronopanel.operators import order_statistics as od
from chronopanel.operators import summaries as sm
from chronopanel.plans import registry as R
from chronopanel.plans.inference_plans import _SO, _draws, _places, _so
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.regime_plans import SERIES, series
from chronopanel.plans.registry import query
from chronopanel.sources import panel

# a path of daily returns for each priority of orders, beside a benchmark
_PT = """pt AS (SELECT path, date, ROW_NUMBER() OVER (PARTITION BY path ORDER BY date) AS idx, r, b, turnover FROM (SELECT o_orderpriority AS path, CAST(o_orderdate AS DATE) AS date, CAST(SUM(o_orderkey) % 101 AS DOUBLE) / 1000 - 0.05 AS r, CAST(SUM(o_custkey) % 83 AS DOUBLE) / 1000 - 0.04 AS b, CAST(COUNT(*) AS DOUBLE) / 100 AS turnover FROM orders GROUP BY 1, 2) AS q)"""
_NAV = f"{_PT}, nv AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS nav FROM pt), dd AS (SELECT *, ROUND(nav / GREATEST(1.0, MAX(nav) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING)) - 1, 10) AS dd FROM nv)"


def _paths(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("path"), F.to_date("o_orderdate").alias("date"))
    share = lambda c, k, shift: (F.sum(c) % k).cast("double") / 1000 - shift
    rows = o.agg(share("o_orderkey", 101, 0.05).alias("r"), share("o_custkey", 83, 0.04).alias("b"), (F.count("*").cast("double") / 100).alias("turnover"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("date")))


def _navs(spark, sf_dir):
    over = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = _paths(spark, sf_dir).withColumn("nav", F.exp(F.sum(F.log1p("r")).over(over)))
    return rows.withColumn("dd", F.round(F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(over)) - 1, 10))


@query("agg_02_longest_underwater", f"WITH {_NAV}, i AS (SELECT *, SUM((dd >= 0)::INT) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM dd), g AS (SELECT path, island, COUNT(*) AS longest, MAX(idx) AS ended_idx FROM i WHERE dd < 0 GROUP BY ALL) SELECT path, longest, ended_idx FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY path ORDER BY longest DESC, ended_idx) = 1")
def underwater(spark, sf_dir):
    return sm.longest_underwater(_navs(spark, sf_dir), ["path"])


@query("agg_03_benchmark_returns", f"WITH {R.MARKET}, d AS (SELECT date, open, close, LAG(close) OVER (ORDER BY date) AS before, ROW_NUMBER() OVER (ORDER BY date) AS n FROM m WHERE month_last) SELECT date, ROUND(close / CASE WHEN n = 1 THEN open ELSE before END - 1, 8) AS b FROM d")
def benchmark(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    return rounded(sm.benchmark_returns(m, m.where("month_last")))


@query("agg_05_relative_growth", f"WITH {_PT} SELECT path, COUNT(*) AS n, ROUND(EXP((SUM(LN(1 + r)) - SUM(LN(1 + b))) * 252 / COUNT(*)) - 1, 7) AS growth FROM pt GROUP BY path")
def growth(spark, sf_dir):
    return rounded(sm.relative_growth(_paths(spark, sf_dir), ["path"]), 7)


@query("agg_08_path_summary", f"WITH {_NAV} SELECT path, COUNT(*) AS n, ROUND(EXP(SUM(LN(1 + r)) * 52 / COUNT(*)) - 1, 7) AS cagr, ROUND(AVG(r - b) / STDDEV_SAMP(r - b) * SQRT(52), 7) AS information_ratio, ROUND(MIN(nav / mx - 1), 7) AS max_drawdown, ROUND(AVG(turnover), 7) AS mean_turnover, ROUND(SUM(turnover * 0.001) * 52 / COUNT(*), 7) AS cost_drag FROM (SELECT *, GREATEST(1.0, MAX(nav) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS mx FROM nv) AS q GROUP BY path")
def path_summary(spark, sf_dir):
    return rounded(sm.path_summary(_paths(spark, sf_dir).withColumn("cost", F.col("turnover") * 0.001), ["path"], 52), 7)


@query("agg_09_calendar_summary", f"WITH {_NAV}, y AS (SELECT path, MIN(date) AS first, MAX(date) AS last, date_diff('day', MIN(date), MAX(date)) / 365.2425 AS y, ARG_MAX(nav, date) / ARG_MIN(nav, date) AS g, COVAR_SAMP(r, b) / VAR_SAMP(b) AS beta, SUM(turnover) AS t FROM nv GROUP BY path) SELECT path, first, last, ROUND(POW(g, 1 / y) - 1, 7) AS cagr, ROUND(beta, 7) AS beta, ROUND(t / y, 7) AS turnover FROM y")
def calendar_summary(spark, sf_dir):
    return rounded(sm.calendar_summary(_navs(spark, sf_dir), ["path"]), 7)


_AUDIT = f"WITH {R.spine()}, au AS (SELECT sid, date, close IS NOT NULL AS is_valid, close IS NULL AND DAY(date) <= 5 AS is_excused, COALESCE(volume > 250, false) AS is_fault FROM spine)"


def _audit(spark, sf_dir):
    s = panel.spine(panel.prices(spark, sf_dir))
    missing = F.col("close").isNull()
    return s.select("sid", "date", (~missing).alias("is_valid"), (missing & (F.dayofmonth("date") <= 5)).alias("is_excused"), F.coalesce(F.col("volume") > 250, F.lit(False)).alias("is_fault"))


@query("agg_20_adjusted_coverage", f"{_AUDIT} SELECT sid, COUNT(*) AS n_expected, SUM(is_excused::INT)::BIGINT AS n_excused, SUM(is_valid::INT)::BIGINT AS n_valid, ROUND(SUM(is_valid::INT) / COUNT(*), 8) AS coverage, ROUND(SUM(is_valid::INT) / NULLIF(COUNT(*) - SUM(is_excused::INT), 0), 8) AS adjusted FROM au GROUP BY sid")
def coverage(spark, sf_dir):
    return rounded(sm.coverage(_audit(spark, sf_dir), ["sid"]))


@query("agg_21_worklist", f"{_AUDIT}, w AS (SELECT sid, SUM(is_valid::INT) / COUNT(*) AS coverage, MAX(date) FILTER (WHERE is_valid) AS last_valid, MAX(date) AS last, BOOL_OR(is_fault) AS f FROM au GROUP BY sid), t AS (SELECT sid, ROUND(coverage, 8) AS coverage, last_valid, concat_ws('|', CASE WHEN coverage < 0.7 THEN 'low_coverage' END, CASE WHEN last_valid IS NULL THEN 'no_history' END, CASE WHEN date_diff('day', last_valid, last) > 30 THEN 'ends_early' END, CASE WHEN f THEN 'fault' END) AS tags FROM w) SELECT * FROM t WHERE tags <> ''")
def worklist(spark, sf_dir):
    return rounded(sm.worklist(_audit(spark, sf_dir), 0.7))


@query("agg_24_active_wealth", f"WITH {_PT}, sp AS (SELECT * FROM (VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31'), ('whole', DATE '1995-01-01', DATE '2001-12-31')) AS t(span, a, z)) SELECT path, span, COUNT(*) AS n, ROUND(SUM(LN(1 + r) - LN(1 + b)), 7) AS log_wealth FROM pt JOIN sp ON date BETWEEN a AND z GROUP BY ALL")
def active_wealth(spark, sf_dir):
    spans = [("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31"), ("whole", "1995-01-01", "2001-12-31")]
    return sm.active_wealth(_paths(spark, sf_dir), spans, ["path"]).select("path", "span", "n", F.round(F.log("wealth"), 7).alias("log_wealth"))


@query("agg_28_information_ratio", f"WITH {_PT} SELECT path, COUNT(*) AS n, ROUND(AVG(r - b) / STDDEV_SAMP(r - b) * SQRT(252), 7) AS ratio FROM pt GROUP BY path")
def information_ratio(spark, sf_dir):
    return rounded(sm.information_ratio(_paths(spark, sf_dir).withColumn("active", F.col("r") - F.col("b")), ["path"], "active", 252), 7)


_STATES = f"{_PT}, st AS (SELECT *, r > 0 AS up, b > 0 AS led FROM pt)"


def _states(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("up", F.col("r") > 0).withColumn("led", F.col("b") > 0)


@query("agg_29_joint_episodes", f"WITH {_STATES}, n AS (SELECT *, COALESCE(idx - LAG(idx) OVER (PARTITION BY path, up, led ORDER BY idx) > 1, true)::INT AS is_new FROM st) SELECT path, up, led, SUM(is_new)::BIGINT AS n_episodes, COUNT(*) AS n_rows FROM n GROUP BY ALL")
def joint_episodes(spark, sf_dir):
    return sm.joint_episodes(_states(spark, sf_dir), ["up", "led"], ["path"])


_CELLS = {"dd": "AVG(turnover) FILTER (WHERE up AND led) - AVG(turnover) FILTER (WHERE up AND NOT led) - (AVG(turnover) FILTER (WHERE NOT up AND led) - AVG(turnover) FILTER (WHERE NOT up AND NOT led))"}


@query("agg_31_difference_in_differences", f"WITH {_STATES} SELECT path, COUNT(*) AS n, ROUND({_CELLS['dd']}, 8) AS did FROM st GROUP BY path")
def differences(spark, sf_dir):
    return rounded(sm.difference_in_differences(_states(spark, sf_dir), "turnover", "up", "led", ["path"]))


@query("agg_32_yearly_contributions", f"WITH {_STATES}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY up, led) AS whole FROM st) SELECT YEAR(date)::INT AS year, COUNT(*) AS n, ROUND(SUM(CASE WHEN up = led THEN 1.0 ELSE -1.0 END * turnover / whole), 8) AS contribution FROM c GROUP BY 1")
def contributions(spark, sf_dir):
    return rounded(sm.yearly_contributions(_states(spark, sf_dir), "turnover", "up", "led"))


@query("agg_36_time_break", f"WITH {_PT}, g AS (SELECT path, AVG(r - b) FILTER (WHERE date < DATE '1998-07-01') AS before, AVG(r - b) FILTER (WHERE date >= DATE '1998-07-01') AS after FROM pt GROUP BY path) SELECT path, ROUND(before, 8) AS before, ROUND(after, 8) AS after, before * after < 0 AS changes_sign FROM g")
def time_break(spark, sf_dir):
    return rounded(sm.time_break(_paths(spark, sf_dir).withColumn("active", F.col("r") - F.col("b")), "active", "1998-07-01", ["path"]))


@query("agg_40_names_per_date", f"WITH {R.px()}, d AS (SELECT YEAR(date)::INT AS year, date, COUNT(*) AS n, COUNT(DISTINCT sid) AS names FROM px GROUP BY ALL) SELECT year, SUM(n)::BIGINT AS n_rows, COUNT(*) AS n_dates, QUANTILE_CONT(names, 0.5) AS median_names FROM d GROUP BY year")
def names_per_date(spark, sf_dir):
    return sm.names_per_date(panel.prices(spark, sf_dir).withColumn("year", F.year("date")), ["year"])


@query("agg_44_cell_contrast", f"WITH {_STATES}, g AS (SELECT SUM((up AND led)::INT)::BIGINT AS n_cell, AVG(turnover) FILTER (WHERE up AND led) AS c, AVG(turnover) FILTER (WHERE NOT (up AND led)) AS d FROM st) SELECT n_cell, ROUND(c, 8) AS cell_mean, ROUND(d, 8) AS rest_mean, ROUND(c - d, 8) AS contrast, c - d < -0.01 AS is_vetoed FROM g")
def cell_contrast(spark, sf_dir):
    return rounded(sm.cell_contrast(_states(spark, sf_dir), "up", "led", "turnover", 0.01))


@query("agg_45_attribution", f"WITH {_PT} SELECT path, SUM((b < 0)::INT)::BIGINT AS n_defended, ROUND(SUM(CASE WHEN b < 0 AND r < 0 THEN -r ELSE 0.0 END), 8) AS benefit, ROUND(SUM(CASE WHEN b < 0 AND r > 0 THEN r ELSE 0.0 END), 8) AS missed FROM pt GROUP BY path")
def attribution(spark, sf_dir):
    return rounded(sm.attribution(_paths(spark, sf_dir).withColumn("is_defended", F.col("b") < 0).withColumn("excess", F.col("r")), ["path"]))


@query("agg_46_alert_metrics", f"WITH {_PT}, g AS (SELECT path, COUNT(*) AS n, SUM((b > 0.02)::INT) AS a, SUM((r < -0.02)::INT) AS e, SUM((b > 0.02 AND r < -0.02)::INT) AS ae FROM pt GROUP BY path) SELECT path, n, ROUND(a / n, 8) AS alert_share, ROUND(ae / NULLIF(a, 0), 8) AS precision, ROUND(ae / NULLIF(e, 0), 8) AS recall, ROUND(ae / NULLIF(a, 0) / (NULLIF(e, 0) / n), 8) AS lift FROM g")
def alert_metrics(spark, sf_dir):
    return rounded(sm.alert_metrics(_paths(spark, sf_dir).withColumn("alert", F.col("b") > 0.02).withColumn("event", F.col("r") < -0.02), ["path"], "alert", "event"))


@query("agg_47_error_skill", f"WITH {_PT}, l AS (SELECT *, LAG(r) OVER (PARTITION BY path ORDER BY idx) AS naive FROM pt) SELECT path, COUNT(*) AS n, ROUND(AVG(ABS(b - r)), 8) AS mae, ROUND(AVG(ABS(naive - r)), 8) AS naive_mae, ROUND(1 - AVG(ABS(b - r)) / AVG(ABS(naive - r)), 8) AS skill FROM l WHERE naive IS NOT NULL GROUP BY path")
def error_skill(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return rounded(sm.error_skill(rows.withColumn("naive", F.lag("r").over(Window.partitionBy("path").orderBy("idx"))), ["path"], "b", "r", "naive"))


@query("agg_50_quintiles", f"WITH {_PT}, q AS (SELECT path, turnover, NTILE(5) OVER (PARTITION BY path ORDER BY b, idx) AS quintile FROM pt) SELECT path, quintile::INT AS quintile, COUNT(*) AS n, ROUND(AVG(turnover), 8) AS mean FROM q GROUP BY ALL")
def quintile_means(spark, sf_dir):
    return rounded(sm.quintiles(_paths(spark, sf_dir), F.struct("b", "idx"), "turnover", ["path"]))


@query("agg_52_rank_ic_by_date", f"WITH {R.px()}, h AS (SELECT date, sid, ROUND(close, 8) AS x, volume AS y FROM px WHERE close IS NOT NULL AND volume IS NOT NULL), k AS (SELECT date, {R.avg_rank('x', 'date')} AS rx, {R.avg_rank('y', 'date')} AS ry FROM h) SELECT date, COUNT(*) AS n, ROUND(CASE WHEN STDDEV_POP(rx) > 0 AND STDDEV_POP(ry) > 0 THEN CORR(rx, ry) END, 8) AS rank_ic FROM k GROUP BY date HAVING COUNT(*) >= 5")
def rank_ic(spark, sf_dir):
    return rounded(sm.rank_ic_by_date(panel.prices(spark, sf_dir).withColumn("close", F.round("close", 8)), "close", "volume", 5))


@query("agg_55_importance", "SELECT p_brand AS feature, COUNT(*) AS n, ROUND(AVG(p_size), 8) AS mean, ROUND(STDDEV_SAMP(p_size), 8) AS deviation FROM part GROUP BY 1")
def importance(spark, sf_dir):
    return rounded(sm.importance(panel.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "feature"), ["feature"], "p_size"))


# ---- joins with a contract
@query(
    "jon_02_source_panel",
    """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS signal_date, o_orderkey AS sid, o_orderpriority AS factor_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS raw_value, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE -o_totalprice END AS score, CASE WHEN o_orderkey % 5 = 0 THEN 'no_history' END AS missing_reason FROM orders)
SELECT signal_date, sid, factor_id, raw_value, score, score IS NOT NULL AS eligible, CASE WHEN score IS NULL THEN COALESCE(missing_reason, 'no_reason_given') END AS missing_reason, 'orders' AS source_panel FROM f WHERE DAY(signal_date) = 1""",
)
def source_panel(spark, sf_dir):
    o, k = panel.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    odd = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(-F.col("o_totalprice"))
    rows = o.select(F.to_date("o_orderdate").alias("signal_date"), k.alias("sid"), F.col("o_orderpriority").alias("factor_id"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("raw_value"), F.when(k % 5 != 0, odd).alias("score"), F.when(k % 5 == 0, "no_history").alias("missing_reason"))
    return ct.source_panel(rows, "orders", rows.where("DAY(signal_date) = 1").select("signal_date"))


_TAGGED = "fc AS (SELECT o_orderkey AS accession, 'T' || (o_orderkey % 6) AS tag, CAST(o_orderdate AS DATE) AS period_end, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(o_orderdate AS DATE) - (250 + (o_orderkey % 250))::INT AS DATE) END AS period_start, CASE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' WHEN o_orderkey % 6 = 2 THEN ' share ' ELSE 'usd' END AS unit FROM orders)"


def _tagged(spark, sf_dir):
    o, k = panel.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    end = F.to_date("o_orderdate")
    return o.select(k.alias("accession"), F.concat(F.lit("T"), (k % 6).cast("string")).alias("tag"), end.alias("period_end"), F.when(k % 6 != 0, F.date_sub(end, (250 + k % 250).cast("int"))).alias("period_start"), F.when(k % 13 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("value"), F.when(k % 11 == 0, "EUR").when(k % 6 == 2, " share ").otherwise("usd").alias("unit"))


@query("jon_03_tagged_facts", f"WITH {_TAGGED}, tg AS (SELECT * FROM (VALUES ('T0', 'assets', 'instant', 'USD'), ('T1', 'revenue', 'duration', 'USD'), ('T1', 'sales', 'duration', 'EUR'), ('T2', 'cost', 'duration', 'SHARES'), ('T9', 'none', 'instant', 'USD')) AS t(tag, metric_id, period_type, unit_family)) SELECT accession, metric_id, value, date_diff('day', period_start, period_end) AS duration_days FROM fc JOIN tg USING (tag) WHERE CASE WHEN period_type = 'instant' THEN period_start IS NULL ELSE date_diff('day', period_start, period_end) BETWEEN 300 AND 430 END AND NOT isnan(value) AND CASE WHEN unit_family = 'SHARES' THEN UPPER(trim(unit)) IN ('SHARE', 'SHARES') ELSE UPPER(trim(unit)) = unit_family END")
def tagged_facts(spark, sf_dir):
    tags = spark.createDataFrame([("T0", "assets", "instant", "USD"), ("T1", "revenue", "duration", "USD"), ("T1", "sales", "duration", "EUR"), ("T2", "cost", "duration", "SHARES"), ("T9", "none", "instant", "USD")], "tag string, metric_id string, period_type string, unit_family string")
    return ct.tagged_facts(_tagged(spark, sf_dir), tags).select("accession", "metric_id", "value", "duration_days")


@query("jon_04_indicator", "SELECT CASE WHEN c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS indicator, COUNT(*) AS n, COUNT(c_name) AS n_named FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) AS c ON c_custkey = o_custkey GROUP BY 1")
def indicator(spark, sf_dir):
    c = panel.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return ct.with_indicator(panel.table(spark, sf_dir, "orders"), c, ["o_custkey"]).groupBy("indicator").agg(F.count("*").alias("n"), F.count("c_name").alias("n_named"))


@query("jon_06_facts_with_filings", "WITH f AS (SELECT l_orderkey AS accession, CASE WHEN l_quantity > 25 THEN '10-K' ELSE '10-K/A' END AS form, CAST(l_shipdate AS DATE) AS filed FROM lineitem), j AS (SELECT f.*, CASE WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE '10-K/A' END AS ff, CAST(o_orderdate AS DATE) AS fd, o_orderkey FROM f LEFT JOIN orders ON o_orderkey = accession) SELECT COUNT(*) AS n, COUNT(o_orderkey) AS n_known, SUM((form <> ff)::INT)::BIGINT AS n_form, SUM((filed <> fd)::INT)::BIGINT AS n_filed, SUM((fd < filed - 30)::INT)::BIGINT AS n_early FROM j")
def with_filings(spark, sf_dir):
    form = lambda c: F.when(c, "10-K").otherwise("10-K/A")
    facts = panel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accession"), form(F.col("l_quantity") > 25).alias("form"), F.to_date("l_shipdate").alias("filed"))
    facts = facts.withColumn("period_end", F.date_sub("filed", 30))
    filings = panel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), form(F.col("o_orderkey") % 2 == 0).alias("form"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderdate").alias("accepted_at"))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return ct.with_filing(facts, filings).agg(F.count("*").alias("n"), F.count("accepted_at").alias("n_known"), count("form_mismatch").alias("n_form"), count("filed_mismatch").alias("n_filed"), count("accepted_before_period_end").alias("n_early"))


@query("jon_07_registered_tags", "SELECT p_partkey, (p_partkey % 5 IN (1, 2))::INT + 1 AS n_kept, CASE WHEN p_partkey % 5 = 1 THEN p_size END AS t1 FROM part")
def registered(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part")
    entries = F.map_from_arrays(F.array(F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string")), F.lit("kept"), F.lit("other")), F.array(F.col("p_size").cast("int"), F.lit(1), F.lit(2)))
    tags = ct.registered_tags(F.to_json(entries), "map<string,int>", ["t1", "t2", "kept"])
    return p.withColumn("tags", tags).select("p_partkey", F.size("tags").alias("n_kept"), F.try_element_at("tags", F.lit("t1")).alias("t1"))


@query("jon_13_by_frequency", f"WITH {R.spine()} SELECT f.frequency, COUNT(*) AS n, COUNT(close) AS n_prices FROM spine JOIN (SELECT 'monthly' AS frequency, date FROM cal WHERE month_last UNION ALL SELECT 'weekly', date FROM cal WHERE week_last) AS f USING (date) GROUP BY 1")
def by_frequency(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    m = panel.market(spark, sf_dir)
    schedules = m.where("month_last").select(F.lit("monthly").alias("frequency"), "date").union(m.where("week_last").select(F.lit("weekly").alias("frequency"), "date"))
    return ct.by_frequency(spine, schedules).groupBy("frequency").agg(F.count("*").alias("n"), F.count("close").alias("n_prices"))


@query("jon_15_development_rows", f"{SERIES}, l AS (SELECT date, r, LEAD(r, 4) OVER (ORDER BY idx) AS y, LEAD(date, 4) OVER (ORDER BY idx) AS label_end FROM s) SELECT date, ROUND(r, 8) AS r, ROUND(y, 8) AS y, label_end FROM l WHERE date < DATE '1999-01-01' AND label_end < DATE '1999-01-01'")
def development_rows(spark, sf_dir):
    s, over = series(spark, sf_dir), Window.orderBy("idx")
    targets = s.select("date", F.lead("r", 4).over(over).alias("y"), F.lead("date", 4).over(over).alias("label_end")).where("label_end < DATE'1999-01-01'")
    return rounded(ct.development_rows(s.select("date", "r").where("date < DATE'1999-01-01'"), targets, "1999-01-01"))


@query("jon_15_cardinality_faults", "WITH k AS (SELECT o_custkey AS k, COUNT(*) AS a FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, 1 AS b FROM customer) SELECT 'left' AS side, COUNT(*) AS n_keys, SUM((a > 1)::INT)::BIGINT AS n_repeated, SUM((b IS NULL)::INT)::BIGINT AS n_alone FROM k LEFT JOIN c USING (k) UNION ALL SELECT 'right', COUNT(*), 0, SUM((a IS NULL)::INT)::BIGINT FROM c LEFT JOIN k USING (k)")
def cardinality_faults(spark, sf_dir):
    return ct.cardinality_faults(panel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), panel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("jon_16_complete_arms", f"WITH {R.px(R.SIZE_GROUP)}, w AS (SELECT date, MAX(close) FILTER (WHERE sid = 'G0') AS G0, MAX(close) FILTER (WHERE sid = 'G1') AS G1 FROM px GROUP BY date), {R.MARKET_BARS} SELECT date, ROUND(G0, 8) AS G0, ROUND(G1, 8) AS G1, ROUND(b.close, 8) AS label, G0 IS NOT NULL AND G1 IS NOT NULL AS is_complete FROM w JOIN bars b USING (date)")
def complete_arms(spark, sf_dir):
    long = panel.prices(spark, sf_dir, panel.SIZE_GROUP).select("date", F.col("sid").alias("arm"), F.col("close").alias("score"))
    labels = panel.market(spark, sf_dir).select("date", F.col("close").alias("label"))
    return rounded(ct.complete_arms(long, ["G0", "G1"], labels))


# ---- tests of states
_HIGH = _draws(20, 100, True).replace("score, x FROM sh)", "score, x, score > (SELECT QUANTILE_CONT(score, 0.5) FROM sh) AS high, x > 0 AS up FROM sh)")


def _marked(spark, sf_dir):
    rows = _places(spark, sf_dir)
    middle = od.quantiles(rows, ["score"], {"middle": 0.5}).withColumnRenamed("score_middle", "middle")
    return rows.crossJoin(F.broadcast(middle)).withColumn("high", F.col("score") > F.col("middle")).withColumn("up", F.col("x") > 0).drop("middle")


@query("sta_14_bootstrap_rank_correlation", f"{_draws(20, 50, True)}, d AS (SELECT replicate, score, x FROM dr JOIN se USING (place)), k AS (SELECT replicate, {R.avg_rank('score', 'replicate')} AS a, {R.avg_rank('x', 'replicate')} AS b FROM d) SELECT replicate, ROUND(CORR(a, b), 7) AS value FROM k GROUP BY replicate")
def bootstrap_rank_correlation(spark, sf_dir):
    return rounded(inf.bootstrap_rank_correlation(_places(spark, sf_dir), "score", "x", 50), 7)


@query("sta_15_bootstrap_contrast", f"{_HIGH}, bv AS (SELECT replicate, AVG(x) FILTER (WHERE high) - AVG(x) FILTER (WHERE NOT high) AS value FROM dr JOIN se USING (place) GROUP BY replicate) SELECT ROUND(QUANTILE_CONT(value, 0.05), 7) AS lower, ROUND(QUANTILE_CONT(value, 0.95), 7) AS upper, ROUND(STDDEV_SAMP(value), 7) AS standard_error, ROUND((1 + SUM((value <= 0)::INT)) / (COUNT(value) + 1), 7) AS p_not_above_0 FROM bv")
def bootstrap_contrast(spark, sf_dir):
    contrast = F.avg(F.when(F.col("high"), F.col("x"))) - F.avg(F.when(~F.col("high"), F.col("x")))
    return rounded(inf.interval(inf.block_bootstrap(_marked(spark, sf_dir), contrast, 100)), 7)


@query("sta_16_correlation_difference", f"{_HIGH}, bv AS (SELECT replicate, CORR(score, x) - CORR(high::INT, x) AS value FROM dr JOIN se USING (place) GROUP BY replicate) SELECT ROUND(STDDEV_SAMP(value), 7) AS standard_error, COUNT(value) AS n FROM bv")
def correlation_difference(spark, sf_dir):
    draws = inf.block_bootstrap(_marked(spark, sf_dir), F.corr("score", "x") - F.corr(F.col("high").cast("double"), F.col("x")), 100)
    return rounded(draws.agg(F.stddev_samp("value").alias("standard_error"), F.count("value").alias("n")), 7)


@query("sta_24_bootstrap_did", f"{_HIGH}, bv AS (SELECT replicate, AVG(score) FILTER (WHERE high AND up) - AVG(score) FILTER (WHERE high AND NOT up) - (AVG(score) FILTER (WHERE NOT high AND up) - AVG(score) FILTER (WHERE NOT high AND NOT up)) AS value FROM dr JOIN se USING (place) GROUP BY replicate) SELECT replicate, ROUND(value, 7) AS value FROM bv")
def bootstrap_did(spark, sf_dir):
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    a, b = F.col("high"), F.col("up")
    return rounded(inf.block_bootstrap(_marked(spark, sf_dir), (mean(a & b) - mean(a & ~b)) - (mean(~a & b) - mean(~a & ~b)), 100), 7)


_TERCILE = f"{_SO}, t3 AS (SELECT idx, x AS y, NTILE(3) OVER (ORDER BY score, idx) AS third FROM sh), hl AS (SELECT idx, y, (third = 3)::INT::DOUBLE AS x FROM t3 WHERE third <> 2)"
_HAC = f"""c AS (SELECT idx, x, y, x - AVG(x) OVER () AS dx, y - AVG(y) OVER () AS dy FROM hl), b AS (SELECT *, SUM(dx * dy) OVER () / SUM(dx * dx) OVER () AS s FROM c), u AS (SELECT *, dx * (dy - s * dx) AS u FROM b),
l AS (SELECT *, {', '.join(f'LAG(u, {k}) OVER (ORDER BY idx) AS u{k}' for k in range(1, 6))} FROM u),
e AS (SELECT COUNT(*) AS n, MAX(s) AS slope, SQRT(SUM(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * COALESCE(SUM(u * u{k}), 0.0)' for k in range(1, 6))}) / SUM(dx * dx) AS se FROM l)"""


@query("sta_20_state_contrast", f"{_TERCILE}, {_HAC} SELECT n, ROUND(slope, 8) AS contrast, ROUND(se, 8) AS standard_error, ROUND(slope / se, 6) AS t, n >= 60 AND ABS(slope / se) > 1.96 AS passes FROM e")
def state_contrast(spark, sf_dir):
    out = inf.state_contrast(_so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL"), "score", "x", 5)
    return out.select("n", F.round("contrast", 8).alias("contrast"), F.round("standard_error", 8).alias("standard_error"), F.round("t", 6).alias("t"), "passes")


@query("sta_21_interaction", f"""{_SO}, mk AS (SELECT idx, x AS y, score > (SELECT QUANTILE_CONT(score, 0.5) FROM sh) AS a, date_part('month', date) <= 6 AS b FROM sh), ce AS (SELECT *, AVG(y) OVER (PARTITION BY a, b) AS m, COUNT(*) OVER (PARTITION BY a, b) AS k, CASE WHEN a = b THEN 1.0 ELSE -1.0 END AS s FROM mk),
u AS (SELECT idx, s * y / k AS part, s * (y - m) / k AS u FROM ce), l AS (SELECT *, {', '.join(f'LAG(u, {k}) OVER (ORDER BY idx) AS u{k}' for k in range(1, 6))} FROM u),
e AS (SELECT COUNT(*) AS n, SUM(part) AS did, SQRT(SUM(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * COALESCE(SUM(u * u{k}), 0.0)' for k in range(1, 6))}) AS se FROM l) SELECT n, ROUND(did, 8) AS did, ROUND(se, 8) AS standard_error, ROUND(did / se, 6) AS t FROM e""")
def interaction(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    middle = od.quantiles(rows, ["score"], {"middle": 0.5}).withColumnRenamed("score_middle", "middle")
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("a", F.col("score") > F.col("middle")).withColumn("b", F.month("date") <= 6)
    out = inf.interaction(rows, "x", "a", "b", 5)
    return out.select("n", F.round("did", 8).alias("did"), F.round("standard_error", 8).alias("standard_error"), F.round("t", 6).alias("t"))


_SEED = 3544864410  # of the text "family", as sta_27 makes it


@query("sta_31_seeded_p_value", f"{_draws(20, 100, True).replace('+ 7)', f'+ {_SEED})')}, bv AS (SELECT replicate, AVG(x) AS value FROM dr JOIN se USING (place) GROUP BY replicate) SELECT ROUND((1 + SUM((value <= 0)::INT)) / (COUNT(value) + 1), 8) AS p FROM bv")
def seeded_p(spark, sf_dir):
    draws = inf.block_bootstrap(_places(spark, sf_dir), F.avg("x"), 100, seed=_SEED)
    return rounded(inf.interval(draws).select(F.col("p_not_above_0").alias("p")))
