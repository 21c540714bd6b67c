"""Sources and sinks (SRC), contracts (VAL) and repair (REP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import repair as rp
from chronopanel.operators import validation as va
from chronopanel.plans import registry as R
from chronopanel.plans.pit_plans import INTERVALS, intervals
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.registry import query
from chronopanel.sources import documents as doc
from chronopanel.sources import panel, store


@query("src_14_company_tickers", "SELECT 'S' || s_suppkey AS ticker, s_suppkey AS cik, s_name AS name FROM supplier")
def tickers(spark, sf_dir):
    """Suppliers as JSON objects, one for each nation, and read back."""
    s = panel.table(spark, sf_dir, "supplier")
    entry = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik_str"), F.concat(F.lit(" "), "s_name").alias("title"))
    objects = s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), entry)))).alias("payload"))
    return doc.company_tickers(objects)


@query("src_15_filing_ledger", "SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 7 = 0 THEN '10-K/A' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS report_date, o_orderkey % 7 = 0 AS is_amendment FROM orders")
def ledger(spark, sf_dir):
    """Orders of a customer as parallel arrays, and read back."""
    o = panel.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderkey") % 7 == 0, "10-K/A").otherwise("10-K").alias("f"), day.alias("d"), F.when(F.col("o_orderkey") % 3 != 0, day).otherwise("").alias("r"))
    arrays = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(row).alias("x"))
    payload = F.to_json(F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.r").alias("reportDate")))
    return doc.filing_ledger(arrays.select("cik", payload.alias("payload")))


@query("src_17_numeric_facts", "SELECT o_custkey AS cik, 'gaap' AS taxonomy, o_orderpriority AS concept, 'Label' AS label, 'USD' AS unit, CAST(o_orderdate AS DATE) AS period_end, o_totalprice AS value, CAST(o_orderkey AS VARCHAR) AS accession, CAST(YEAR(o_orderdate) AS INT) AS fiscal_year, '10-K' AS form FROM orders")
def facts(spark, sf_dir):
    """Orders of a customer as a nested map of observations, and read back."""
    o = panel.table(spark, sf_dir, "orders")
    seen = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.year("o_orderdate").alias("fy"), F.lit("10-K").alias("form"))
    by = o.groupBy(F.col("o_custkey").alias("cik"), "o_orderpriority").agg(F.collect_list(seen).alias("obs"))
    concept = F.struct(F.lit("Label").alias("label"), F.create_map(F.lit("USD"), F.col("obs")).alias("units"))
    by = by.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", concept))).alias("concepts"))
    return doc.numeric_facts(by.select("cik", F.to_json(F.create_map(F.lit("gaap"), F.col("concepts"))).alias("payload")))


@query("src_11_observation_csv", "SELECT CAST(o_orderdate AS DATE) AS date, MAX(o_totalprice) FILTER (WHERE o_orderkey % 4 <> 0) AS value FROM orders GROUP BY 1")
def observations(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))).alias("v"))
    lines = daily.select(F.concat_ws(",", F.col("d").cast("string"), F.coalesce(F.col("v").cast("string"), F.lit("."))).alias("line"))
    return doc.observation_csv(lines.unionByName(spark.sql("SELECT 'DATE,VALUE' AS line")))


@query("src_24_membership_lines", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS sid FROM orders")
def membership(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    lines = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.array_join(F.collect_list(F.col("o_custkey").cast("string")), ", ").alias("l"))
    return doc.membership_lines(lines.select(F.concat(F.col("d").cast("string"), F.lit(',"'), "l", F.lit('"')).alias("line")))


@query("src_05_total_return_bars", f"WITH {R.px()} SELECT date, sid, open * ((close * 1.5) / close) AS tr_open, close * 1.5 AS tr_close FROM px")
def total_return(spark, sf_dir):
    bars = panel.prices(spark, sf_dir).select("date", "sid", F.col("open").alias("raw_open"), F.col("close").alias("raw_close"), (F.col("close") * 1.5).alias("adjusted_close"))
    return doc.unadjusted_to_total_return(bars).select("date", "sid", "tr_open", "tr_close")


@query("src_34_row_hashes", "SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_nationkey || '|' || COALESCE(c_mktsegment, '\\N')) AS row_sha256 FROM customer")
def row_hashes(spark, sf_dir):
    c = panel.table(spark, sf_dir, "customer")
    return store.with_row_hash(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).select("c_custkey", "row_sha256")


_PIECE = "CAST('0x' || substr(h, {}, 15) AS BIGINT)"


@query("src_35_content_hash", f"WITH h AS (SELECT sha256(c_custkey || '|' || c_name || '|' || c_nationkey) AS h FROM customer) SELECT COUNT(*) AS n_rows, sha256(COUNT(*) || ':' || SUM({_PIECE.format(1)}::HUGEINT) || ':' || SUM({_PIECE.format(16)}::HUGEINT)) AS content FROM h")
def content(spark, sf_dir):
    return store.content_hash(panel.table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query("src_31_primary_with_recovery", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN 'primary' ELSE 'recovery' END AS feed FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def recovery(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return store.primary_with_recovery(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@query(
    "src_33_reconciliation",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, ROUND(a.v, 2) AS a, ROUND(b.v, 2) AS b, ROUND(ABS(a.v - b.v), 6) AS difference, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' WHEN ABS(a.v - b.v) <= 0.01 THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b USING (o_orderkey)""",
)
def reconciliation(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = o.where("o_orderkey % 2 = 0").withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    out = store.reconciliation(o.where("o_orderkey % 3 <> 0"), b, ["o_orderkey"], "v", 0.01)
    return out.select("o_orderkey", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("difference", 6).alias("difference"), "status")


@query("src_39_catalog", "SELECT 'customer' AS view, COUNT(*) AS n_rows FROM customer UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'orders', COUNT(*) FROM orders")
def catalog(spark, sf_dir):
    return store.register_views(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("customer", "nation", "orders")})


@query("src_42_filtered_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-30' AND l_quantity > 45")
def filtered(spark, sf_dir):
    return panel.table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP'1995-06-30' AND l_quantity > 45").select("l_orderkey", "l_quantity")


@query("src_29_benchmark_slice", f"WITH {R.px()} SELECT date, close, open FROM px WHERE sid = 'Brand#1' AND open > 0 AND close > 0")
def benchmark(spark, sf_dir):
    return panel.prices(spark, sf_dir).where("sid = 'Brand#1' AND open > 0 AND close > 0").select("date", "close", "open")


# ---- contracts
@query("val_01_canonical_prices", "SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS sid, value FROM events")
def canonical_prices(spark, sf_dir):
    return va.canonical_prices(panel.table(spark, sf_dir, "events"), "ts", "user_id", ["value"])


_BARS = f"WITH {R.px()}, b AS (SELECT date, sid, open, close, CASE WHEN volume % 7 = 0 THEN open / 2 ELSE GREATEST(open, close) END AS high, CASE WHEN volume % 5 = 0 THEN close * 2 ELSE LEAST(open, close) END AS low FROM px)"


@query("val_02_price_faults", f"{_BARS} SELECT * FROM (SELECT date, sid, CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'not_positive' WHEN high * (1 + 1e-12) < GREATEST(open, close) THEN 'high_below' WHEN low * (1 - 1e-12) > LEAST(open, close) THEN 'low_above' END AS fault FROM b) AS q WHERE fault IS NOT NULL")
def price_faults(spark, sf_dir):
    p = panel.prices(spark, sf_dir)
    bars = p.select("date", "sid", "open", "close", F.when(F.col("volume") % 7 == 0, F.col("open") / 2).otherwise(F.greatest("open", "close")).alias("high"), F.when(F.col("volume") % 5 == 0, F.col("close") * 2).otherwise(F.least("open", "close")).alias("low"))
    return va.price_faults(bars)


_MASK = f"{INTERVALS}, ov AS (SELECT 'o' || sid AS override_id, sid AS of_sid, effective_from AS a, CAST(effective_from + 60 AS DATE) AS b, sid LIKE '%1' AS is_closed FROM iv)"


def _overrides(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return iv.select(F.concat(F.lit("o"), "sid").alias("override_id"), "sid", F.col("effective_from").alias("start_date"), F.date_add("effective_from", 60).alias("end_date"), F.col("sid").like("%1").alias("is_closed"))


@query("val_04_masked_prices", f"WITH {R.px()}, {_MASK} SELECT date, sid, CASE WHEN override_id IS NULL THEN close END AS close, override_id FROM px LEFT JOIN ov ON sid = of_sid AND date >= a AND (CASE WHEN is_closed THEN date <= b ELSE date < b END)")
def masked(spark, sf_dir):
    p = panel.prices(spark, sf_dir).select("date", "sid", "close")
    return va.masked(p, _overrides(spark, sf_dir), ["close"])


@query("val_04_mask_audit", f"WITH {R.spine()}, {_MASK}, j AS (SELECT override_id, close FROM spine JOIN ov ON sid = of_sid AND date >= a AND (CASE WHEN is_closed THEN date <= b ELSE date < b END)) SELECT ov.override_id, COUNT(j.override_id) AS n_rows, COUNT(close) AS n_masked, COUNT(j.override_id) - COUNT(close) AS n_already_missing FROM ov LEFT JOIN j USING (override_id) GROUP BY 1")
def mask_audit(spark, sf_dir):
    return va.mask_audit(panel.spine(panel.prices(spark, sf_dir)), _overrides(spark, sf_dir), "close")


@query(
    "val_06_action_faults",
    """WITH a AS (SELECT o_orderkey AS action_id, ['cash', 'stock', 'mixed', 'worthless', 'other'][o_orderkey % 5 + 1] AS t, CASE WHEN o_orderkey % 5 IN (0, 2) THEN o_totalprice END AS cash, CASE WHEN o_orderkey % 5 IN (1, 2) OR o_orderkey % 11 = 0 THEN 0.5 END AS ratio, CAST(o_orderdate AS DATE) AS legal_date, CAST(o_orderdate + (o_orderkey % 4 - 1) * INTERVAL 1 DAY AS DATE) AS apply_session, o_custkey % 700 AS source_sid FROM orders),
f AS (SELECT action_id, CASE WHEN NOT (CASE t WHEN 'cash' THEN COALESCE(cash, 0) > 0 AND COALESCE(ratio, 0) = 0 WHEN 'stock' THEN COALESCE(cash, 0) = 0 AND COALESCE(ratio, 0) > 0 WHEN 'mixed' THEN COALESCE(cash, 0) > 0 AND COALESCE(ratio, 0) > 0 WHEN 'worthless' THEN COALESCE(cash, 0) = 0 AND COALESCE(ratio, 0) = 0 ELSE false END) THEN 'wrong_terms' WHEN apply_session < legal_date THEN 'applied_early' WHEN COUNT(*) OVER (PARTITION BY source_sid) > 1 THEN 'source_repeated' END AS fault FROM a)
SELECT * FROM f WHERE fault IS NOT NULL""",
)
def action_faults(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    kinds = F.array(*(F.lit(x) for x in ("cash", "stock", "mixed", "worthless", "other")))
    ledger = o.select(
        F.col("o_orderkey").alias("action_id"), F.element_at(kinds, (k + 1).cast("int")).alias("action_type"), F.when(k.isin(0, 2), F.col("o_totalprice")).alias("cash"), F.when(k.isin(1, 2) | (F.col("o_orderkey") % 11 == 0), 0.5).alias("ratio"),
        F.to_date("o_orderdate").alias("legal_date"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4 - 1).cast("int")).alias("apply_session"), (F.col("o_custkey") % 700).alias("source_sid"),
    )
    return va.action_faults(ledger)


@query("val_08_assets_on", f"WITH {INTERVALS} SELECT sid, CASE WHEN sid LIKE '%1' THEN 'P' || sid ELSE sid END AS symbol FROM iv WHERE effective_from <= DATE '1996-06-30' AND (effective_to IS NULL OR DATE '1996-06-30' < effective_to)")
def assets(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    master = iv.select("sid", F.when(F.col("sid").like("%1"), F.concat(F.lit("P"), "sid")).alias("provider_sid"), F.col("sid").alias("ticker"), F.col("effective_from").alias("valid_from"), F.col("effective_to").alias("valid_to"))
    return va.assets_on(master, "1996-06-30")


_EXTREME = f"WITH {R.spine()}, k AS (SELECT *, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spine), ex AS (SELECT date, sid, LN(close) - LN(b) AS v FROM k WHERE close > 0 AND b > 0 AND ABS(LN(close) - LN(b)) > LN(2.0))"


@query("val_16_extreme_returns", f"{_EXTREME} SELECT date, sid, ROUND(v, 8) AS log_return FROM ex")
def extreme(spark, sf_dir):
    import math

    return rounded(va.extreme_returns(panel.spine(panel.prices(spark, sf_dir)), math.log(2)))


@query("val_17_reviewed_outliers", f"{_EXTREME} SELECT date, sid, ROUND(v, 8) AS log_return, CASE WHEN sid LIKE '%2' THEN 'accepted' ELSE 'unreviewed' END AS status FROM ex")
def reviewed(spark, sf_dir):
    e = extreme(spark, sf_dir)
    return va.reviewed(e, e.where("sid LIKE '%2'").select("date", "sid", F.lit("accepted").alias("status")))


@query(
    "val_18_panel_gates",
    f"""WITH {R.spine()}, d AS (SELECT date, AVG((close IS NOT NULL)::INT) AS c, SUM((close IS NOT NULL AND open IS NULL)::INT) AS p FROM spine GROUP BY date)
SELECT 'least_coverage' AS gate, ROUND(MIN(c), 8) AS value, MIN(c) >= 0.5 AS passes FROM d UNION ALL SELECT 'mean_coverage', ROUND(AVG(c), 8), AVG(c) >= 0.5 FROM d UNION ALL SELECT 'repeated_keys', 0.0, true UNION ALL SELECT 'partial_bars', SUM(p)::DOUBLE, SUM(p) = 0 FROM d""",
)
def gates(spark, sf_dir):
    return rounded(va.panel_gates(panel.spine(panel.prices(spark, sf_dir)), 0.5, 0.5))


@query("val_22_metric_identity", f"WITH {R.px()}, n AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT sid FROM px) AS q) SELECT n, 0.5::DOUBLE AS max_difference, false AS is_identical FROM n")
def metric_identity(spark, sf_dir):
    m = panel.prices(spark, sf_dir).groupBy("sid").agg(F.count("*").cast("double").alias("n"))
    return va.metric_identity(m, m.withColumn("n", F.col("n") + F.when(F.col("sid") == "Brand#1", 0.5).otherwise(0.0)), ["sid"], ["n"])


# ---- repair
_EXITS = f"WITH {R.spine()}, {INTERVALS}, ee AS (SELECT sid, (SELECT MIN(idx) FROM cal WHERE date >= effective_to) AS exit_idx FROM iv WHERE effective_to IS NOT NULL)"


def _exits(spark, sf_dir, spine):
    days = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").select("idx", "date")
    ends = intervals(spark, sf_dir).where("effective_to IS NOT NULL")
    return ends.join(F.broadcast(days), F.col("date") >= F.col("effective_to")).groupBy("sid").agg(F.min("idx").alias("exit_idx"))


@query("rep_02_best_donors", f"WITH {R.px()}, n AS (SELECT sid AS donor, COUNT(*) AS n_valid FROM px GROUP BY sid), c AS (SELECT a.donor AS sid, b.donor, ABS(CAST(substr(a.donor, 7) AS INT) - CAST(substr(b.donor, 7) AS INT)) AS priority, b.n_valid FROM n a, n b WHERE a.donor <> b.donor AND b.n_valid >= 1530) SELECT sid, donor, priority, n_valid FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY sid ORDER BY priority, donor) = 1")
def donors(spark, sf_dir):
    p = panel.prices(spark, sf_dir)
    names = p.select("sid").distinct()
    number = lambda c: F.substring(c, 7, 9).cast("int")
    return rp.best_donors(rp.nearest_donors(names.withColumn("number", number("sid")), p, 1530), p, 1530)


@query("rep_04_remapped", f"WITH {R.px()} SELECT CASE WHEN sid = 'Brand#1' THEN 'Brand#2' ELSE sid END AS sid, COUNT(*) AS n FROM px GROUP BY 1")
def remapped(spark, sf_dir):
    mapping = spark.sql("SELECT 'Brand#1' AS source_sid, 'Brand#2' AS canonical_sid")
    return rp.remapped(panel.prices(spark, sf_dir).select("date", "sid"), mapping).groupBy("sid").agg(F.count("*").alias("n"))


@query("rep_05_exits", f"{_EXITS}, o AS (SELECT ee.sid, exit_idx, COUNT(open) AS n FROM ee JOIN spine ON spine.sid = ee.sid AND idx >= exit_idx AND idx < exit_idx + 5 GROUP BY 1, 2) SELECT sid, exit_idx, n AS n_opens_ahead, CASE WHEN n = 5 THEN 'continues' WHEN sid LIKE '%1' THEN 'action' ELSE 'unavailable' END AS status FROM o")
def exits(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    e = _exits(spark, sf_dir, spine)
    return rp.exits(e, spine, e.where("sid LIKE '%1'").select("sid"))


@query("rep_06_liquidations", f"{_EXITS}, l AS (SELECT ee.sid, exit_idx, ARG_MAX(close, idx) AS c, exit_idx - MAX(idx) AS age FROM ee JOIN spine ON spine.sid = ee.sid AND idx < exit_idx AND close IS NOT NULL GROUP BY 1, 2) SELECT sid, exit_idx, CASE WHEN age <= 2 THEN c END AS price, age FROM l")
def liquidations(spark, sf_dir):
    spine = panel.spine(panel.prices(spark, sf_dir))
    return rp.liquidations(_exits(spark, sf_dir, spine), spine, 2)


@query("rep_13_gap_returns", f"WITH {R.spine()}, k AS (SELECT sid, idx, idx - LAG(idx) OVER w AS gap, close / LAG(close) OVER w - 1 AS v FROM spine WHERE close IS NOT NULL WINDOW w AS (PARTITION BY sid ORDER BY idx)) SELECT sid, idx, gap, ROUND(v, 8) AS gap_return FROM k WHERE gap >= 4")
def gaps(spark, sf_dir):
    return rounded(rp.gap_returns(panel.spine(panel.prices(spark, sf_dir)), 4))


# ---- joins of repaired and derived series
@query("jon_11_relative_strength", f"WITH {R.px(R.SIZE_GROUP)}, {R.MARKET_BARS}, r AS (SELECT date, LN(a.close) - LN(b.close) AS q FROM (SELECT * FROM px WHERE sid = 'G0') a LEFT JOIN bars b USING (date)), s AS (SELECT date, -(q - LAG(q, 63) OVER (ORDER BY date)) AS v FROM r) SELECT date, ROUND(v, 8) AS score FROM s")
def relative_strength(spark, sf_dir):
    one = panel.prices(spark, sf_dir, panel.SIZE_GROUP).where("sid = 'G0'").select("date", "close")
    m = panel.market(spark, sf_dir).select("date", F.col("close").alias("mc"))
    q = F.log("close") - F.log("mc")
    joined = one.join(m, "date", "left").withColumn("q", q)
    return joined.select("date", F.round(-(F.col("q") - F.lag("q", 63).over(Window.orderBy("date"))), 8).alias("score"))


@query("jon_14_state_panel", f"WITH {R.px(R.SIZE_GROUP)} SELECT * FROM (SELECT date, {', '.join(f'''MAX(close) FILTER (WHERE sid = 'G{k}') AS G{k}''' for k in range(5))} FROM px GROUP BY date) AS q WHERE {' AND '.join(f'G{k} IS NOT NULL' for k in range(5))}")
def state_panel(spark, sf_dir):
    wide = panel.prices(spark, sf_dir, panel.SIZE_GROUP).groupBy("date").pivot("sid", [f"G{k}" for k in range(5)]).agg(F.first("close"))
    return wide.dropna()


@query("jon_17_volume_coverage", f"WITH {R.spine()}, {INTERVALS}, mb AS (SELECT spine.sid, date, volume, close FROM spine JOIN iv ON iv.sid = spine.sid AND effective_from <= date AND (effective_to IS NULL OR date < effective_to)) SELECT sid, COUNT(*) AS n_member_days, COUNT(close) AS n_prices, ROUND(COUNT(close) / COUNT(*), 8) AS price_share, ROUND(COUNT(volume) FILTER (WHERE close IS NOT NULL) / COUNT(close), 8) AS volume_share FROM mb GROUP BY sid")
def volume_coverage(spark, sf_dir):
    iv = intervals(spark, sf_dir).withColumnRenamed("sid", "of_sid")
    spine = panel.spine(panel.prices(spark, sf_dir))
    inside = (F.col("sid") == F.col("of_sid")) & (F.col("effective_from") <= F.col("date")) & (F.col("effective_to").isNull() | (F.col("date") < F.col("effective_to")))
    members = spine.join(F.broadcast(iv), inside)
    out = members.groupBy("sid").agg(F.count("*").alias("n_member_days"), F.count("close").alias("n_prices"), (F.count("close") / F.count("*")).alias("price_share"), F.try_divide(F.count(F.when(F.col("close").isNotNull(), F.col("volume"))), F.count("close")).alias("volume_share"))
    return rounded(out)
