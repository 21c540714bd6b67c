"""Facts of filings put to use (FUN) and names within their dates (PIT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import fundamentals as fu
from chronopanel.operators import point_in_time as pit
from chronopanel.plans.pit_plans import _FILINGS, filings
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.registry import query
from chronopanel.sources import panel

# three metrics for each customer and year from their orders; some are missing, ambiguous, without a unit or of another period
_FACTS = """ft AS (SELECT o_custkey AS entity, YEAR(o_orderdate)::INT AS fiscal_year, ['revenue', 'cost', 'assets'][o_orderkey % 3 + 1] AS metric_id, CASE WHEN o_orderkey % 29 <> 0 THEN ROUND(o_totalprice / 50000) END AS value, CASE WHEN o_orderkey % 13 <> 0 THEN 'USD' END AS unit, make_date(YEAR(o_orderdate), CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END, 1) AS period_start FROM orders),
rq AS (SELECT entity, fiscal_year, metric_id, COUNT(DISTINCT COALESCE(value, -1)) AS n, MAX(value) AS value, BOOL_OR(value IS NULL) AS invalid, BOOL_OR(unit IS NULL) AS no_unit, MAX(period_start) AS start FROM ft GROUP BY ALL),
rs AS (SELECT *, CASE WHEN n > 1 THEN 'ambiguous' WHEN invalid THEN 'invalid' WHEN no_unit THEN 'missing_unit' END AS state FROM rq),
rw AS (SELECT entity, fiscal_year, MAX(value) FILTER (WHERE metric_id = 'revenue') AS revenue, MAX(value) FILTER (WHERE metric_id = 'cost') AS cost, MAX(value) FILTER (WHERE metric_id = 'assets') AS assets,
  NULLIF(concat_ws(';', CASE WHEN COUNT(*) FILTER (WHERE metric_id = 'revenue') = 0 THEN 'missing_metric:revenue' ELSE MAX(state || ':revenue') FILTER (WHERE metric_id = 'revenue') END, CASE WHEN COUNT(*) FILTER (WHERE metric_id = 'cost') = 0 THEN 'missing_metric:cost' ELSE MAX(state || ':cost') FILTER (WHERE metric_id = 'cost') END,
    CASE WHEN COUNT(*) FILTER (WHERE metric_id = 'assets') = 0 THEN 'missing_metric:assets' ELSE MAX(state || ':assets') FILTER (WHERE metric_id = 'assets') END, CASE WHEN COUNT(DISTINCT start) FILTER (WHERE metric_id IN ('revenue', 'cost')) > 1 THEN 'different_periods' END), '') AS reason FROM rs GROUP BY 1, 2)"""


def _facts(spark, sf_dir):
    o, k = panel.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    metrics = F.array(*(F.lit(m) for m in ("revenue", "cost", "assets")))
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("entity"), year.alias("fiscal_year"), F.element_at(metrics, (k % 3 + 1).cast("int")).alias("metric_id"), F.when(k % 29 != 0, F.round(F.col("o_totalprice") / 50000)).alias("value"),
        F.when(k % 13 != 0, "USD").alias("unit"), F.make_date(year, F.when(k % 7 == 0, 2).otherwise(1), F.lit(1)).alias("period_start"), k.alias("accession"),
    )


@query("fun_15_required_metrics", f"WITH {_FACTS} SELECT entity, fiscal_year, CASE WHEN reason IS NULL THEN revenue END AS revenue, CASE WHEN reason IS NULL THEN cost END AS cost, CASE WHEN reason IS NULL THEN assets END AS assets, reason FROM rw")
def required(spark, sf_dir):
    return fu.required(_facts(spark, sf_dir), ["revenue", "cost", "assets"], ["revenue", "cost"])


_YEARS = "yr AS (SELECT o_custkey AS entity, YEAR(o_orderdate)::INT AS fiscal_year, MAX(o_totalprice) AS assets, MAX(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS current_assets, MIN(o_totalprice) AS cash, MIN(o_totalprice) FILTER (WHERE o_orderkey % 3 <> 0) AS current_liabilities, COUNT(*)::DOUBLE AS short_debt, MAX(o_orderkey % 1000)::DOUBLE AS taxes_payable, MAX(o_orderkey % 100)::DOUBLE AS depreciation FROM orders GROUP BY 1, 2)"
_MOVED = ["current_assets", "cash", "current_liabilities", "short_debt", "taxes_payable"]


def _years(spark, sf_dir):
    o, k, price = panel.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.max(price).alias("assets"), F.max(F.when(k % 2 == 0, price)).alias("current_assets"), F.min(price).alias("cash"), F.min(F.when(k % 3 != 0, price)).alias("current_liabilities"),
        F.count("*").cast("double").alias("short_debt"), F.max(k % 1000).cast("double").alias("taxes_payable"), F.max(k % 100).cast("double").alias("depreciation"),
    )


_NEEDED = [*_MOVED, *(f"prior_{c}" for c in _MOVED), "depreciation", "assets", "prior_assets"]


@query(
    "fun_10_sloan_accruals",
    f"""WITH {_YEARS}, bo AS (SELECT a.*, {', '.join(f'b.{c} AS prior_{c}' for c in [*_MOVED, 'assets'])} FROM yr a LEFT JOIN yr b ON b.entity = a.entity AND b.fiscal_year = a.fiscal_year - 1),
re AS (SELECT *, NULLIF(concat_ws(';', {', '.join(f"CASE WHEN {c} IS NULL THEN 'missing_metric:{c}' END" for c in _NEEDED)}), '') AS reason FROM bo)
SELECT entity, fiscal_year, CASE WHEN reason IS NULL THEN ROUND(((current_assets - prior_current_assets) - (cash - prior_cash) - ((current_liabilities - prior_current_liabilities) - (short_debt - prior_short_debt) - (taxes_payable - prior_taxes_payable)) - depreciation) / ((assets + prior_assets) / 2), 8) END AS value, reason FROM re""",
)
def sloan(spark, sf_dir):
    both = fu.with_prior_year(_years(spark, sf_dir), [*_MOVED, "assets"])
    return rounded(fu.sloan_accruals(both).drop("score"))


@query("fun_13_net_payout_yield", "WITH f AS (SELECT o_orderkey AS entity, CAST(o_orderdate AS DATE) AS signal_date, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100 END AS d, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 200 END AS r, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 400 END AS i, CASE WHEN o_orderkey % 6 <> 1 THEN o_totalprice * 10 END AS me, CASE WHEN o_orderkey % 6 = 1 AND o_orderkey % 2 = 1 AND o_orderkey % 4 = 1 THEN 'stale' END AS reason FROM orders), g AS (SELECT *, CASE WHEN d IS NULL AND r IS NULL AND i IS NULL THEN 'no_payout_reported' ELSE COALESCE(reason, CASE WHEN me IS NULL THEN 'no_measurement' END) END AS why FROM f) SELECT signal_date, entity, CASE WHEN why IS NULL THEN ROUND((COALESCE(d, 0) + COALESCE(r, 0) - COALESCE(i, 0)) / me, 8) END AS value, why AS reason FROM g")
def payout(spark, sf_dir):
    o, k, price = panel.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    keys = [F.to_date("o_orderdate").alias("signal_date"), k.alias("entity")]
    flows = o.select(*keys, F.when(k % 3 == 0, price / 100).alias("dividends"), F.when(k % 4 == 0, price / 200).alias("repurchases"), F.when(k % 5 == 0, price / 400).alias("issuance"))
    equity = o.select(*keys, F.when(k % 6 != 1, price * 10).alias("market_equity"), F.when((k % 6 == 1) & (k % 4 == 1), "stale").alias("reason"))
    return rounded(fu.net_payout_yield(flows, equity))


@query(
    "fun_06_coverage_checks",
    f"""WITH {_FACTS.split(',' + chr(10) + 'rq')[0].replace('SELECT o_custkey', 'SELECT o_orderkey AS accession, o_custkey')}, fi AS (SELECT o_orderkey AS accession FROM orders WHERE o_orderkey % 4 <> 0), fa AS (SELECT * FROM ft WHERE accession % 9 <> 0), ca AS (SELECT * FROM fa WHERE value > 2),
c AS (SELECT 'filings_with_facts' AS check_id, 'all' AS "group", COUNT(*) FILTER (WHERE accession % 9 <> 0) AS numerator, COUNT(*) AS denominator FROM fi UNION ALL SELECT 'facts_with_filing', 'all', COUNT(*) FILTER (WHERE accession % 4 <> 0), COUNT(*) FROM fa UNION ALL SELECT 'metric_coverage', metric_id, COUNT(DISTINCT accession), (SELECT COUNT(*) FROM fi) FROM ca GROUP BY metric_id)
SELECT check_id, "group", numerator, denominator, ROUND(numerator / denominator, 8) AS coverage, CASE WHEN numerator / denominator >= 0.7 THEN 'pass' ELSE 'fail' END AS status FROM c""",
)
def coverage_checks(spark, sf_dir):
    facts = _facts(spark, sf_dir).where("accession % 9 <> 0")
    known = panel.table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("accession"))
    return rounded(fu.coverage_checks(known, facts, facts.where("value > 2"), 0.7))


@query(
    "fun_07_factor_panel",
    f"""WITH {_FILINGS}, y AS (SELECT signal_date, entity, fiscal_year, MAX_BY({{'a': accession, 'v': value, 'p': period_end}}, {{'d': available, 'a': accession}}) AS r FROM fl JOIN sg ON available <= signal_date GROUP BY ALL), k AS (SELECT * FROM y QUALIFY ROW_NUMBER() OVER (PARTITION BY signal_date, entity ORDER BY r.p DESC, fiscal_year DESC) = 1),
va AS (SELECT signal_date, entity, 'size' AS factor_id, k.r.v AS value, NULL AS reason FROM k UNION ALL SELECT signal_date, entity, 'odd', CASE WHEN k.r.a % 2 = 1 THEN k.r.v END, CASE WHEN k.r.a % 2 = 0 THEN 'even_accession' END FROM k),
mp AS (SELECT 'S' || (c_custkey % 400) AS sid, c_custkey AS entity, DATE '1995-01-01' + (c_custkey % 900)::INT AS a, CASE WHEN c_custkey % 3 = 0 THEN DATE '1998-06-30' END AS z FROM customer),
nm AS (SELECT signal_date, sid, MIN(entity) AS entity, COUNT(DISTINCT entity) AS n FROM mp JOIN sg ON a <= signal_date AND (z IS NULL OR signal_date < z) GROUP BY ALL)
SELECT nm.signal_date, sid, f.factor_id, CASE WHEN n = 1 THEN va.value END AS value, CASE WHEN n = 1 THEN nm.entity END AS entity, CASE WHEN n > 1 THEN 'ambiguous_mapping' WHEN va.entity IS NULL THEN 'no_value' ELSE va.reason END AS reason
FROM nm CROSS JOIN (SELECT UNNEST(['size', 'odd']) AS factor_id) AS f LEFT JOIN va ON va.signal_date = nm.signal_date AND va.entity = nm.entity AND va.factor_id = f.factor_id""",
)
def factor_panel(spark, sf_dir):
    current = filings(spark, sf_dir).select("signal_date", "entity", F.col("current_value").alias("v"), F.col("current_accession").alias("a"))
    odd = F.col("a") % 2 == 1
    values = current.select("signal_date", "entity", F.lit("size").alias("factor_id"), F.col("v").alias("value"), F.lit(None).cast("string").alias("reason"))
    values = values.union(current.select("signal_date", "entity", F.lit("odd"), F.when(odd, F.col("v")), F.when(~odd, "even_accession")))
    c = F.col("c_custkey")
    start = F.date_add(F.to_date(F.lit("1995-01-01")), (c % 900).cast("int"))
    mappings = panel.table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), (c % 400).cast("string")).alias("sid"), c.alias("entity"), start.alias("effective_from"), F.when(c % 3 == 0, F.to_date(F.lit("1998-06-30"))).alias("effective_to"))
    return fu.factor_panel(values, mappings, current.select("signal_date").distinct())


@query("pit_07_scoped_snapshots", "WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'C' || (o_custkey % 50) AS sid FROM orders WHERE DAY(o_orderdate) = 1), a AS (SELECT MAX(date) AS anchor FROM s WHERE date <= DATE '1996-06-15') SELECT date, sid FROM s, a WHERE date >= anchor AND date <= DATE '1998-12-31' AND sid IN (SELECT 'C' || (c_custkey % 50) FROM customer WHERE c_custkey % 50 < 20)")
def scoped_snapshots(spark, sf_dir):
    name = lambda c: F.concat(F.lit("C"), (F.col(c) % 50).cast("string"))
    s = panel.table(spark, sf_dir, "orders").where("DAY(o_orderdate) = 1").select(F.to_date("o_orderdate").alias("date"), name("o_custkey").alias("sid"))
    allowed = panel.table(spark, sf_dir, "customer").where("c_custkey % 50 < 20").select(name("c_custkey").alias("sid"))
    return pit.scoped_snapshots(s, allowed, "1996-06-15", "1998-12-31")
