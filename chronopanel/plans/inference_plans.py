"""Inference (STA), models (MOD), fundamentals (FUN) and names (STR)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import text as tx
from chronopanel.operators import factor_database as db
from chronopanel.operators import fundamentals as fu
from chronopanel.operators import inference as inf
from chronopanel.operators import models as mo
from chronopanel.operators import point_in_time as pit
from chronopanel.plans import registry as R
from chronopanel.plans.factor_plans import _LONG, _long
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.regime_plans import VOL, volatility
from chronopanel.plans.registry import query
from chronopanel.sources import panel

# a score (volatility) and an outcome (a bad next day) on the market series
_SO = f"{VOL}, so AS (SELECT date, idx, ROUND(rv, 9) AS score, LEAD(r) OVER (ORDER BY idx) < -0.1 AS y, ROUND(LEAD(r) OVER (ORDER BY idx), 9) AS x FROM v), sh AS (SELECT * FROM so WHERE score IS NOT NULL AND x IS NOT NULL)"


def _so(spark, sf_dir):
    over = Window.orderBy("idx")
    return volatility(spark, sf_dir).select("date", "idx", F.round("rv", 9).alias("score"), (F.lead("r").over(over) < -0.1).alias("y"), F.round(F.lead("r").over(over), 9).alias("x"))


def _avg_rank(x: str) -> str:
    return f"(RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


@query("sta_02_auc", f"{_SO}, k AS (SELECT y::INT AS y, {_avg_rank('score')} AS rank FROM sh) SELECT COUNT(*) AS n, SUM(y)::BIGINT AS n_positive, ROUND((SUM(rank * y) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))), 8) AS auc FROM k")
def auc(spark, sf_dir):
    return rounded(inf.auc(_so(spark, sf_dir), "score", "y"))


@query("sta_04_average_precision", f"{_SO}, k AS (SELECT y, SUM(y::INT) OVER (ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING) / ROW_NUMBER() OVER (ORDER BY score DESC, idx) AS p FROM sh) SELECT ROUND(AVG(p) FILTER (WHERE y), 8) AS average_precision FROM k")
def average_precision(spark, sf_dir):
    return rounded(inf.average_precision(_so(spark, sf_dir), "score", "y", "idx"))


@query("sta_05_spearman", f"{_SO}, k AS (SELECT {_avg_rank('score')} AS a, {_avg_rank('x')} AS b FROM sh) SELECT COUNT(*) AS n, ROUND(CORR(a, b), 8) AS spearman FROM k")
def spearman(spark, sf_dir):
    return rounded(inf.spearman(_so(spark, sf_dir), "score", "x"))


@query("sta_06_calibration", f"{_SO}, p AS (SELECT LEAST(score / 6, 1.0) AS p, y FROM sh) SELECT CAST(LEAST(FLOOR(p * 10), 9) AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(p), 8) AS mean_p, ROUND(AVG(y::INT), 8) AS rate FROM p GROUP BY 1")
def calibration(spark, sf_dir):
    return rounded(inf.calibration(_so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").withColumn("p", F.least(F.col("score") / 6, F.lit(1.0))), "p", "y"))


_TESTS = "t AS (SELECT o_orderpriority AS family, o_orderkey AS test, ROUND((o_totalprice % 1000) / 1000, 6) AS p FROM orders)"


def _tests(spark, sf_dir):
    return panel.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("test"), F.round(F.col("o_totalprice") % 1000 / 1000, 6).alias("p"))


@query(
    "sta_10_false_discovery_rate",
    f"""WITH {_TESTS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY family ORDER BY p, test) AS r, COUNT(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, test, p, ROUND(LEAST(1.0, MIN(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM k""",
)
def false_discovery(spark, sf_dir):
    return rounded(inf.with_false_discovery_rate(_tests(spark, sf_dir), "p", "test", ["family"]))


@query(
    "sta_12_holm",
    f"""WITH {_TESTS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY family ORDER BY p, test) AS r, COUNT(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, test, p, ROUND(LEAST(1.0, MAX((m - r + 1) * p) OVER (PARTITION BY family ORDER BY r ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM k""",
)
def holm(spark, sf_dir):
    return rounded(inf.with_holm(_tests(spark, sf_dir), "p", "test", ["family"]))


def _draws(block: int, reps: int, circular: bool) -> str:
    room = "n" if circular else f"(n - {block} + 1)"
    return f"""{_SO}, se AS (SELECT ROW_NUMBER() OVER (ORDER BY idx) - 1 AS place, score, x FROM sh), nn AS (SELECT COUNT(*) AS n FROM se),
bl AS (SELECT n, replicate, b, ((replicate * 1103515245 + b * 12345 * (replicate % 97 + 1) + 7) % 2147483647) % {room} AS start FROM nn, (SELECT UNNEST(range({reps})) AS replicate) AS r, LATERAL (SELECT UNNEST(range(CAST(CEIL(n / {block}) AS BIGINT))) AS b) AS q),
dr AS (SELECT replicate, (start + k) % n AS place FROM bl, (SELECT UNNEST(range({block})) AS k) AS s WHERE b * {block} + k < n)"""


def _places(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL")
    return rows.select((F.row_number().over(Window.orderBy("idx")) - 1).cast("long").alias("place"), "score", "x")


@query("sta_25_block_bootstrap_mean", f"{_draws(20, 200, True)} SELECT replicate, ROUND(AVG(x), 8) AS value FROM dr JOIN se USING (place) GROUP BY replicate")
def bootstrap_mean(spark, sf_dir):
    return rounded(inf.block_bootstrap(_places(spark, sf_dir), F.avg("x")))


@query(
    "sta_25_bootstrap_interval",
    f"""{_draws(20, 200, True)}, bv AS (SELECT replicate, AVG(x) AS value FROM dr JOIN se USING (place) GROUP BY replicate)
SELECT ROUND(QUANTILE_CONT(value, 0.05), 7) AS lower, ROUND(QUANTILE_CONT(value, 0.95), 7) AS upper, ROUND(STDDEV_SAMP(value), 7) AS standard_error, ROUND((1 + SUM((value <= 0)::INT)) / (COUNT(*) + 1), 7) AS p_not_above_0 FROM bv""",
)
def bootstrap_interval(spark, sf_dir):
    return rounded(inf.interval(inf.block_bootstrap(_places(spark, sf_dir), F.avg("x"))), 7)


@query("sta_03_bootstrap_correlation", f"{_draws(10, 100, False)} SELECT replicate, ROUND(CORR(score, x), 7) AS value FROM dr JOIN se USING (place) GROUP BY replicate")
def bootstrap_correlation(spark, sf_dir):
    return rounded(inf.block_bootstrap(_places(spark, sf_dir), F.corr("score", "x"), 100, 10, 7, False), 7)


@query("sta_22_block_draws", f"{_draws(50, 5, True)} SELECT * FROM dr")
def block_draws(spark, sf_dir):
    return inf.block_draws(_places(spark, sf_dir).agg(F.count("*").alias("n")), 5, 50, 7)


@query(
    "sta_17_block_error",
    f"{_SO}, mb AS (SELECT x, CASE WHEN COUNT(x) OVER w = 20 THEN AVG(x) OVER w END AS bm FROM sh WINDOW w AS (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT COUNT(x) AS n, ROUND(AVG(x), 8) AS mean, ROUND(STDDEV_POP(bm) * SQRT(20.0 / COUNT(x)), 8) AS standard_error FROM mb",
)
def block_error(spark, sf_dir):
    return rounded(inf.overlapping_block_error(_so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL"), "x", 20))


@query(
    "sta_19_robust_slope",
    f"""{_SO}, c AS (SELECT idx, score AS x, x AS y, score - AVG(score) OVER () AS dx, x - AVG(x) OVER () AS dy FROM sh), b AS (SELECT *, SUM(dx * dy) OVER () / SUM(dx * dx) OVER () AS s FROM c), u AS (SELECT *, dx * (dy - s * dx) AS u FROM b),
l AS (SELECT *, {', '.join(f'LAG(u, {k}) OVER (ORDER BY idx) AS u{k}' for k in range(1, 6))} FROM u),
e AS (SELECT COUNT(*) AS n, MAX(s) AS slope, AVG(y) - MAX(s) * AVG(x) AS intercept, SQRT(SUM(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * COALESCE(SUM(u * u{k}), 0.0)' for k in range(1, 6))}) / SUM(dx * dx) AS standard_error FROM l)
SELECT n, ROUND(slope, 8) AS slope, ROUND(intercept, 8) AS intercept, ROUND(standard_error, 8) AS standard_error, ROUND(slope / standard_error, 6) AS t FROM e""",
)
def robust_slope(spark, sf_dir):
    out = inf.robust_slope(_so(spark, sf_dir), "x", "score", 5)
    return out.select("n", *(F.round(c, 8).alias(c) for c in ("slope", "intercept", "standard_error")), F.round("t", 6).alias("t"))


@query("sta_27_text_seed", "SELECT n_name, CAST('0x' || substr(sha256(n_name), 1, 8) AS BIGINT) AS seed FROM nation")
def text_seed(spark, sf_dir):
    return panel.table(spark, sf_dir, "nation").select("n_name", inf.text_seed(F.col("n_name")).alias("seed"))


# ---- models
_CUT = f"""{_SO}, tr AS (SELECT QUANTILE_CONT(score, 0.01) AS lo, QUANTILE_CONT(score, 0.5) AS mid, QUANTILE_CONT(score, 0.99) AS hi FROM so WHERE YEAR(date) < 2000), fl AS (SELECT date, GREATEST(LEAST(COALESCE(score, mid), hi), lo) AS z FROM so, tr), ms AS (SELECT AVG(z) AS mean, STDDEV_SAMP(z) AS dev FROM fl WHERE YEAR(date) < 2000)"""


@query("mod_02_standardized", f"{_CUT} SELECT date, ROUND((z - mean) / dev, 7) AS score FROM fl, ms")
def standardized(spark, sf_dir):
    rows = _so(spark, sf_dir).select("date", "score", (F.year("date") < 2000).alias("is_train"))
    return rounded(mo.standardized(rows, ["score"], mo.train_limits(rows, ["score"])).drop("is_train"), 7)


@query(
    "mod_14_ridge",
    f"""{_SO}, e AS (SELECT YEAR(date) AS year, COUNT(*) AS n, SUM(score) AS sx, SUM(x) AS sy, SUM(score * score) - SUM(score) * SUM(score) / COUNT(*) AS sxx, SUM(score * x) - SUM(score) * SUM(x) / COUNT(*) AS sxy FROM sh GROUP BY 1)
SELECT year, n, ROUND((sy - sxy / (sxx + 1.0) * sx) / n, 7) AS intercept, ROUND(sxy / (sxx + 1.0), 7) AS slope FROM e""",
)
def ridge(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").withColumn("year", F.year("date"))
    return rounded(mo.ridge_one(rows, "score", "x", 1.0, ["year"]), 7)


@query(
    "mod_15_walk_forward_ridge",
    f"""{_SO}, lb AS (SELECT score, x, LEAD(date) OVER (ORDER BY idx) AS le FROM so), rf AS (SELECT date AS refit FROM v WHERE month_last), e AS (SELECT refit, COUNT(*) AS n, SUM(score) AS sx, SUM(x) AS sy, SUM(score * score) AS sxx, SUM(score * x) AS sxy FROM lb JOIN rf ON le <= refit WHERE score IS NOT NULL AND x IS NOT NULL GROUP BY refit)
SELECT refit, n, ROUND((sy - (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0) * sx) / n, 7) AS intercept, ROUND((sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0), 7) AS slope FROM e""",
)
def walk_forward(spark, sf_dir):
    rows = _so(spark, sf_dir).withColumn("label_end", F.lead("date").over(Window.orderBy("idx")))
    refits = panel.market(spark, sf_dir).where("month_last").select(F.col("date").alias("refit"))
    return rounded(mo.walk_forward_ridge(rows, refits, "score", "x", 1.0), 7)


@query(
    "mod_19_equal_mean_rank",
    f"""{_LONG}, k AS (SELECT date, sid, CASE WHEN COUNT(score) OVER (PARTITION BY date, factor_id) >= 2 THEN 2.0 * ({R.avg_rank('score', 'date, factor_id')} - 1) / (COUNT(score) OVER (PARTITION BY date, factor_id) - 1) - 1 END AS r FROM long)
SELECT date, sid, ROUND(AVG(r), 7) AS prediction, COUNT(*) AS n FROM k WHERE r IS NOT NULL GROUP BY date, sid HAVING COUNT(*) >= 2""",
)
def mean_rank(spark, sf_dir):
    return rounded(mo.equal_mean_rank(_long(spark, sf_dir)), 7)


@query("mod_21_mature_dates", f"{_SO}, lb AS (SELECT date, x, LEAD(date, 5) OVER (ORDER BY idx) AS le FROM so), d AS (SELECT date FROM lb WHERE le <= DATE '1999-06-30' ORDER BY date DESC LIMIT 100) SELECT date, x, le AS label_end FROM lb JOIN d USING (date)")
def mature(spark, sf_dir):
    rows = _so(spark, sf_dir).select("date", "x", F.lead("date", 5).over(Window.orderBy("idx")).alias("label_end"))
    return mo.mature_dates(rows, F.to_date(F.lit("1999-06-30")), 100)


@query("mod_05_logistic")
def logistic(spark, sf_dir):
    return mo.logistic(_so(spark, sf_dir), "score", "y")


@query("mod_23_effective_sizes", f"{_SO} SELECT CAST(YEAR(date) AS INT) AS year, COUNT(*) AS n, COUNT(DISTINCT date) AS n_dates, ROUND(SUM(score) ** 2 / SUM(score * score), 6) AS n_effective FROM sh GROUP BY 1")
def effective(spark, sf_dir):
    rows = _so(spark, sf_dir).where("score IS NOT NULL AND x IS NOT NULL").withColumn("year", F.year("date"))
    return rounded(mo.effective_sizes(rows, "score", ["year"]), 6)


# ---- fundamentals: orders of a customer and year as tagged facts of a filing
_TAGS = "VALUES ('1-URGENT', 'revenue', 1), ('2-HIGH', 'revenue', 2), ('3-MEDIUM', 'cost', 1), ('4-NOT SPECIFIED', 'assets', 1), ('5-LOW', 'cash_flow', 1)"
_FACTS = f"""tags AS (SELECT * FROM ({_TAGS}) AS t(tag, metric_id, rank)), fc AS (SELECT o_custkey AS entity, YEAR(o_orderdate)::INT AS fiscal_year, o_custkey * 10000 + YEAR(o_orderdate) AS accession, o_orderpriority AS tag, CASE WHEN o_orderkey % 50 = 0 THEN 'shares' ELSE ' usd' END AS unit, o_totalprice AS value, 300 + o_orderkey % 150 AS days FROM orders),
jn AS (SELECT fc.*, metric_id, rank FROM fc JOIN tags USING (tag) WHERE UPPER(TRIM(unit)) = 'USD' AND days BETWEEN 300 AND 430),
bs AS (SELECT entity, accession, fiscal_year, metric_id, rank, tag, COUNT(DISTINCT value) AS n, MAX(value) AS value FROM jn GROUP BY ALL),
cf AS (SELECT entity, accession, fiscal_year, metric_id, value, tag, rank FROM (SELECT *, MIN(rank) OVER (PARTITION BY entity, accession, fiscal_year, metric_id) AS least FROM bs) AS q WHERE rank = least AND n = 1),
wd AS (SELECT entity, accession, fiscal_year, {', '.join(f"MAX(value) FILTER (WHERE metric_id = '{m}') AS {m}" for m in ('revenue', 'cost', 'assets', 'cash_flow'))} FROM cf GROUP BY 1, 2, 3),
bt AS (SELECT a.*, b.assets AS prior_assets FROM wd a LEFT JOIN wd b ON b.entity = a.entity AND b.fiscal_year = a.fiscal_year - 1)"""
_METRICS = ["revenue", "cost", "assets", "cash_flow"]


def _canonical(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    start = F.to_date(F.lit("2000-01-01"))
    facts = o.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fiscal_year"), (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("accession"), F.col("o_orderpriority").alias("tag"), F.when(F.col("o_orderkey") % 50 == 0, "shares").otherwise(" usd").alias("unit"), F.col("o_totalprice").alias("value"), start.alias("period_start"), F.date_add(start, (300 + F.col("o_orderkey") % 150).cast("int")).alias("period_end"))
    registry = spark.sql(f"SELECT *, 'USD' AS unit_family, 'duration' AS period_type FROM {_TAGS} AS t(tag, metric_id, rank)")
    return fu.canonical_facts(facts, registry)


def _wide(spark, sf_dir):
    return fu.wide_metrics(_canonical(spark, sf_dir), _METRICS)


@query("fun_01_canonical_facts", f"WITH {_FACTS} SELECT * FROM cf")
def canonical(spark, sf_dir):
    return _canonical(spark, sf_dir)


def _missing(*names: str) -> str:
    return "NULLIF(CONCAT_WS(';', " + ", ".join(f"CASE WHEN {n} IS NULL THEN 'missing_metric:{n}' END" for n in names) + "), '')"


@query("fun_08_gross_profitability", f"WITH {_FACTS}, r AS (SELECT *, COALESCE({_missing('revenue', 'cost', 'assets')}, CASE WHEN assets <= 0 THEN 'nonpositive_assets' WHEN revenue < 0 OR cost < 0 THEN 'negative_flow' END) AS reason FROM wd) SELECT entity, accession, fiscal_year, CASE WHEN reason IS NULL THEN ROUND((revenue - cost) / assets, 8) END AS value, reason FROM r")
def gross(spark, sf_dir):
    return rounded(fu.gross_profitability(_wide(spark, sf_dir)))


@query("fun_09_asset_growth", f"WITH {_FACTS}, r AS (SELECT *, {_missing('assets', 'prior_assets')} AS reason FROM bt) SELECT entity, fiscal_year, ROUND(assets / prior_assets - 1, 8) AS value, ROUND(-(assets / prior_assets - 1), 8) AS score, reason FROM r")
def growth(spark, sf_dir):
    return rounded(fu.asset_growth(fu.with_prior_year(_wide(spark, sf_dir), ["assets"])))


@query("fun_11_accruals", f"WITH {_FACTS}, r AS (SELECT *, {_missing('revenue', 'cost', 'cash_flow', 'assets', 'prior_assets')} AS reason, (revenue - cost - cash_flow) / ((assets + prior_assets) / 2) AS v FROM bt) SELECT entity, fiscal_year, ROUND(v, 8) AS value, ROUND(-v, 8) AS score, reason FROM r")
def accruals(spark, sf_dir):
    return rounded(fu.accruals(fu.with_prior_year(_wide(spark, sf_dir), ["assets"])))


@query("fun_16_identity_audit", f"WITH {_FACTS}, r AS (SELECT *, revenue - cost - assets AS residual FROM wd), e AS (SELECT *, ABS(residual) / GREATEST(ABS(revenue), ABS(cost), ABS(assets), 1.0) AS err FROM r) SELECT entity, accession, fiscal_year, ROUND(residual, 4) AS residual, CASE WHEN residual IS NOT NULL THEN ROUND(err, 8) END AS relative_error, CASE WHEN residual IS NULL THEN 'incomplete' WHEN err <= 0.3 THEN 'holds' ELSE 'violated' END AS status FROM e")
def identity(spark, sf_dir):
    out = fu.identity_audit(_wide(spark, sf_dir).withColumn("gross_profit", F.col("assets")), 0.3)
    return out.select("entity", "accession", "fiscal_year", F.round("residual", 4).alias("residual"), F.when(F.col("residual").isNotNull(), F.round("relative_error", 8)).alias("relative_error"), "status")


_DB = f"{_LONG}, fd AS (SELECT date AS signal_date, factor_id, score IS NOT NULL AS eligible, CASE WHEN score IS NULL THEN 'insufficient_history' END AS missing_reason FROM long)"


def _database(spark, sf_dir):
    long = _long(spark, sf_dir).withColumnRenamed("date", "signal_date")
    return long.withColumn("eligible", F.col("score").isNotNull()).withColumn("missing_reason", F.when(F.col("score").isNull(), "insufficient_history"))


@query("fun_20_coverage", f"{_DB}, y AS (SELECT *, CAST(YEAR(signal_date) AS INT) AS year FROM fd) SELECT factor_id, year, COUNT(*) AS total, SUM(eligible::INT)::BIGINT AS eligible, SUM((NOT eligible)::INT)::BIGINT AS missing, ROUND(AVG(eligible::INT), 8) AS rate FROM y GROUP BY GROUPING SETS ((factor_id), (year), (factor_id, year))")
def coverage(spark, sf_dir):
    return rounded(db.coverage_summary(_database(spark, sf_dir).withColumn("year", F.year("signal_date")), [["factor_id"], ["year"], ["factor_id", "year"]]))


@query("fun_19_missing_reasons", f"{_DB}, g AS (SELECT factor_id, missing_reason, COUNT(*) AS n FROM fd GROUP BY ALL) SELECT factor_id, missing_reason, n, ROUND(n / SUM(n) OVER (PARTITION BY factor_id), 8) AS share_of_rows, 1.0::DOUBLE AS share_of_missing FROM g QUALIFY missing_reason IS NOT NULL")
def reasons(spark, sf_dir):
    return rounded(db.missing_reason_summary(_database(spark, sf_dir)))


#: Faults by name and month: scores taken away from eligible rows, reasons from missing ones, ranks that are one too high, rows that stand twice.
_FAULTY = f"""{_LONG}, nm AS (SELECT date AS signal_date, factor_id, sid, score, CAST(regexp_replace(sid, '[^0-9]', '', 'g') AS INT) AS k, CAST(MONTH(date) AS INT) AS m FROM long), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY signal_date, factor_id ORDER BY score DESC NULLS LAST, sid) AS rank FROM nm),
ft AS (SELECT signal_date, factor_id, sid, CASE WHEN (k + m) % 11 = 0 THEN NULL ELSE score END AS score, score IS NOT NULL AS eligible, CASE WHEN score IS NULL AND (k + m) % 7 <> 0 THEN 'insufficient_history' END AS missing_reason, CASE WHEN score IS NOT NULL THEN rank + (k % 12 = 3)::INT END AS rank, k, m FROM rk),
tw AS (SELECT * FROM ft UNION ALL SELECT * FROM ft WHERE k = 11 AND m = 5), ex AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY signal_date, factor_id ORDER BY score DESC NULLS LAST, sid) AS expected, COUNT(*) OVER (PARTITION BY signal_date, sid, factor_id) AS again FROM tw)"""


def _faulty(spark, sf_dir):
    rows = _database(spark, sf_dir).withColumns({"k": F.regexp_replace("sid", "[^0-9]", "").cast("int"), "m": F.month("signal_date")})
    part = Window.partitionBy("signal_date", "factor_id").orderBy(F.col("score").desc_nulls_last(), "sid")
    rows = rows.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(part) + (F.col("k") % 12 == 3).cast("int")))
    rows = rows.withColumn("missing_reason", F.when((F.col("k") + F.col("m")) % 7 != 0, F.col("missing_reason"))).withColumn("score", F.when((F.col("k") + F.col("m")) % 11 != 0, F.col("score")))
    return rows.unionByName(rows.where("k = 11 AND m = 5"))


@query("val_09_database_faults", f"{_FAULTY} SELECT 'repeated_key' AS fault, SUM((again > 1)::INT)::BIGINT AS n FROM ex UNION ALL SELECT 'eligible_without_score', SUM((eligible AND score IS NULL)::INT)::BIGINT FROM ex UNION ALL SELECT 'missing_without_reason', SUM((NOT eligible AND missing_reason IS NULL)::INT)::BIGINT FROM ex UNION ALL SELECT 'wrong_rank', SUM((eligible AND rank <> expected)::INT)::BIGINT FROM ex")
def database_faults(spark, sf_dir):
    return db.faults(_faulty(spark, sf_dir))


@query("val_10_same_past", f"{_LONG}, a AS (SELECT date, sid, factor_id, score FROM long WHERE date <= DATE '1998-06-30'), b AS (SELECT date, sid, factor_id, CASE WHEN date >= DATE '1998-06-01' AND sid < 'Brand#3' THEN score * 2 ELSE score END AS score FROM a WHERE NOT (MONTH(date) = 2 AND sid > 'Brand#5')) SELECT COUNT(a.date) AS n_a, COUNT(b.date) AS n_b, SUM((b.date IS NULL OR a.score IS DISTINCT FROM b.score)::INT)::BIGINT AS n_different FROM a LEFT JOIN b USING (date, sid, factor_id)")
def same_past(spark, sf_dir):
    """The database against one in which the last month before the cutoff, and all after it, is doubled for some names, and some names' Februaries are lost."""
    a = _database(spark, sf_dir)
    changed = a.withColumn("score", F.when((F.col("signal_date") >= "1998-06-01") & (F.col("sid") < "Brand#3"), F.col("score") * 2).otherwise(F.col("score")))
    b = changed.where(~((F.month("signal_date") == 2) & (F.col("sid") > "Brand#5")))
    return db.same_past(a, b, "1998-06-30", ["signal_date", "sid", "factor_id"], ["score", "eligible"])


# ---- names
@query("str_01_provider_symbol", r"SELECT s_suppkey, regexp_replace(replace(UPPER(regexp_replace('p::' || replace(s_name, '#', ' /'), '^[^:]+::', '')), '/', '-'), '\s+', '', 'g') AS symbol FROM supplier")
def provider_symbol(spark, sf_dir):
    return panel.table(spark, sf_dir, "supplier").select("s_suppkey", tx.provider_symbol(F.concat(F.lit("p::"), F.regexp_replace("s_name", "#", " /"))).alias("symbol"))


@query("str_02_symbol_variants", "SELECT n_nationkey, array_to_string(list_sort(list_distinct([regexp_replace(n_name, '[._-]', '.', 'g'), regexp_replace(n_name, '[._-]', '-', 'g'), regexp_replace(n_name, '[._-]', '_', 'g')])), '|') AS variants FROM nation")
def variants(spark, sf_dir):
    return panel.table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(tx.symbol_variants(F.col("n_name")), "|").alias("variants"))


_LEGAL = "[" + ", ".join(f"'{w}'" for w in tx.LEGAL_WORDS) + "]"


@query("str_03_normalized_name", rf"""SELECT s_suppkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace(replace(lower(regexp_replace(s_name || ' & Co. /DE/', '\s*/[A-Za-z]{{2,}}/?\s*$', '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda w: NOT list_contains({_LEGAL}, w) AND w <> ''), ' ') AS name FROM supplier""")
def normalized(spark, sf_dir):
    return panel.table(spark, sf_dir, "supplier").select("s_suppkey", tx.normalized_name(F.concat("s_name", F.lit(" & Co. /DE/"))).alias("name"))


@query("str_04_token_jaccard", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(LAG(p_name) OVER (ORDER BY p_partkey), ' ') AS b FROM part) SELECT p_partkey, ROUND(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) AS jaccard FROM p WHERE b IS NOT NULL")
def jaccard(spark, sf_dir):
    p = pit.with_previous(panel.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", F.col("p_name"), F.floor(F.col("p_partkey") / 10_000), "b").where("b IS NOT NULL")
    return p.select("p_partkey", F.round(tx.token_jaccard(F.col("p_name"), F.col("b")), 8).alias("jaccard"))


@query("str_05_padded_code", "SELECT c_custkey, LPAD(CAST(c_custkey AS VARCHAR), 10, '0') AS code FROM customer")
def padded(spark, sf_dir):
    return panel.table(spark, sf_dir, "customer").select("c_custkey", tx.padded_code(F.col("c_custkey")).alias("code"))


@query("str_11_pipe_list", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE replace(p_name, ' ', '+') END AS items FROM part")
def pipes(spark, sf_dir):
    said = F.when(F.col("p_size") % 5 == 0, "None").otherwise(F.regexp_replace("p_name", " ", " | "))
    return panel.table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.pipe_list(said), "+").alias("items"))


@query("str_12_strict_boolean", "SELECT o_orderkey, o_orderkey % 2 = 0 AS flag FROM orders")
def booleans(spark, sf_dir):
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", tx.strict_boolean(F.when(F.col("o_orderkey") % 2 == 0, " Yes").otherwise("0")).alias("flag"))
