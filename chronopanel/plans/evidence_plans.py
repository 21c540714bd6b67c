"""Signed-rank tails (STA), positive ridge (MOD), panels by change dates (PIT), evidence of skips (VAL), conversion chains (REP), bundles (SRC) and name scores (STR)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronopanel.functions import text as tx
from chronopanel.operators import actions as ac
from chronopanel.operators import entities as en
from chronopanel.operators import fundamentals as fu
from chronopanel.operators import positive_ridge as pr
from chronopanel.operators import repair as rp
from chronopanel.operators import signed_ranks as sr
from chronopanel.plans import registry as R
from chronopanel.plans.model_plans import _RANKED, _YEARLY, _ranked, _yearly
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.registry import query
from chronopanel.sources import panel, store


@query(
    "sta_13_exact_tails",
    f"""{_YEARLY}, mm AS (SELECT fold, MONTH(date) AS k, ROUND(AVG(x), 9) AS d FROM sc GROUP BY ALL), rk AS (SELECT fold, d, (2 * ({R.avg_rank('ABS(d)', 'fold')}))::BIGINT AS r FROM mm WHERE d <> 0),
ls AS (SELECT fold, COUNT(*) AS n, list(r) AS rs, COALESCE(SUM(r) FILTER (WHERE d > 0), 0) AS w FROM rk GROUP BY fold),
sg AS (SELECT fold, n, w, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (m >> (i - 1)::INT) & 1 = 1 THEN rs[i] ELSE 0 END)) AS s FROM (SELECT *, UNNEST(range(0, 1 << n::INT)) AS m FROM ls))
SELECT fold, n, w / 2 AS w_plus, ROUND(AVG((s >= w)::INT), 9) AS p_greater FROM sg GROUP BY fold, n, w""",
)
def exact_tails(spark, sf_dir):
    """Monthly means of each year, with the tail over all signs of their ranks."""
    means = _yearly(spark, sf_dir).groupBy("fold", F.month("date").alias("k")).agg(F.round(F.avg("x"), 9).alias("d"))
    return sr.signed_rank_test(means, "d", ["fold"]).select("fold", "n", "w_plus", F.round("p_greater", 9).alias("p_greater"))


@query(
    "mod_10_positive_ridge",
    f"""WITH {_RANKED}, kr AS (SELECT YEAR(date)::INT AS year, a, b, y FROM rk WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL), ks AS (SELECT year, COUNT(*) AS n, SUM(a) AS sa, SUM(b) AS sb, SUM(y) AS sy, SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb, SUM(a * y) AS ay, SUM(b * y) AS yb FROM kr GROUP BY year),
kc AS (SELECT *, aa - sa * sa / n + 2.0 AS caa, bb - sb * sb / n + 2.0 AS cbb, ab - sa * sb / n AS cab, ay - sa * sy / n AS cay, yb - sb * sy / n AS cby FROM ks),
kb AS (SELECT *, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) AS p0, (caa * cby - cab * cay) / (caa * cbb - cab * cab) AS q0, CASE WHEN cay > 0 THEN cay * cay / caa ELSE 0 END AS ga, CASE WHEN cby > 0 THEN cby * cby / cbb ELSE 0 END AS gb FROM kc),
kp AS (SELECT year, n, sa, sb, sy, CASE WHEN p0 > 0 AND q0 > 0 THEN p0 WHEN ga >= gb AND ga > 0 THEN cay / caa ELSE 0 END AS p, CASE WHEN p0 > 0 AND q0 > 0 THEN q0 WHEN gb > ga THEN cby / cbb ELSE 0 END AS q FROM kb)
SELECT year, n, ROUND(sy / n - p * sa / n - q * sb / n, 7) AS intercept, ROUND(p, 7) AS a, ROUND(q, 7) AS b FROM kp""",
)
def positive_ridge(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("year", F.year("date"))
    out = pr.positive_ridge(pr.keyed_moments(rows, ["year"], ["a", "b"], "y"), ["year"], ["a", "b"], 2.0)
    return out.select("year", "n", *(F.round(F.col("beta")[i], 7).alias(c) for i, c in enumerate(("intercept", "a", "b"))))


_FACTS = "fx AS (SELECT o_custkey % 150 AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'assets' ELSE 'revenue' END AS metric_id, o_totalprice AS value, CAST(CAST(o_orderdate AS DATE) + (o_orderkey % 40)::INT - 60 AS DATE) AS period_end, CAST(o_orderdate AS DATE) AS available, o_orderkey AS k FROM orders), mp AS (SELECT 'S' || c_custkey AS sid, c_custkey % 150 AS entity, CAST(DATE '1993-01-01' + (c_custkey % 900)::INT AS DATE) AS a, CASE WHEN c_custkey % 3 = 0 THEN DATE '1997-06-30' END AS z FROM customer)"


def _facts(spark, sf_dir):
    k, filed = F.col("o_orderkey"), F.to_date("o_orderdate")
    facts = panel.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("entity"), F.when(k % 3 == 0, "assets").otherwise("revenue").alias("metric_id"), F.col("o_totalprice").alias("value"), F.date_add(filed, (k % 40 - 60).cast("int")).alias("period_end"), filed.alias("available"))
    c = F.col("c_custkey")
    mapping = panel.table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), c.cast("string")).alias("sid"), (c % 150).alias("entity"), F.date_add(F.lit("1993-01-01").cast("date"), (c % 900).cast("int")).alias("effective_from"), F.when(c % 3 == 0, F.lit("1997-06-30").cast("date")).alias("effective_to"))
    return facts, mapping


@query(
    "pit_18_change_date_panel",
    f"""WITH {_FACTS}, sg AS (SELECT UNNEST([DATE '1994-06-30', DATE '1996-03-29', DATE '1997-12-31']) AS signal_date), st AS (SELECT signal_date, entity, metric_id, MAX_BY(value, {{'p': period_end, 'a': available, 'v': value}}) AS v FROM fx JOIN sg ON GREATEST(available, period_end) <= signal_date GROUP BY ALL),
w AS (SELECT sid, mp.entity, sg.signal_date, MAX(CASE WHEN metric_id = 'assets' THEN v END) AS assets, MAX(CASE WHEN metric_id = 'revenue' THEN v END) AS revenue FROM mp JOIN sg ON mp.a <= sg.signal_date AND (z IS NULL OR sg.signal_date < z) LEFT JOIN st ON st.entity = mp.entity AND st.signal_date = sg.signal_date GROUP BY ALL),
f AS (SELECT *, UNNEST([{{'f': 'turnover', 'v': revenue / NULLIF(assets, 0)}}, {{'f': 'size', 'v': LN(assets)}}]) AS x FROM w)
SELECT sid, entity, signal_date, x.f AS factor_id, ROUND(x.v, 8) AS value, CASE WHEN x.v IS NULL THEN concat_ws(';', CASE WHEN assets IS NULL THEN 'missing_metric:assets' END, CASE WHEN revenue IS NULL THEN 'missing_metric:revenue' END) END AS reason FROM f""",
)
def change_date_panel(spark, sf_dir):
    facts, mapping = _facts(spark, sf_dir)
    signals = spark.sql("SELECT explode(array(DATE '1994-06-30', DATE '1996-03-29', DATE '1997-12-31')) AS signal_date")
    ratios = {"turnover": F.try_divide(F.col("revenue"), F.col("assets")), "size": F.log("assets")}
    return rounded(fu.at_signals(fu.change_date_panel(facts, mapping, ["assets", "revenue"], ratios), signals))


@query("pit_18_computed_states", f"WITH {_FACTS}, e AS (SELECT DISTINCT entity, GREATEST(available, period_end) AS d FROM fx), s AS (SELECT e.entity, d, MAX_BY(value, {{'p': period_end, 'a': available, 'v': value}}) FILTER (WHERE metric_id = 'assets') AS assets, MAX_BY(value, {{'p': period_end, 'a': available, 'v': value}}) FILTER (WHERE metric_id = 'revenue') AS revenue FROM e JOIN fx ON fx.entity = e.entity AND GREATEST(available, period_end) <= d GROUP BY ALL) SELECT entity, d AS known_from, LEAD(d) OVER (PARTITION BY entity ORDER BY d) AS known_until, assets, revenue FROM s")
def computed_states(spark, sf_dir):
    return fu.change_date_states(_facts(spark, sf_dir)[0], ["assets", "revenue"])


_GAPS = f"WITH {R.spine()}, op AS (SELECT sid, idx, month_last, CASE WHEN (idx * 7 + CAST(regexp_replace(sid, '[^0-9]', '', 'g') AS INT)) % 11 NOT IN (0, 1) THEN open END AS open FROM spine), gp AS (SELECT sid, idx FROM op WHERE month_last AND open IS NULL), av AS (SELECT DISTINCT 'Brand#' || (1 + o_orderkey % 25) AS sid, cal.idx FROM orders JOIN cal ON cal.date = CAST(o_orderdate AS DATE) WHERE o_orderpriority = '1-URGENT')"


@query(
    "val_26_skip_evidence",
    f"""{_GAPS}, nx AS (SELECT sid, gp.idx, MIN(av.idx) AS action_idx FROM gp LEFT JOIN av USING (sid) WHERE av.idx IS NULL OR av.idx BETWEEN gp.idx AND gp.idx + 3 GROUP BY ALL), af AS (SELECT gp.sid, gp.idx, nx.action_idx FROM gp LEFT JOIN nx ON nx.sid = gp.sid AND nx.idx = gp.idx),
ro AS (SELECT gp.sid, gp.idx, MIN(op.idx) FILTER (WHERE op.idx > gp.idx) AS resumed_idx, MAX(op.idx) FILTER (WHERE op.idx < gp.idx) AS last_open_idx FROM gp JOIN op ON op.sid = gp.sid AND open > 0 GROUP BY ALL)
SELECT af.sid, af.idx, action_idx, CASE WHEN action_idx = af.idx THEN 'same_open' WHEN action_idx IS NOT NULL THEN 'pending_action' ELSE 'none' END AS evidence, last_open_idx, resumed_idx, action_idx IS NOT NULL AND resumed_idx IS NOT NULL AS is_explained FROM af LEFT JOIN ro ON ro.sid = af.sid AND ro.idx = af.idx""",
)
def skip_evidence(spark, sf_dir):
    """Opens taken away by number, actions from urgent orders, evidence within three sessions."""
    spine = panel.spine(panel.prices(spark, sf_dir))
    lost = ((F.col("idx") * 7 + F.regexp_replace("sid", "[^0-9]", "").cast("int")) % 11).isin(0, 1)
    spine = store.materialized(spine.select("sid", "idx", "date", "month_last", F.when(~lost, F.col("open")).alias("open")))
    days = spine.select("date", "idx").distinct()
    sid = F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 25).cast("string"))
    orders = panel.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(sid.alias("source_sid"), F.to_date("o_orderdate").alias("date"))
    acts = orders.join(F.broadcast(days), "date").select("source_sid", F.col("idx").alias("apply_idx")).distinct()
    return ac.skip_evidence(spine.where("month_last AND open IS NULL").select("sid", "idx"), acts, spine, 3)


_EDGES = "ed AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 97 = 0 THEN c_custkey - 96 ELSE c_custkey + 1 END AS target, 1 + (c_custkey % 3) * 0.5::DOUBLE AS ratio FROM customer WHERE c_custkey % 97 = 0 AND c_custkey % 2 = 0 OR c_custkey % 97 <> 0 AND c_custkey % 41 <> 0), am AS (SELECT source, target, ratio FROM ed UNION ALL SELECT source, target + 5, 1.0 FROM ed WHERE source % 389 = 0)"


@query(
    "rep_08_chained_conversions",
    f"""WITH RECURSIVE {_EDGES}, cn AS (SELECT source, COUNT(*) AS n FROM am GROUP BY 1), sg AS (SELECT am.* FROM am JOIN cn USING (source) WHERE n = 1), wy(source, reached, ratio, steps, back) AS (SELECT source, target, ratio, 1, source = target FROM sg UNION ALL SELECT wy.source, sg.target, wy.ratio * sg.ratio, steps + 1, sg.target = wy.source FROM wy JOIN sg ON sg.source = wy.reached WHERE NOT back AND steps < 400),
en AS (SELECT source, MAX_BY(reached, steps) AS reached, MAX_BY(ratio, steps) AS ratio, MAX(steps) AS steps, BOOL_OR(back) AS back FROM wy GROUP BY source), fl AS (SELECT en.*, sg.source IS NOT NULL AS goes FROM en LEFT JOIN sg ON sg.source = en.reached)
SELECT source, CASE WHEN NOT goes THEN reached END AS final, CASE WHEN NOT goes THEN ROUND(LN(ratio), 7) END AS log_ratio, CASE WHEN NOT goes THEN steps END AS steps, CASE WHEN NOT goes THEN 'chain' WHEN back THEN 'cycle' ELSE 'into_cycle' END AS status FROM fl UNION ALL SELECT source, NULL, NULL, NULL, 'ambiguous' FROM cn WHERE n > 1""",
)
def chained_conversions(spark, sf_dir):
    """Customers that are converted into the next one, with ends, closed circles and sources of two edges."""
    c = F.col("c_custkey")
    edges = panel.table(spark, sf_dir, "customer").where("c_custkey % 97 = 0 AND c_custkey % 2 = 0 OR c_custkey % 97 <> 0 AND c_custkey % 41 <> 0").select(c.alias("source"), F.when(c % 97 == 0, c - 96).otherwise(c + 1).alias("target"), (1 + (c % 3) * 0.5).alias("ratio"))
    edges = edges.unionByName(edges.where("source % 389 = 0").select("source", (F.col("target") + 5).alias("target"), F.lit(1.0).alias("ratio")))
    return rp.chained_conversions(edges).select("source", "final", F.round(F.log("ratio"), 7).alias("log_ratio"), "steps", "status")


@query("src_36_published_bundle", "SELECT 'coverage' AS name, COUNT(*) AS n_rows, true AS is_intact FROM (SELECT DISTINCT YEAR(o_orderdate), o_orderpriority FROM orders) AS c UNION ALL SELECT 'orders', COUNT(*), true FROM orders")
def published_bundle(spark, sf_dir):
    """Orders and their coverage by year and priority, published as one bundle and audited as it is read."""
    orders = panel.table(spark, sf_dir, "orders")
    coverage = orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("n_priced"))
    path = f"{store.shared_folder(spark)}/bundles/{uuid.uuid4().hex}"
    store.publish_bundle({"orders": (orders, ["o_orderkey"]), "coverage": (coverage, ["year", "o_orderpriority"])}, path)
    return store.bundle_audit(spark, path)


def _part_names(spark, sf_dir):
    """Distinct names of the parts with even and odd keys: name, kind and the number of the brand."""
    said = F.concat_ws(" ", "p_name", F.lower("p_type"), F.regexp_replace("p_brand", "[^0-9]", ""))
    p = panel.table(spark, sf_dir, "part").select("p_partkey", said.alias("name"))
    of = lambda odd, key: p.where(F.col("p_partkey") % 2 == odd).groupBy("name").agg(F.min("p_partkey").alias(key))
    return of(0, "sid"), of(1, "cik")


@query("str_04_name_scores")
def name_scores(spark, sf_dir):
    """Scores of part names that share a block, by characters and words; the tests hold the ratio against a plain one."""
    names, lookup = _part_names(spark, sf_dir)
    return rounded(en.scored_candidates(names, lookup, 0.3))


@query("str_04_equal_and_empty_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 WHEN s_suppkey % 3 = 1 THEN 1.0 ELSE ROUND(0.6 * 2 * LENGTH(s_name) / (2 * LENGTH(s_name) + 2) + 0.4 / 2, 8) END AS score FROM supplier")
def equal_and_empty_names(spark, sf_dir):
    """A name against nothing, itself, and itself with a word more."""
    k = F.col("s_suppkey") % 3
    other = F.when(k == 0, "").when(k == 1, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" x")))
    return panel.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(tx.name_score(F.col("s_name"), other), 8).alias("score"))
