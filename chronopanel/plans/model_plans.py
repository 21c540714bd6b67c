"""Models over panels (MOD): complete universes, nested selection of recipes, refits and their predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.operators import isotonic as iso
from chronopanel.operators import newton as nt
from chronopanel.operators import selection as se
from chronopanel.plans import registry as R
from chronopanel.plans.portfolio_plans import rounded
from chronopanel.plans.regime_plans import VOL, volatility
from chronopanel.plans.registry import query
from chronopanel.sources import panel, store

_LEAST, _BLOCK, _BLOCKS, _ERROR, _MOST = 52, 13, 2, 4, 104
_RECIPES = [se.Recipe("R0", 0.1, 3), se.Recipe("R1", 5.0, 2), se.Recipe("R2", 100.0, 1)]


def _crank(x: str) -> str:
    return f"CASE WHEN COUNT({x}) OVER (PARTITION BY date) >= 2 THEN 2.0 * (({R.avg_rank(x, 'date')}) - 1) / (COUNT({x}) OVER (PARTITION BY date) - 1) - 1 END"


_WEEKLY = f"{R.spine()}, wf AS (SELECT date, sid, week_last, ROUND(-({R.ret('close', R.lag('close', 5))}), 9) AS a, ROUND({R.ret('close', R.lag('close', 20))}, 9) AS b, ROUND({R.ret('LEAD(close, 5) OVER (PARTITION BY sid ORDER BY idx)', 'close')}, 9) AS y, LEAD(date, 5) OVER (PARTITION BY sid ORDER BY idx) AS label_end FROM spine), wk AS (SELECT * FROM wf WHERE week_last)"


def _weekly(spark, sf_dir):
    close, over = F.col("close"), panel.by_name()
    rows = panel.spine(panel.prices(spark, sf_dir))
    made = {"a": -C.simple_return(close, F.lag(close, 5).over(over)), "b": C.simple_return(close, F.lag(close, 20).over(over)), "y": C.simple_return(F.lead(close, 5).over(over), close)}
    rows = rows.select("date", "sid", "week_last", *(F.round(e, 9).alias(c) for c, e in made.items()), F.lead("date", 5).over(over).alias("label_end"))
    return rows.where("week_last").drop("week_last")


@query("mod_25_coverage_gate", f"WITH {_WEEKLY}, d AS (SELECT date, AVG((a IS NOT NULL)::INT) AS a, AVG((b IS NOT NULL)::INT) AS b FROM wk GROUP BY date) SELECT 'a' AS factor_id, ROUND(MIN(a), 8) AS minimum_coverage, MIN(a) >= 0.5 AS passed FROM d UNION ALL SELECT 'b', ROUND(MIN(b), 8), MIN(b) >= 0.5 FROM d")
def coverage_gate(spark, sf_dir):
    return rounded(se.coverage_gate(_weekly(spark, sf_dir), ["a", "b"], 0.5))


@query("mod_25_complete_coverage", f"WITH {_WEEKLY} SELECT date, COUNT(*) AS base_names, SUM((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS complete_names, ROUND(AVG((a IS NOT NULL AND b IS NOT NULL)::INT), 8) AS coverage, SUM((a IS NOT NULL AND b IS NOT NULL)::INT) >= 20 AND AVG((a IS NOT NULL AND b IS NOT NULL)::INT) >= 0.9 AS passed FROM wk GROUP BY date")
def complete_coverage(spark, sf_dir):
    return rounded(se.complete_coverage(_weekly(spark, sf_dir), ["a", "b"], 20, 0.9))


_RANKED = f"{_WEEKLY}, cp AS (SELECT * FROM wk WHERE a IS NOT NULL AND b IS NOT NULL), rk AS (SELECT date, sid, label_end, {_crank('a')} AS a, {_crank('b')} AS b, {_crank('y')} AS y FROM cp)"


@query("mod_25_ranked_panel", f"WITH {_RANKED} SELECT date, sid, label_end, ROUND(a, 8) AS a, ROUND(b, 8) AS b, ROUND(y, 8) AS y FROM rk")
def ranked_panel(spark, sf_dir):
    return rounded(se.ranked_panel(_weekly(spark, sf_dir), ["a", "b"], "y"))


def _ranked(spark, sf_dir):
    return store.materialized(se.ranked_panel(_weekly(spark, sf_dir), ["a", "b"], "y"))


#: Running sums of a date's mean products, and from two of them the ridge of a span: intercept i, slopes p and q.
_SUMS = f"""{_RANKED}, rr AS (SELECT * FROM rk WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL AND label_end IS NOT NULL),
dm AS (SELECT date, MAX(label_end) AS known, AVG(a) AS sa, AVG(b) AS sb, AVG(y) AS sy, AVG(a * a) AS aa, AVG(a * b) AS ab, AVG(b * b) AS bb, AVG(a * y) AS ay, AVG(b * y) AS yb FROM rr GROUP BY date),
pl AS (SELECT *, ROW_NUMBER() OVER (ORDER BY known, date)::INT AS place FROM dm),
rc AS (SELECT * FROM (VALUES ('R0', 0.1::DOUBLE, 3), ('R1', 5.0::DOUBLE, 2), ('R2', 100.0::DOUBLE, 1)) AS t(recipe, penalty, capacity))"""


def _fits(spans: str, name: str) -> str:
    return f"""{name}s AS (SELECT fit, COUNT(*) AS w, SUM(sa) AS sa, SUM(sb) AS sb, SUM(sy) AS sy, SUM(aa) AS aa, SUM(ab) AS ab, SUM(bb) AS bb, SUM(ay) AS ay, SUM(yb) AS yb FROM {spans} AS sp JOIN pl ON place BETWEEN sp.first AND sp.last GROUP BY fit),
{name}c AS (SELECT fit, recipe, w, sa, sb, sy, aa - sa * sa / w + penalty AS caa, bb - sb * sb / w + penalty AS cbb, ab - sa * sb / w AS cab, ay - sa * sy / w AS cay, yb - sb * sy / w AS cby FROM {name}s CROSS JOIN rc),
{name}p AS (SELECT *, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) AS p, (caa * cby - cab * cay) / (caa * cbb - cab * cab) AS q FROM {name}c),
{name} AS (SELECT fit, recipe, w::INT AS n_dates, sy / w - p * sa / w - q * sb / w AS i, p, q FROM {name}p)"""


_SELECT = f"""{_SUMS}, fo AS (SELECT f AS fit, 1 AS first, {_LEAST} + f * {_BLOCK} AS last FROM (SELECT UNNEST(range(0, (SELECT (COUNT(*) - {_LEAST}) // {_BLOCK} FROM pl))) AS f)), {_fits('fo', 'ff')},
vp AS (SELECT recipe, fit AS fold, place, ROUND(i + p * a + q * b, 10) AS g, y FROM rr JOIN pl USING (date) JOIN ff ON fit = (place - 1 - {_LEAST}) // {_BLOCK} WHERE place > {_LEAST}),
vr AS (SELECT recipe, fold, place, {R.avg_rank('g', 'recipe, place')} AS g, {R.avg_rank('y', 'recipe, place')} AS y FROM vp),
ic AS (SELECT * FROM (SELECT recipe, fold, place, CASE WHEN STDDEV_POP(g) > 0 AND STDDEV_POP(y) > 0 THEN CORR(g, y) END AS ic FROM vr GROUP BY ALL) WHERE ic IS NOT NULL),
yc AS (SELECT YEAR(date)::INT AS year, MIN(date) AS cutoff FROM rk GROUP BY 1), yl AS (SELECT year, ((SELECT COUNT(*) FROM pl WHERE known <= cutoff) - {_LEAST}) // {_BLOCK} AS n_blocks FROM yc),
se AS (SELECT year, n_blocks::INT AS n_blocks, recipe, place, ic FROM ic JOIN yl ON fold < n_blocks WHERE n_blocks >= {_BLOCKS}), mn AS (SELECT year, n_blocks, recipe, AVG(ic) AS mean_ic, ANY_VALUE(capacity) AS capacity FROM se JOIN rc USING (recipe) GROUP BY year, n_blocks, recipe),
be AS (SELECT year, recipe AS best FROM mn QUALIFY ROW_NUMBER() OVER (PARTITION BY year ORDER BY ROUND(mean_ic, 12) DESC, capacity, recipe) = 1),
gp AS (SELECT s.year, s.recipe, s.place, t.ic - s.ic AS d FROM se s JOIN be USING (year) JOIN se t ON t.year = s.year AND t.place = s.place AND t.recipe = best),
bl AS (SELECT *, CASE WHEN COUNT(d) OVER w = {_ERROR} THEN AVG(d) OVER w END AS m FROM gp WINDOW w AS (PARTITION BY year, recipe ORDER BY place ROWS {_ERROR - 1} PRECEDING)),
cl AS (SELECT year, recipe, AVG(d) AS gap, COALESCE(STDDEV_POP(m) * SQRT({_ERROR}.0 / COUNT(d)), 0) AS se FROM bl GROUP BY 1, 2),
ch AS (SELECT mn.*, string_agg(recipe, '|') OVER (PARTITION BY year ORDER BY recipe ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS one_se_members FROM cl JOIN mn USING (year, recipe) WHERE gap <= se + 1e-12 QUALIFY ROW_NUMBER() OVER (PARTITION BY year ORDER BY capacity, recipe) = 1)"""


def _nested(spark, sf_dir):
    rows = _ranked(spark, sf_dir)
    years = rows.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("cutoff"))
    firsts = rows.groupBy(F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("refit"))
    refits = firsts.select("refit", F.date_add("refit", 1).alias("predict_from"))
    return se.nested_selection(rows, ["a", "b"], "y", _RECIPES, years, refits, _LEAST, _BLOCK, _BLOCKS, _ERROR, _MOST)


@query("mod_16_annual_selection", f"WITH {_SELECT} SELECT year, recipe, ROUND(mean_ic, 7) AS mean_ic, one_se_members, n_blocks FROM ch")
def annual_selection(spark, sf_dir):
    return rounded(_nested(spark, sf_dir)[0], 7)


@query(
    "mod_15_selected_predictions",
    f"""WITH {_SELECT}, mo AS (SELECT MIN(date) AS refit FROM rk GROUP BY date_trunc('month', date)), sp AS (SELECT refit, CAST(refit + 1 AS DATE) AS predict_from, LEAD(CAST(refit + 1 AS DATE)) OVER (ORDER BY refit) AS until, (SELECT COUNT(*) FROM pl WHERE known <= refit)::INT AS legal FROM mo),
rs AS (SELECT refit AS fit, GREATEST(1, legal - {_MOST} + 1) AS first, legal AS last FROM sp WHERE legal >= {_LEAST}), {_fits('rs', 'rf')}
SELECT date, sid, ROUND(i + p * a + q * b, 7) AS prediction, recipe, refit FROM rk JOIN sp ON date >= predict_from AND (until IS NULL OR date < until) JOIN ch ON year = YEAR(date) JOIN rf USING (recipe) WHERE fit = refit AND a IS NOT NULL AND b IS NOT NULL""",
)
def selected_predictions(spark, sf_dir):
    out = _nested(spark, sf_dir)[1]
    return out.select("date", "sid", F.round("prediction", 7).alias("prediction"), "recipe", "refit")


# ---- fits of many keys in the same jobs: a weekly market series by years
_YEARLY = f"{VOL}, so AS (SELECT date, idx, week_last, ROUND(rv, 9) AS score, ROUND(LEAD(r) OVER (ORDER BY idx), 9) AS x FROM v), sc AS (SELECT YEAR(date)::INT AS fold, date, idx, ROUND(score * 100, 7) AS s, x, (x < -0.1)::INT AS y FROM so WHERE score IS NOT NULL AND x IS NOT NULL)"


def _yearly(spark, sf_dir):
    rows = volatility(spark, sf_dir).select("date", "idx", F.round("rv", 9).alias("score"), F.round(F.lead("r").over(Window.orderBy("idx")), 9).alias("x")).where("score IS NOT NULL AND x IS NOT NULL")
    return store.materialized(rows.select(F.year("date").alias("fold"), "date", "idx", F.round(F.col("score") * 100, 7).alias("s"), "x", (F.col("x") < -0.1).cast("int").alias("y")))


def _newton(rows: str, score: str, penalty: float = 0.0) -> str:
    """Newton steps for each key k of rows (k, score, y): nw has intercept a and slope b at each step, nt those of the last."""
    return f"""nw(k, step, a, b) AS (SELECT DISTINCT k, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM {rows} UNION ALL SELECT k, step + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
SELECT k, step, a, b, SUM(y - p) AS g1, SUM((y - p) * z) - {penalty} * b AS g2, SUM(p * (1 - p)) AS h11, SUM(p * (1 - p) * z) AS h12, SUM(p * (1 - p) * z * z) + {penalty} AS h22 FROM (SELECT nw.*, {score} AS z, y, 1 / (1 + EXP(-(a + b * {score}))) AS p FROM nw JOIN {rows} AS rw USING (k) WHERE step < 12) AS e GROUP BY k, step, a, b) AS g),
nt AS (SELECT k, a, b FROM nw WHERE step = 12)"""


_HALF_YEARS = "hr AS (SELECT fold * 10 + (MONTH(date) > 6)::INT AS k, s, y FROM sc), hk AS (SELECT k FROM hr GROUP BY k HAVING SUM(y) > 0 AND SUM(y) < COUNT(*)), hy AS (SELECT * FROM hr SEMI JOIN hk USING (k))"


@query("mod_05_keyed_logistic", f"{_YEARLY.replace('WITH', 'WITH RECURSIVE', 1)}, {_HALF_YEARS}, {_newton('hy', 's', 1.0)} SELECT k AS half, n, n_positive, CASE WHEN a IS NULL THEN 'one_class' ELSE 'converged' END AS status, ROUND(a, 6) AS intercept, ROUND(b, 6) AS slope FROM (SELECT k, COUNT(*) AS n, SUM(y)::BIGINT AS n_positive FROM hr GROUP BY k) AS c LEFT JOIN nt USING (k)")
def keyed_logistic(spark, sf_dir):
    """A penalised fit for each half year, all in the same jobs."""
    rows = _yearly(spark, sf_dir).withColumn("half", F.col("fold") * 10 + (F.month("date") > 6).cast("int"))
    fits = nt.logistic_fits(rows, ["half"], ["s"], "y", 1.0)
    return fits.select("half", "n", "n_positive", "status", F.round(F.col("beta")[0], 6).alias("intercept"), F.round(F.col("beta")[1], 6).alias("slope"))


@query(
    "mod_04_prequential_calibration",
    f"""{_YEARLY.replace('WITH', 'WITH RECURSIVE', 1)}, fd AS (SELECT DISTINCT fold FROM sc), pr AS (SELECT fd.fold AS k, s, y FROM fd JOIN sc ON sc.fold < fd.fold), pk AS (SELECT k FROM pr GROUP BY k HAVING SUM(y) > 0 AND SUM(y) < COUNT(*)), pa AS (SELECT * FROM pr SEMI JOIN pk USING (k)), {_newton('pa', 's')}
SELECT fold, date, CASE WHEN b > 0 THEN ROUND(1 / (1 + EXP(-(a + b * s))), 6) END AS p FROM sc LEFT JOIN nt ON k = fold""",
)
def prequential_calibration(spark, sf_dir):
    return nt.prequential_calibration(_yearly(spark, sf_dir), "s", "y").select("fold", "date", F.round("p", 6).alias("p"))


@query(
    "sta_07_calibration_diagnostic",
    f"""{_YEARLY.replace('WITH', 'WITH RECURSIVE', 1)}, lg AS (SELECT fold AS k, y, LN(GREATEST(LEAST(p, 1 - 1e-8), 1e-8) / (1 - GREATEST(LEAST(p, 1 - 1e-8), 1e-8))) AS l FROM (SELECT fold, y, ROUND(0.02 + 0.9 * (RANK() OVER (PARTITION BY fold ORDER BY s) - 1) / COUNT(*) OVER (PARTITION BY fold), 9) AS p FROM sc)), lk AS (SELECT k FROM lg GROUP BY k HAVING SUM(y) > 0 AND SUM(y) < COUNT(*)), ll AS (SELECT * FROM lg SEMI JOIN lk USING (k)), {_newton('ll', 'l')}
SELECT k AS fold, n, ROUND(a, 6) AS intercept, ROUND(b, 6) AS slope, CASE WHEN a IS NULL THEN 'one_class' ELSE 'converged' END AS status FROM (SELECT k, COUNT(*) AS n FROM lg GROUP BY k) AS c LEFT JOIN nt USING (k)""",
)
def calibration_diagnostic(spark, sf_dir):
    over = Window.partitionBy("fold")
    p = F.round(0.02 + 0.9 * (F.rank().over(over.orderBy("s")) - 1) / F.count("*").over(over), 9)
    out = nt.calibration_diagnostic(_yearly(spark, sf_dir).withColumn("p", p), "p", "y", ["fold"])
    return out.select("fold", "n", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), "status")


_TRAINED = """fd AS (SELECT DISTINCT fold FROM sc), pq AS (SELECT fd.fold AS k, s, y FROM fd JOIN sc ON sc.fold < fd.fold), qu AS (SELECT k, QUANTILE_CONT(s, 0.01) AS lo, QUANTILE_CONT(s, 0.99) AS hi FROM pq GROUP BY k),
cl AS (SELECT k, GREATEST(LEAST(s, hi), lo) AS c FROM pq JOIN qu USING (k)), ms AS (SELECT k, AVG(c) AS m, STDDEV_SAMP(c) AS sd FROM cl GROUP BY k), tz AS (SELECT k, (GREATEST(LEAST(s, hi), lo) - m) / NULLIF(sd, 0) AS z, y FROM pq JOIN qu USING (k) JOIN ms USING (k)),
tk AS (SELECT k FROM tz GROUP BY k HAVING SUM(y) > 0 AND SUM(y) < COUNT(*)), tr AS (SELECT * FROM tz SEMI JOIN tk USING (k))"""
_WALKED = f"""{_YEARLY.replace('WITH', 'WITH RECURSIVE', 1)}, {_TRAINED}, {_newton('tr', 'z', 1.0)}, br AS (SELECT k, AVG(y) AS base_rate FROM tr GROUP BY k),
wk AS (SELECT fold, date, y, base_rate, 1 / (1 + EXP(-(a + b * (GREATEST(LEAST(s, hi), lo) - m) / sd))) AS p FROM sc JOIN nt ON nt.k = fold JOIN qu ON qu.k = fold JOIN ms ON ms.k = fold JOIN br ON br.k = fold)"""


@query("mod_08_persistence", f"{_WALKED} SELECT fold, date, ROUND(p, 6) AS p, ROUND(base_rate, 8) AS base_rate FROM wk")
def persistence(spark, sf_dir):
    out, _ = nt.walk_forward_logistic(_yearly(spark, sf_dir), ["s"], "y", 1.0)
    return out.where("p IS NOT NULL").select("fold", "date", F.round("p", 6).alias("p"), F.round("base_rate", 8).alias("base_rate"))


@query(
    "mod_08_fold_ledger",
    f"{_WALKED}, rw AS (SELECT *, {R.avg_rank('p', 'fold')} AS r FROM wk) SELECT fold, COUNT(*) AS n, ROUND(ANY_VALUE(base_rate), 8) AS base_rate, ROUND(AVG((p - y) ** 2), 6) AS brier, ROUND(AVG((base_rate - y) ** 2), 6) AS baseline_brier, ROUND((SUM(r * y) - SUM(y) * (SUM(y) + 1) / 2) / NULLIF(SUM(y) * (COUNT(*) - SUM(y)), 0), 5) AS auc FROM rw GROUP BY fold",
)
def fold_ledger(spark, sf_dir):
    out, _ = nt.walk_forward_logistic(_yearly(spark, sf_dir), ["s"], "y", 1.0)
    made = nt.fold_ledger(store.materialized(out.where("p IS NOT NULL")), "y")
    return made.select("fold", "n", F.round("base_rate", 8).alias("base_rate"), F.round("brier", 6).alias("brier"), F.round("baseline_brier", 6).alias("baseline_brier"), F.round("auc", 5).alias("auc"))


_PIECES = """t AS (SELECT fold, MIN(s) AS t0, QUANTILE_CONT(s, 0.5) AS t1, MAX(s) AS t2 FROM sc GROUP BY fold), e AS (SELECT fold, date, s AS v, GREATEST(LEAST(s, t2), t0) AS x, t0, t1, t2, t1 - t0 AS h, t2 - t1 AS k FROM (SELECT sc.fold, date, s * 1.5 - 0.25 * t2 AS s, t0, t1, t2 FROM sc JOIN t USING (fold)))"""


@query(
    "mod_03_spline_basis",
    f"""{_YEARLY}, {_PIECES}, b AS (SELECT *, CASE WHEN x < t1 THEN (x - t0 + h) * (t1 - x) / (2 * h * h) + (t2 - x) * (x - t0) / ((t2 - t0) * h) ELSE (t2 - x) ** 2 / ((t2 - t0) * k) END AS b1, CASE WHEN x < t1 THEN (x - t0) ** 2 / ((t2 - t0) * h) ELSE (x - t0) * (t2 - x) / ((t2 - t0) * k) + (t2 + k - x) * (x - t1) / (2 * k * k) END AS b2, CASE WHEN x < t1 THEN 0 ELSE (x - t1) ** 2 / (2 * k * k) END AS b3,
CASE WHEN v < t0 THEN 1 / h WHEN v > t2 THEN 0 ELSE 0 END AS d0 FROM e)
SELECT fold, date, ROUND(b1 + (v - x) * CASE WHEN v < t0 THEN 1 / h WHEN v > t2 THEN 0 ELSE 0 END, 7) AS s1, ROUND(b2 + (v - x) * CASE WHEN v > t2 THEN -1 / k ELSE 0 END, 7) AS s2, ROUND(b3 + (v - x) * CASE WHEN v > t2 THEN 1 / k ELSE 0 END, 7) AS s3 FROM b""",
)
def spline_basis(spark, sf_dir):
    """Splines on each year's knots at values that reach beyond them."""
    rows = _yearly(spark, sf_dir)
    knots = nt.spline_knots(rows, ["s"], ["fold"])
    wide = rows.join(F.broadcast(knots), "fold").select("fold", "date", (F.col("s") * 1.5 - 0.25 * F.col("s_t2")).alias("s"))
    made, used = nt.with_splines(wide, knots, ["s"], ["fold"])
    return made.select("fold", "date", *(F.round(c, 7).alias(c.replace("s_", "")) for c in used))


@query("mod_03_spline_logistic")
def spline_logistic(spark, sf_dir):
    """Penalised logistic fits on the spline basis, each year by all earlier ones; the tests hold it against a plain fit."""
    out, _ = nt.walk_forward_logistic(_yearly(spark, sf_dir), ["s"], "y", 1.0, splines=True)
    return out.select("fold", "date", F.round("raw", 6).alias("raw"), F.round("p", 6).alias("p"))


_STEPS = """ix AS (SELECT fold, ROUND(s, 2) AS s, COUNT(*) AS w, SUM(x) AS t FROM sc GROUP BY ALL), ip AS (SELECT fold, s, ROW_NUMBER() OVER o AS i, SUM(w) OVER o AS cw, SUM(t) OVER o AS ct, w, t FROM ix WINDOW o AS (PARTITION BY fold ORDER BY s)),
im AS (SELECT a.fold, a.i AS i, b.i AS k, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS m FROM ip a JOIN ip b ON a.fold = b.fold AND b.i >= a.i), iu AS (SELECT fold, i AS j, k, MIN(m) OVER (PARTITION BY fold, i ORDER BY k DESC) AS u FROM im), iv AS (SELECT fold, k AS i, MAX(u) AS value FROM iu WHERE j <= k GROUP BY 1, 2)"""


@query("mod_13_isotonic_blocks", f"{_YEARLY}, {_STEPS}, st AS (SELECT fold, s, w, ROUND(value, 7) AS value FROM ip JOIN iv USING (fold, i)) SELECT fold, MIN(s) AS low, MAX(s) AS high, SUM(w)::DOUBLE AS weight, value FROM st GROUP BY fold, value")
def isotonic_blocks(spark, sf_dir):
    rows = _yearly(spark, sf_dir).withColumn("s", F.round("s", 2))
    return iso.isotonic_blocks(rows, "s", "x", ["fold"], group=16).withColumn("value", F.round("value", 7))


@query(
    "mod_13_isotonic_values",
    f"""{_YEARLY}, {_STEPS}, st AS (SELECT fold, s, value, i FROM ip JOIN iv USING (fold, i)), nx AS (SELECT fold + 1 AS fold, date, s AS v FROM sc), mt AS (SELECT nx.fold, date, v, MAX(s) FILTER (WHERE s <= v) AS a, MIN(s) FILTER (WHERE s > v) AS b FROM nx JOIN st ON st.fold = nx.fold GROUP BY ALL)
SELECT mt.fold, date, ROUND(CASE WHEN a IS NULL THEN q.value WHEN b IS NULL THEN p.value ELSE p.value + (q.value - p.value) * (v - a) / (b - a) END, 6) AS fitted FROM mt LEFT JOIN st p ON p.fold = mt.fold AND p.s = a LEFT JOIN st q ON q.fold = mt.fold AND q.s = b""",
)
def isotonic_values(spark, sf_dir):
    """Each year's scores by the step function of the year after: inside, between and beyond its blocks."""
    rows = _yearly(spark, sf_dir)
    blocks = store.materialized(iso.isotonic_blocks(rows.withColumn("s", F.round("s", 2)), "s", "x", ["fold"]))
    out = iso.isotonic_values(rows.select((F.col("fold") + 1).alias("fold"), "date", "s").join(F.broadcast(blocks.select("fold").distinct()), "fold"), blocks, "s", ["fold"])
    return out.select("fold", "date", F.round("fitted", 6).alias("fitted"))
