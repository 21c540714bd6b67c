"""Point-in-time queries (PIT) and the joins around them (JON)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import point_in_time as pit
from chronopanel.plans import registry as R
from chronopanel.plans.registry import query
from chronopanel.sources import panel

_SPAN = "CAST(substr(p_brand, 7) AS INT) AS n FROM part GROUP BY ALL"
INTERVALS = f"""iv AS (SELECT sid, CAST(DATE '1995-01-01' + (n % 7) * 100 AS DATE) AS effective_from, CASE WHEN n % 3 <> 0 THEN CAST(DATE '1995-01-01' + (n % 7) * 100 + 700 AS DATE) END AS effective_to FROM (SELECT p_brand AS sid, {_SPAN}) AS b)"""


def intervals(spark, sf_dir):
    """One interval for each brand, from its number."""
    n = F.substring("sid", 7, 9).cast("int")
    brands = panel.table(spark, sf_dir, "part").select(F.col("p_brand").alias("sid")).distinct()
    start = F.date_add(F.to_date(F.lit("1995-01-01")), n % 7 * 100)
    return brands.select("sid", start.alias("effective_from"), F.when(n % 3 != 0, F.date_add(start, 700)).alias("effective_to"))


_CAL = f"{R.px()}, {R.cal('px')}, {INTERVALS}"


def _months(spark, sf_dir):
    return cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").where("month_last").select("date")


_ACTIVE = "effective_from <= date AND (effective_to IS NULL OR date < effective_to)"


@query("pit_01_members_on", f"WITH {_CAL} SELECT date, sid FROM cal JOIN iv ON {_ACTIVE} WHERE month_last")
def members(spark, sf_dir):
    return pit.members_on(intervals(spark, sf_dir), _months(spark, sf_dir))


def _snapshots(spark, sf_dir):
    bars = panel.prices(spark, sf_dir)
    return bars.join(F.broadcast(_months(spark, sf_dir)), "date").select("date", "sid")


_SNAP = f"{R.px()}, {R.cal('px')}, sn AS (SELECT px.date, sid FROM px JOIN cal USING (date) WHERE month_last)"


@query(
    "pit_01_snapshot_members",
    f"""WITH {_SNAP}, e AS (SELECT date AS snapshot_date, LEAD(date) OVER (ORDER BY date) AS until FROM (SELECT DISTINCT date FROM sn) AS d)
SELECT cal.date, snapshot_date, sid FROM cal JOIN e ON snapshot_date <= cal.date AND (until IS NULL OR cal.date < until) JOIN sn ON sn.date = snapshot_date WHERE week_last""",
)
def snapshot_members(spark, sf_dir):
    weeks = cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate").where("week_last")
    return pit.snapshot_members_on(_snapshots(spark, sf_dir), weeks)


_FAULTY = f"""{INTERVALS}, fv AS (SELECT sid, effective_from, effective_to FROM iv UNION ALL SELECT sid, effective_from, effective_to FROM iv WHERE sid LIKE '%1' UNION ALL SELECT sid, CAST(effective_from + 300 AS DATE), effective_to FROM iv WHERE sid LIKE '%2'
  UNION ALL SELECT sid, CAST(effective_from - 50 AS DATE), CAST(effective_from - 60 AS DATE) FROM iv WHERE sid LIKE '%3')"""


@query(
    "pit_02_interval_faults",
    f"""WITH {_FAULTY}, w AS (SELECT *, ROW_NUMBER() OVER o AS k, LAG(effective_from) OVER o AS wf, LAG(effective_to) OVER o AS wt, MAX(effective_to) OVER b AS reach, BOOL_OR(effective_to IS NULL) OVER b AS open_before FROM fv WINDOW o AS (PARTITION BY sid ORDER BY effective_from, effective_to NULLS LAST), b AS (PARTITION BY sid ORDER BY effective_from, effective_to NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM (SELECT sid, effective_from, CASE WHEN effective_to <= effective_from THEN 'empty' WHEN k > 1 AND wf = effective_from AND wt IS NOT DISTINCT FROM effective_to THEN 'repeated' WHEN open_before THEN 'open_not_last' WHEN reach > effective_from THEN 'overlap' END AS fault FROM w) AS q WHERE fault IS NOT NULL""",
)
def interval_faults(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    late = iv.where("sid LIKE '%2'").withColumn("effective_from", F.date_add("effective_from", 300))
    empty = iv.where("sid LIKE '%3'").select("sid", F.date_sub("effective_from", 50).alias("effective_from"), F.date_sub("effective_from", 60).alias("effective_to"))
    return pit.interval_faults(iv.unionByName(iv.where("sid LIKE '%1'")).unionByName(late).unionByName(empty))


@query("pit_03_member_counts", f"WITH {_CAL} SELECT date, COUNT(*) AS n_members FROM cal JOIN iv ON {_ACTIVE} WHERE month_last GROUP BY date")
def member_counts(spark, sf_dir):
    return members(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n_members"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query(
    "pit_04_facts_as_of",
    f"""SELECT user_id, event_type, v.event_id AS event_id, v.ts AS ts, v.k AS k FROM (SELECT user_id, event_type, MAX_BY({{'event_id': event_id, 'ts': ts, 'k': {_K}}}, {{'ts': ts, 'e': event_id}}) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2) AS q""",
)
def as_of(spark, sf_dir):
    facts = panel.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return pit.facts_as_of(facts, F.to_timestamp(F.lit("2024-01-15 00:00:00")), ["user_id", "event_type"], "ts", "event_id")


@query(
    "pit_05_snapshot_intervals",
    f"""WITH {_SNAP}, o AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS n, LEAD(date) OVER (ORDER BY date) AS until FROM (SELECT DISTINCT date FROM sn) AS d),
i AS (SELECT sid, date, n, until, n - ROW_NUMBER() OVER (PARTITION BY sid ORDER BY n) AS island FROM sn JOIN o USING (date))
SELECT sid, MIN(date) AS effective_from, ARG_MAX({{'u': until}}, n).u AS effective_to FROM i GROUP BY sid, island""",
)
def snapshot_intervals(spark, sf_dir):
    return pit.snapshots_to_intervals(_snapshots(spark, sf_dir))


@query("pit_06_overlapping", f"WITH {INTERVALS} SELECT * FROM iv WHERE effective_from <= DATE '1997-12-31' AND (effective_to IS NULL OR effective_to > DATE '1997-03-01')")
def overlapping(spark, sf_dir):
    return pit.overlapping(intervals(spark, sf_dir), F.to_date(F.lit("1997-03-01")), F.to_date(F.lit("1997-12-31")))


@query(
    "pit_08_merged_intervals",
    f"""WITH {_SNAP}, c AS (SELECT sid, date AS effective_from, CAST(date + 40 AS DATE) AS e FROM sn), n AS (SELECT *, COALESCE(effective_from > MAX(e) OVER (PARTITION BY sid ORDER BY effective_from, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS is_new FROM c),
i AS (SELECT *, SUM(is_new) OVER (PARTITION BY sid ORDER BY effective_from, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT sid, MIN(effective_from) AS effective_from, MAX(e) AS effective_to FROM i GROUP BY sid, island""",
)
def merged(spark, sf_dir):
    return pit.merged(_snapshots(spark, sf_dir).select("sid", F.col("date").alias("effective_from"), F.date_add("date", 40).alias("effective_to")))


@query(
    "pit_08_split_intervals",
    f"""WITH {INTERVALS}, b AS (SELECT *, DATE '1996-06-15' AS boundary FROM iv)
SELECT sid, effective_from, CASE WHEN boundary > effective_from AND (effective_to IS NULL OR boundary < effective_to) THEN boundary ELSE effective_to END AS effective_to FROM b
UNION ALL SELECT sid, boundary, effective_to FROM b WHERE boundary > effective_from AND (effective_to IS NULL OR boundary < effective_to)""",
)
def split(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return pit.split_at(iv, iv.select("sid", F.to_date(F.lit("1996-06-15")).alias("boundary")))


@query(
    "pit_09_replaced_intervals",
    f"WITH {INTERVALS} SELECT sid, effective_from, CASE WHEN sid LIKE '%2' THEN DATE '2000-01-01' ELSE effective_to END AS effective_to FROM iv",
)
def replaced(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    overrides = iv.where("sid LIKE '%2'").select("sid", F.col("effective_from").alias("match_from"), F.col("effective_to").alias("match_to"), F.col("effective_from").alias("new_from"), F.to_date(F.lit("2000-01-01")).alias("new_to"))
    return pit.replaced(iv, overrides)


_EVENT_CAL = "ec AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE dayofweek(ts) NOT IN (0, 6))"


@query(
    "pit_10_first_session_after",
    f"""WITH {_EVENT_CAL}, i AS (SELECT date, date + INTERVAL 16 HOUR AS closes, LAG(date + INTERVAL 16 HOUR) OVER (ORDER BY date) AS before FROM ec)
SELECT event_id, date AS signal_date FROM events LEFT JOIN i ON ts + INTERVAL 10 MINUTE <= closes AND (before IS NULL OR ts + INTERVAL 10 MINUTE > before)""",
)
def first_session(spark, sf_dir):
    events = panel.table(spark, sf_dir, "events").select("event_id", "ts")
    days = cal.session_calendar(events.where(~F.dayofweek("ts").isin(1, 7)), "ts")
    return pit.first_session_after(events, days, "ts").select("event_id", "signal_date")


@query(
    "pit_12_asof_backward",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, l.ts, r.ts AS matched_at, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof(spark, sf_dir):
    events = panel.table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", "value")
    return pit.asof_backward(left, right, ["user_id"], "ts", ["value"], F.date_trunc("day", "ts"))


@query(
    "pit_12_stale_observations",
    f"""WITH {R.MARKET}, o AS (SELECT date AS observed, idx, close FROM m WHERE idx % 9 = 0), s AS (SELECT date, idx FROM m WHERE week_last)
SELECT date, CASE WHEN s.idx - 1 - o.idx <= 5 THEN observed END AS observed, CASE WHEN s.idx - 1 - o.idx <= 5 THEN close END AS close FROM s ASOF LEFT JOIN o ON s.idx - 1 >= o.idx""",
)
def stale(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    over = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("idx") % 9 == 0, F.struct("idx", "date", "close")), True).over(over)
    fresh = lambda c: F.when(F.col("idx") - 1 - F.col("s.idx") <= 5, c)
    return m.withColumn("s", seen).where("week_last").select("date", fresh(F.col("s.date")).alias("observed"), fresh(F.col("s.close")).alias("close"))


_FILINGS = """fl AS (SELECT o_custkey AS entity, YEAR(o_orderdate) AS fiscal_year, CAST(make_date(YEAR(o_orderdate), 12, 31) AS DATE) AS period_end, o_orderkey AS accession, CAST(o_orderdate + (o_orderkey % 400) * INTERVAL 1 DAY AS DATE) AS available, o_totalprice AS value FROM orders),
sg AS (SELECT UNNEST([DATE '1997-06-30', DATE '1998-12-31', DATE '2000-06-30']) AS signal_date)"""


@query(
    "pit_13_latest_filings",
    f"""WITH {_FILINGS}, y AS (SELECT signal_date, entity, fiscal_year, MAX_BY({{'a': accession, 'v': value, 'p': period_end}}, {{'d': available, 'a': accession}}) AS r FROM fl JOIN sg ON available <= signal_date GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY signal_date, entity ORDER BY r.p DESC, fiscal_year DESC) AS n FROM y)
SELECT c.signal_date, c.entity, c.fiscal_year AS current_year, c.r.a AS current_accession, c.r.v AS current_value, p.r.a AS prior_accession, p.r.v AS prior_value
FROM k c LEFT JOIN k p ON p.signal_date = c.signal_date AND p.entity = c.entity AND p.fiscal_year = c.fiscal_year - 1 WHERE c.n = 1""",
)
def filings(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    available = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int"))
    fl = o.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fiscal_year"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end"), F.col("o_orderkey").alias("accession"), available.alias("available"), available.alias("accepted_at"), F.col("o_totalprice").alias("value"))
    signals = spark.sql("SELECT explode(array(DATE'1997-06-30', DATE'1998-12-31', DATE'2000-06-30')) AS signal_date")
    return pit.latest_filings(fl, signals)


@query("pit_15_clipped_intervals", f"WITH {INTERVALS} SELECT * FROM (SELECT sid, GREATEST(effective_from, DATE '1996-01-01') AS effective_from, LEAST(COALESCE(effective_to, DATE '1996-12-31'), DATE '1996-12-31') AS effective_to FROM iv) AS q WHERE effective_from < effective_to")
def clipped(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return pit.clipped(iv, iv.select("sid", F.to_date(F.lit("1996-01-01")).alias("span_from"), F.to_date(F.lit("1996-12-31")).alias("span_to")))


@query(
    "pit_16_mapping_coverage",
    f"""WITH {_CAL}, mb AS (SELECT date, sid FROM cal CROSS JOIN (SELECT DISTINCT sid FROM px) AS s WHERE month_last),
h AS (SELECT mb.date, mb.sid, BOOL_OR(COALESCE({_ACTIVE}, false)) AS hit FROM mb LEFT JOIN iv USING (sid) GROUP BY ALL)
SELECT date, COUNT(*) AS n_members, CAST(SUM(hit::INT) AS BIGINT) AS n_mapped FROM h GROUP BY date""",
)
def coverage(spark, sf_dir):
    months = _months(spark, sf_dir)
    iv = intervals(spark, sf_dir)
    return pit.mapping_coverage(F.broadcast(months).crossJoin(iv.select("sid")), iv)


@query(
    "pit_20_held_target",
    f"WITH {R.MARKET} SELECT date, LAST_VALUE(CASE WHEN month_last THEN ROUND((idx % 4) / 4.0, 4) END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS target FROM m",
)
def held_target(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    return pit.held(m.where("month_last").select("date", F.round(F.col("idx") % 4 / 4.0, 4).alias("target")), m, "target")


@query(
    "pit_21_held_allocation",
    f"WITH {R.MARKET} SELECT date, COALESCE(LAST_VALUE(CASE WHEN week_last AND idx % 3 <> 0 THEN ROUND((idx % 5) / 5.0, 4) END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) AS allocation FROM m",
)
def held_allocation(spark, sf_dir):
    m = panel.market(spark, sf_dir)
    done = m.where("week_last AND idx % 3 <> 0").select("date", F.round(F.col("idx") % 5 / 5.0, 4).alias("allocation"))
    return pit.held(done, m, "allocation", 1.0)


_RATES = f"{R.spine(R.BRAND)}, {INTERVALS}"


@query(
    "jon_01_factor_database",
    f"""WITH {_RATES}, f AS (SELECT date, sid, {R.ret('close', R.lag('close', 21))} AS v FROM spine), k AS (SELECT date, iv.sid, factor_id FROM cal JOIN iv ON {_ACTIVE} CROSS JOIN (VALUES ('reversal_21'), ('unknown')) AS t(factor_id) WHERE month_last),
j AS (SELECT k.*, CASE WHEN factor_id = 'reversal_21' THEN -v END AS score, CASE WHEN factor_id = 'unknown' THEN 'no_source_factor_row' WHEN v IS NULL THEN 'insufficient_history' END AS missing_reason FROM k LEFT JOIN f USING (date, sid))
SELECT date, sid, factor_id, ROUND(score, 8) AS score, missing_reason, CASE WHEN score IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY date, factor_id ORDER BY score DESC NULLS LAST, sid) END AS rank,
  CASE WHEN score IS NOT NULL THEN ROUND(1 - (ROW_NUMBER() OVER (PARTITION BY date, factor_id ORDER BY score DESC NULLS LAST, sid) - 1.0) / COUNT(score) OVER (PARTITION BY date, factor_id), 8) END AS percentile FROM j""",
)
def factor_database(spark, sf_dir):
    from chronopanel.operators import factor_database as db
    from chronopanel.operators import market_factors as mf

    spine = panel.spine(panel.prices(spark, sf_dir))
    source = mf.factor_table(mf.daily_inputs(spine, panel.market(spark, sf_dir)), ["reversal_21"], F.col("month_last"))
    registry = spark.createDataFrame([("reversal_21",), ("unknown",)], "factor_id string")
    out = db.build_factor_database(members(spark, sf_dir).withColumnRenamed("date", "signal_date"), registry, source)
    return out.select(F.col("signal_date").alias("date"), "sid", "factor_id", F.round("score", 8).alias("score"), "missing_reason", "rank", F.round("percentile", 8).alias("percentile"))
