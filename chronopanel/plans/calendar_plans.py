"""Calendars and schedules (CAL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.plans import registry as R
from chronopanel.plans.registry import query
from chronopanel.sources import panel

_CAL = f"{R.MARKET_BARS}, {R.cal('bars')}"


def _calendar(spark, sf_dir):
    return cal.session_calendar(panel.table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("cal_01_sessions", f"WITH {_CAL} SELECT date, idx, next_session, month_last, week_last FROM cal")
def sessions(spark, sf_dir):
    return _calendar(spark, sf_dir)


@query("cal_01_previous_sessions", f"WITH {_CAL} SELECT a.date, b.date AS session FROM cal a JOIN cal b ON b.idx BETWEEN a.idx - 5 AND a.idx - 1 WHERE a.month_last")
def previous_sessions(spark, sf_dir):
    c = _calendar(spark, sf_dir)
    return cal.window_before(c, c.where("month_last"), 5)


@query("cal_02_monthly_schedule", f"WITH {_CAL} SELECT date AS signal_date, next_session AS execution_date FROM cal WHERE month_last AND next_session IS NOT NULL")
def monthly(spark, sf_dir):
    return cal.rebalance_schedule(_calendar(spark, sf_dir), "monthly")


@query("cal_02_weekly_schedule", f"WITH {_CAL} SELECT date AS signal_date, next_session AS execution_date FROM cal WHERE week_last AND next_session IS NOT NULL")
def weekly(spark, sf_dir):
    return cal.rebalance_schedule(_calendar(spark, sf_dir), "weekly")


@query(
    "cal_03_decision_calendar",
    f"""WITH {_CAL}, w AS (SELECT date AS signal_date, next_session AS execution_date FROM cal WHERE week_last AND next_session IS NOT NULL)
SELECT 'W' || LPAD(CAST(ROW_NUMBER() OVER (ORDER BY signal_date) AS VARCHAR), 5, '0') AS week_id, signal_date, execution_date,
  LEAD(execution_date) OVER (ORDER BY signal_date) AS next_1w_execution, LEAD(execution_date, 4) OVER (ORDER BY signal_date) AS next_4w_execution,
  DAYNAME(signal_date) AS signal_weekday, DAYNAME(execution_date) AS execution_weekday, DAYNAME(signal_date) <> 'Friday' AS not_friday FROM w""",
)
def decisions(spark, sf_dir):
    return cal.decision_calendar(_calendar(spark, sf_dir)).drop("signal_utc", "execution_utc")


@query("cal_04_research_dates", f"WITH {_CAL} SELECT date AS signal_date, week_last, month_last FROM cal WHERE (week_last OR month_last) AND next_session IS NOT NULL")
def research(spark, sf_dir):
    return cal.research_signal_dates(_calendar(spark, sf_dir))


@query(
    "cal_05_labelled_schedules",
    f"""WITH {_CAL}, s AS (SELECT 'weekly' AS frequency, date AS signal_date, next_session AS execution_date FROM cal WHERE week_last AND next_session IS NOT NULL
  UNION ALL SELECT 'monthly', date, next_session FROM cal WHERE month_last AND next_session IS NOT NULL)
SELECT * FROM (SELECT *, LEAD(execution_date) OVER (PARTITION BY frequency ORDER BY signal_date) AS label_end FROM s) AS x WHERE label_end IS NOT NULL""",
)
def labelled(spark, sf_dir):
    return cal.labelled_schedule(_calendar(spark, sf_dir))


@query(
    "cal_06_session_instants",
    f"""WITH {_CAL}, w AS (SELECT date AS signal_date, next_session FROM cal WHERE week_last AND next_session IS NOT NULL)
SELECT signal_date, epoch(timezone('America/New_York', signal_date + INTERVAL 16 HOUR))::BIGINT AS signal_epoch, epoch(timezone('America/New_York', next_session + INTERVAL 570 MINUTE))::BIGINT AS execution_epoch FROM w""",
)
def instants(spark, sf_dir):
    out = cal.decision_calendar(_calendar(spark, sf_dir))
    return out.select("signal_date", F.unix_timestamp("signal_utc").alias("signal_epoch"), F.unix_timestamp("execution_utc").alias("execution_epoch"))


@query(
    "cal_08_forecast_start",
    f"""WITH {_CAL}, t0 AS (SELECT MIN(date) AS t0 FROM cal WHERE date >= DATE '1997-01-01')
SELECT 'weekly' AS frequency, t0 AS start FROM t0
UNION ALL SELECT 'monthly', MAX(next_session) FROM cal, t0 WHERE month_last AND next_session < t0""",
)
def forecast_start(spark, sf_dir):
    c = _calendar(spark, sf_dir)
    t0 = c.where("date >= DATE '1997-01-01'").agg(F.min("date").alias("t0"))
    before = cal.rebalance_schedule(c, "monthly").crossJoin(F.broadcast(t0)).where("execution_date < t0").agg(F.max("execution_date").alias("start"))
    return t0.select(F.lit("weekly").alias("frequency"), F.col("t0").alias("start")).unionByName(before.select(F.lit("monthly").alias("frequency"), "start"))
