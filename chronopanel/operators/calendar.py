"""Sessions, week and month ends, rebalance schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _in_order() -> WindowSpec:
    """A calendar is one row for each session; windows over all of it hold thousands of rows at most."""
    return Window.orderBy("date")


def week_of(date: Column) -> Column:
    """The Monday after the Saturday that opens the Saturday-to-Friday week of a date."""
    return F.date_trunc("week", F.date_add(date, 2)).cast("date")


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def session_calendar(dated: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx, next_session, month_last, week_last) of the distinct dates."""
    days = dated.select(F.col(date).cast("date").alias("date")).where("date IS NOT NULL").distinct()
    numbered = days.select("date", F.row_number().over(_in_order()).alias("idx"), F.lead("date").over(_in_order()).alias("next_session"))
    ends = lambda of: F.coalesce(of(F.col("next_session")) != of(F.col("date")), F.lit(True))
    return numbered.withColumn("month_last", ends(month_of)).withColumn("week_last", ends(week_of))


def rebalance_schedule(calendar: DataFrame, frequency: str) -> DataFrame:
    """(signal_date, execution_date): the last session of each week or month and the next session; none for the last without a next."""
    flag = {"weekly": "week_last", "monthly": "month_last"}[frequency]
    return calendar.where(F.col(flag) & F.col("next_session").isNotNull()).select(F.col("date").alias("signal_date"), F.col("next_session").alias("execution_date"))


def research_signal_dates(calendar: DataFrame) -> DataFrame:
    """Week and month ends that have a next session, with both flags."""
    return calendar.where((F.col("week_last") | F.col("month_last")) & F.col("next_session").isNotNull()).select(F.col("date").alias("signal_date"), "week_last", "month_last")


def labelled_schedule(calendar: DataFrame) -> DataFrame:
    """(frequency, signal_date, execution_date, label_end) of both frequencies; label_end: the next execution."""
    parts = [rebalance_schedule(calendar, f).withColumn("frequency", F.lit(f)) for f in ("monthly", "weekly")]
    both = parts[0].unionByName(parts[1])
    over = Window.partitionBy("frequency").orderBy("signal_date")
    return both.withColumn("label_end", F.lead("execution_date").over(over)).where("label_end IS NOT NULL").select("frequency", "signal_date", "execution_date", "label_end")


def decision_calendar(calendar: DataFrame) -> DataFrame:
    """Weekly decisions: week_id, signal and execution session, executions one and four weeks on, weekdays, holiday flag, instants in New York."""
    weeks = rebalance_schedule(calendar, "weekly")
    over = Window.orderBy("signal_date")
    at = lambda day, clock: F.to_utc_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(clock)), "America/New_York")
    return weeks.select(
        F.format_string("W%05d", F.row_number().over(over)).alias("week_id"),
        "signal_date",
        "execution_date",
        F.lead("execution_date", 1).over(over).alias("next_1w_execution"),
        F.lead("execution_date", 4).over(over).alias("next_4w_execution"),
        F.date_format("signal_date", "EEEE").alias("signal_weekday"),
        F.date_format("execution_date", "EEEE").alias("execution_weekday"),
        (F.dayofweek("signal_date") != 6).alias("not_friday"),
        at("signal_date", "16:00:00").alias("signal_utc"),
        at("execution_date", "09:30:00").alias("execution_utc"),
    )


def window_before(calendar: DataFrame, dates: DataFrame, n: int) -> DataFrame:
    """(date, session) for the n sessions before each of the dates."""
    marked = calendar.join(F.broadcast(dates.select("date").distinct()), "date").select(F.col("date").alias("at"), F.explode(F.sequence(F.col("idx") - n, F.col("idx") - 1)).alias("idx"))
    return marked.join(calendar.select("idx", F.col("date").alias("session")), "idx").select(F.col("at").alias("date"), "session")
