"""A (date, sid) price panel from sales lines: what the panel operators run on where no price history is at hand.

A name's close on a date is its sales-weighted price; sums are decimal, so that they don't depend on the order of rows.
The calendar holds the dates with any sale, numbered from 1. It has one row for each date, whatever the volume, so
windows over it, and over single series on it, are as small as the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators.calendar import session_calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(18,4)")).cast("double")


def _bars(lines: DataFrame, keys: list[str]) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    paid = exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.groupBy(*keys).agg((paid / exact_sum(F.col("l_quantity"))).alias("close"), F.min(price).alias("open"), F.max(price).alias("high"), exact_sum(F.col("l_quantity")).alias("volume"))


#: Names of the panel, by how many there are.
BRAND, SIZE_GROUP, TYPE = "p_brand", "concat('G', cast(p_size % 5 as int))", "p_type"


def prices(spark: SparkSession, sf_dir: str, sid: str = BRAND) -> DataFrame:
    """(date, sid, close, open, high, volume); sid: an expression over part. The part table is joined as it comes: Spark chooses how."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_discount", "l_quantity")
    names = table(spark, sf_dir, "part").select("p_partkey", F.expr(sid).alias("sid"))
    return _bars(lines.join(names, lines.l_partkey == names.p_partkey), ["date", "sid"])


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, idx, next_session, month_last, week_last, close, open, high, volume, rf): all names as one series."""
    bars = _bars(table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate")), ["date"])
    return with_cash(session_calendar(bars)).join(bars, "date")


def with_cash(calendar: DataFrame) -> DataFrame:
    """A small return on cash for each session, from its number."""
    return calendar.withColumn("rf", (1 + F.col("idx") % 7) * 0.00001)


def spine(prices: DataFrame) -> DataFrame:
    """All sessions of all names, with prices where there are any. Names times calendar rows: both are stated sets, not the data."""
    calendar = session_calendar(prices)
    names = prices.select("sid").distinct()
    return names.crossJoin(F.broadcast(calendar)).join(prices, ["date", "sid"], "left")


def by_name(order: str = "idx") -> Window:
    return Window.partitionBy("sid").orderBy(order)
