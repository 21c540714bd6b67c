"""Price, close and rate files of providers as canonical tables. Dates may stand once; more are an error, not a choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.sources.store import repeated_keys


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    again = repeated_keys(df, keys).limit(1).collect()
    if again:
        raise ValueError(f"{keys} stands more than once: {again[0]}")
    return df


def _pick(df: DataFrame, *names: str) -> list[str]:
    """The columns of these names in whatever case."""
    have = {c.strip().lower(): c for c in df.columns}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return [have[n] for n in names]


def read_closes(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """(date, close, provider) of CSV files with a header that has DATE and CLOSE in any case; ISO or US dates."""
    raw = spark.read.option("header", True).csv(path)
    date, close = _pick(raw, "date", "close")
    day = F.coalesce(F.try_to_date(F.col(f"`{date}`")), F.try_to_date(F.col(f"`{date}`"), "MM/dd/yyyy"))
    out = raw.select(day.alias("date"), F.col(f"`{close}`").try_cast("double").alias("close"), F.lit(provider).alias("provider"))
    if out.where("date IS NULL OR close IS NULL OR close <= 0").limit(1).count():
        raise ValueError(f"{path} has rows without a date or a positive close")
    return _once(out, ["date"])


def read_rates(spark: SparkSession, path: str, most: float = 0.01) -> DataFrame:
    """(date, rf_return, rf_log) of CSV files of date, rf_return; returns beyond `most` either way are an error."""
    raw = spark.read.option("header", True).csv(path)
    date, rate = _pick(raw, "date", "rf_return")
    out = raw.select(F.to_date(F.col(f"`{date}`")).alias("date"), F.col(f"`{rate}`").cast("double").alias("rf_return"))
    if out.where(F.col("rf_return").isNull() | (F.abs("rf_return") > most)).limit(1).count():
        raise ValueError(f"{path} has rates beyond {most} or none")
    return _once(out.withColumn("rf_log", F.log1p("rf_return")), ["date"])


def read_prices(spark: SparkSession, path: str, sid: str) -> DataFrame:
    """(date, sid, tr_*, raw_*, volume, dividends, stock_splits) of JSON arrays with adjusted fields; a split factor of 1 is no event."""
    fields = "date string, open double, high double, low double, close double, volume double, adjOpen double, adjHigh double, adjLow double, adjClose double, divCash double, splitFactor double"
    raw = spark.read.schema(fields).option("multiLine", True).json(path)
    prices = [f"{k}_{c}" for k in ("tr", "raw") for c in ("open", "high", "low", "close")]
    out = raw.select(
        F.to_date(F.substring("date", 1, 10)).alias("date"),
        F.lit(sid).alias("sid"),
        *(F.col(f"adj{c.capitalize()}").alias(f"tr_{c}") for c in ("open", "high", "low", "close")),
        *(F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close")),
        "volume",
        F.col("divCash").alias("dividends"),
        F.when(F.col("splitFactor") == 1, 0.0).otherwise(F.col("splitFactor")).alias("stock_splits"),
    )
    bad = " OR ".join(f"{c} IS NULL OR isnan({c}) OR {c} <= 0 OR {c} = double('Infinity')" for c in prices)
    if out.where(f"date IS NULL OR {bad}").limit(1).count():
        raise ValueError(f"{path} has prices that are not positive numbers")
    return _once(out, ["date", "sid"])


def long_fields(wide: DataFrame, date: str = "date", separator: str = ":") -> DataFrame:
    """(date, sid, one column for each field) from one column "field:symbol" for each field and symbol."""
    names = [c for c in wide.columns if separator in c]
    long = wide.select(date, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot([date], names, "name", "value")
    parts = F.split("name", separator)
    fields = sorted({c.split(separator)[0] for c in names})
    return long.select(F.to_date(date).alias("date"), parts[1].alias("sid"), parts[0].alias("field"), "value").groupBy("date", "sid").pivot("field", fields).agg(F.first("value"))
