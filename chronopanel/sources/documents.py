"""Nested and text payloads as tables: filings, facts, price files, membership snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNAR = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>"
TICKERS = "map<string,struct<ticker:string,cik_str:bigint,title:string>>"
FACTS = "map<string,map<string,struct<label:string,units:map<string,array<struct<`end`:string,val:double,accn:string,fy:int,form:string>>>>>>"


def company_tickers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(ticker, cik, name) from JSON objects of {key: {ticker, cik_str, title}}; repeated rows once."""
    entries = F.explode(F.map_values(F.from_json(column, TICKERS)))
    return payloads.select(entries.alias("e")).select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"), F.trim("e.title").alias("name")).distinct()


def filing_ledger(payloads: DataFrame, column: str = "payload", entity: str = "cik") -> DataFrame:
    """(entity, accession, form, filed, report_date, is_amendment) from parallel arrays; arrays of different lengths are an error."""
    parsed = payloads.select(entity, F.from_json(column, f"struct<{', '.join(c.replace(' ', ':') for c in COLUMNAR.split(', '))}>").alias("p"))
    n = F.size("p.accessionNumber")
    even = (F.size("p.form") == n) & (F.size("p.filingDate") == n) & (F.size("p.reportDate") == n)
    checked = parsed.select(entity, F.when(even, F.col("p")).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast(parsed.schema["p"].dataType)).alias("p"))
    rows = checked.select(entity, F.explode(F.arrays_zip("p.accessionNumber", "p.form", "p.filingDate", "p.reportDate")).alias("r"))
    return rows.select(entity, F.col("r.accessionNumber").alias("accession"), F.col("r.form").alias("form"), F.to_date("r.filingDate").alias("filed"), F.to_date(F.nullif("r.reportDate", F.lit(""))).alias("report_date"), F.endswith("r.form", F.lit("/A")).alias("is_amendment"))


def numeric_facts(payloads: DataFrame, column: str = "payload", entity: str = "cik") -> DataFrame:
    """(entity, taxonomy, concept, label, unit, period_end, value, accession, fiscal_year, form) from taxonomy -> concept -> units -> observations."""
    a = payloads.select(entity, F.explode(F.from_json(column, FACTS)).alias("taxonomy", "concepts"))
    b = a.select(entity, "taxonomy", F.explode("concepts").alias("concept", "c"))
    c = b.select(entity, "taxonomy", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "observations"))
    d = c.select(entity, "taxonomy", "concept", "label", "unit", F.explode("observations").alias("o"))
    return d.select(entity, "taxonomy", "concept", "label", "unit", F.to_date("o.end").alias("period_end"), F.col("o.val").alias("value"), F.col("o.accn").alias("accession"), F.col("o.fy").alias("fiscal_year"), F.col("o.form").alias("form"))


def observation_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """(date, value) from lines of "date,value"; "." and nothing are null; the header line isn't a date and goes."""
    parts = F.split(column, ",")
    rows = lines.select(F.try_to_date(F.trim(parts[0])).alias("date"), F.trim(parts[1]).alias("said")).where("date IS NOT NULL")
    return rows.select("date", F.when(~F.col("said").isin(".", "") & F.col("date").isNotNull(), F.col("said").try_cast("double")).alias("value"))


def membership_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(date, sid) from lines of a date and a quoted, comma-separated list."""
    date = F.to_date(F.regexp_extract(column, r"^([^,]+),", 1))
    names = F.split(F.regexp_extract(column, r"^[^,]+,\"?([^\"]*)\"?$", 1), ",")
    return lines.select(date.alias("date"), F.explode(names).alias("sid")).select("date", F.trim("sid").alias("sid")).where("sid <> ''").distinct()


def unadjusted_to_total_return(bars: DataFrame) -> DataFrame:
    """bars (date, sid, raw_*, adjusted_close) with tr_* = raw * adjusted_close / raw_close, and tr_close the adjusted close."""
    ratio = F.try_divide("adjusted_close", "raw_close")
    return bars.select("*", *((F.col(f"raw_{c}") * ratio).alias(f"tr_{c}") for c in ("open", "high") if f"raw_{c}" in bars.columns), F.col("adjusted_close").alias("tr_close"))
