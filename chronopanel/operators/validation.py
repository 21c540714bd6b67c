"""Contracts of panels and ledgers: each check gives the rows or counts that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def canonical_prices(df: DataFrame, at: str, sid: str, numbers: Sequence[str]) -> DataFrame:
    """(date, sid, numbers): midnight dates without a zone, sids as text, numbers as doubles with infinities and NaN as null."""
    return df.select(F.to_date(at).alias("date"), F.col(sid).cast("string").alias("sid"), *(C.finite(F.col(n).cast("double")).alias(n) for n in numbers))


def price_faults(prices: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(date, sid, fault) of bars that are not positive, or whose high or low doesn't hold open and close. Columns: open, high, low, close."""
    bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))
    high, low = F.col("high") * (1 + tolerance), F.col("low") * (1 - tolerance)
    fault = F.when(bad("open") | bad("high") | bad("low") | bad("close"), "not_positive").when(high < F.greatest("open", "close"), "high_below").when(low > F.least("open", "close"), "low_above")
    return prices.select("date", "sid", fault.alias("fault")).where("fault IS NOT NULL")


def masked(prices: DataFrame, overrides: DataFrame, values: Sequence[str]) -> DataFrame:
    """prices with the values voided on the dates of overrides (override_id, sid, start_date, end_date, is_closed), and override_id there.

    overrides is a ledger of some rows and goes to all executors; intervals of a name don't overlap.
    """
    o = F.broadcast(overrides.withColumnRenamed("sid", "of_sid"))
    inside = (F.col("sid") == F.col("of_sid")) & (F.col("date") >= F.col("start_date")) & (F.when(F.col("is_closed"), F.col("date") <= F.col("end_date")).otherwise(F.col("date") < F.col("end_date")))
    joined = prices.join(o, inside, "left")
    return joined.select(*(F.when(F.col("override_id").isNull(), F.col(c)).alias(c) if c in values else F.col(c) for c in prices.columns), "override_id")


def mask_audit(prices: DataFrame, overrides: DataFrame, value: str) -> DataFrame:
    """(override_id, n_rows, n_masked, n_already_missing) of each override, those without a row too."""
    marked = masked(prices.withColumn("had", F.col(value)), overrides, [value]).where("override_id IS NOT NULL")
    counts = marked.groupBy("override_id").agg(F.count("*").alias("n_rows"), F.count("had").alias("n_masked"))
    out = overrides.select("override_id").join(counts, "override_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("override_id", zero("n_rows").alias("n_rows"), zero("n_masked").alias("n_masked"), zero(F.col("n_rows") - F.col("n_masked")).alias("n_already_missing"))


def action_faults(ledger: DataFrame) -> DataFrame:
    """(action_id, fault) of terminal actions: wrong signs for the type, applied before it is legal, more than one for a source."""
    cash, ratio = F.coalesce("cash", F.lit(0.0)), F.coalesce("ratio", F.lit(0.0))
    sign = F.when(F.col("action_type") == "cash", (cash > 0) & (ratio == 0)).when(F.col("action_type") == "stock", (cash == 0) & (ratio > 0)).when(F.col("action_type") == "mixed", (cash > 0) & (ratio > 0)).when(F.col("action_type") == "worthless", (cash == 0) & (ratio == 0)).otherwise(F.lit(False))
    many = F.count(F.lit(1)).over(Window.partitionBy("source_sid")) > 1
    fault = F.when(~sign, "wrong_terms").when(F.col("apply_session") < F.col("legal_date"), "applied_early").when(many, "source_repeated")
    return ledger.select("action_id", fault.alias("fault")).where("fault IS NOT NULL")


def assets_on(master: DataFrame, date: str) -> DataFrame:
    """(sid, symbol) of the mappings that hold on a date; the provider's symbol, else the ticker."""
    d = F.to_date(F.lit(date))
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (d < F.col("valid_to")))
    return master.where(holds).select("sid", F.coalesce("provider_sid", "ticker").alias("symbol"))


def extreme_returns(spine: DataFrame, limit: float) -> DataFrame:
    """(date, sid, log_return) of closes that moved by more than `limit` in logarithm from the last known close."""
    over = Window.partitionBy("sid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = spine.withColumn("before", F.last("close", True).over(over))
    return rows.select("date", "sid", C.log_return(F.col("close"), F.col("before")).alias("log_return")).where(F.abs("log_return") > limit)


def reviewed(outliers: DataFrame, allowlist: DataFrame) -> DataFrame:
    """outliers (date, sid, ...) with the status of the allowlist (date, sid, status), else unreviewed."""
    return outliers.join(F.broadcast(allowlist.select("date", "sid", "status")), ["date", "sid"], "left").withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def panel_gates(spine: DataFrame, least_coverage: float, least_mean: float) -> DataFrame:
    """(gate, value, passes) of the panel's coverage, repeated keys and incomplete bars."""
    daily = spine.groupBy("date").agg(F.avg(F.col("close").isNotNull().cast("double")).alias("coverage"), (F.count("*") - F.countDistinct("sid")).alias("repeated"), F.sum((F.col("close").isNotNull() != F.col("open").isNotNull()).cast("long")).alias("partial"))
    one = daily.agg(F.min("coverage").alias("least_coverage"), F.avg("coverage").alias("mean_coverage"), F.sum("repeated").cast("double").alias("repeated_keys"), F.sum("partial").cast("double").alias("partial_bars"))
    long = one.unpivot([], one.columns, "gate", "value")
    limit = F.create_map(*(F.lit(x) for x in ("least_coverage", least_coverage, "mean_coverage", least_mean)))
    passes = F.when(F.col("gate").isin("repeated_keys", "partial_bars"), F.col("value") == 0).otherwise(F.col("value") >= limit[F.col("gate")])
    return long.withColumn("passes", passes)


def metric_identity(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """(n, max_difference, is_identical) of two metric tables; a key in one only counts as different."""
    side = lambda df, s: df.select(*keys, *(F.col(v).alias(f"{v}_{s}") for v in values), F.lit(True).alias(s))
    both = side(a, "a").join(side(b, "b"), list(keys), "full")
    gaps = F.greatest(*(F.when(F.col(f"{v}_a").isNull() & F.col(f"{v}_b").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")), F.lit(float("inf")))) for v in values), F.lit(0.0))
    gap = F.when(F.col("a").isNull() | F.col("b").isNull(), float("inf")).otherwise(gaps)
    return both.agg(F.count("*").alias("n"), F.max(gap).alias("max_difference"), (F.max(gap) <= tolerance).alias("is_identical"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place_ = 1").drop("place_")


def calendar_faults(calendar: DataFrame, flags: list[str]) -> DataFrame:
    """(fault, n): sessions that stand more than once, and flags that are null."""
    repeated = calendar.groupBy("date").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated").alias("fault"), F.count("*").alias("n"))
    for c in flags:
        repeated = repeated.unionByName(calendar.agg(F.lit(f"null:{c}").alias("fault"), F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias("n")))
    return repeated


def benchmark_faults(rows: DataFrame, calendar: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(date, fault) of a benchmark that may name its close either way: both or neither given, repeated, or no session."""
    a, b = (F.col(c).isNotNull() for c in names)
    counted = rows.withColumn("n_", F.count("*").over(Window.partitionBy("date"))).join(F.broadcast(calendar.select("date", F.lit(True).alias("open_"))), "date", "left")
    fault = F.when(a & b, "both_closes").when(~a & ~b, "no_close").when(F.col("n_") > 1, "repeated").when(F.col("open_").isNull(), "no_session")
    return counted.select("date", fault.alias("fault")).where("fault IS NOT NULL")


def missing_execution_prices(targets: DataFrame, spine: DataFrame) -> DataFrame:
    """(execution_idx, sid) of targets without an open on their execution session."""
    opens = spine.select("sid", F.col("idx").alias("execution_idx"), "open").where("open > 0")
    return targets.select("execution_idx", "sid").join(opens, ["execution_idx", "sid"], "left_anti")


def mapping_faults(mappings: DataFrame, start: str, end: str) -> DataFrame:
    """(sid, symbol, fault) of mappings (sid, symbol, effective_from, effective_to) within a range: empty in it, of several symbols for a sid, or a symbol of several sids."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    clipped = mappings.withColumn("a_", F.greatest("effective_from", first)).withColumn("z_", F.least(F.coalesce("effective_to", last), last))
    inside = clipped.withColumn("out_", F.col("a_") >= F.col("z_"))
    kept = inside.where("NOT out_")
    by_sid = kept.groupBy("sid").agg(F.countDistinct("symbol").alias("n_symbols"))
    by_symbol = kept.groupBy("symbol").agg(F.countDistinct("sid").alias("n_sids"))
    met = inside.join(by_sid, "sid", "left").join(by_symbol, "symbol", "left")
    fault = F.when(F.col("out_"), "outside").when(F.col("n_symbols") > 1, "several_symbols").when(F.col("n_sids") > 1, "symbol_reused")
    return met.select("sid", "symbol", fault.alias("fault")).where("fault IS NOT NULL")
