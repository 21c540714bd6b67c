"""Annual facts of entities: canonical selection, restated vintages, ratios with the reason where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import point_in_time as pit


def unit_matches(unit: Column, family: Column) -> Column:
    said = F.upper(F.trim(unit))
    return F.when(F.upper(family) == "SHARES", said.isin("SHARES", "SHARE")).otherwise(said == F.upper(family))


def canonical_facts(facts: DataFrame, registry: DataFrame, shortest: int = 300, longest: int = 430) -> DataFrame:
    """(entity, accession, fiscal_year, metric_id, value, tag, rank): of each filing the fact of the tag of least rank.

    facts: entity, accession, fiscal_year, tag, unit, value, period_start, period_end. registry: metric_id, tag, rank,
    unit_family, period_type; a stated set. Durations must be a year long; a rank with different facts is ambiguous and
    the next rank isn't taken in its place.
    """
    days = F.datediff("period_end", "period_start")
    joined = facts.join(F.broadcast(registry), "tag").where(unit_matches(F.col("unit"), F.col("unit_family")))
    joined = joined.where((F.col("period_type") == "instant") | days.between(shortest, longest))
    keys = ["entity", "accession", "fiscal_year", "metric_id"]
    best = joined.groupBy(*keys, "rank", "tag").agg(F.countDistinct("value", "unit").alias("n"), F.max("value").alias("value"))
    first = F.min("rank").over(Window.partitionBy(*keys))
    return best.withColumn("least", first).where("rank = least AND n = 1").select(*keys, "value", "tag", "rank")


def wide_metrics(canonical: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each filing, a column for each metric."""
    return canonical.groupBy("entity", "accession", "fiscal_year").pivot("metric_id", metrics).agg(F.first("value"))


def _missing(names: list[str]) -> Column:
    return F.nullif(F.concat_ws(";", *(F.when(F.col(n).isNull(), f"missing_metric:{n}") for n in names)), F.lit(""))


def gross_profitability(wide: DataFrame) -> DataFrame:
    """(entity, accession, fiscal_year, value, reason) of (revenue - cost) / assets."""
    bad = F.when(F.col("assets") <= 0, "nonpositive_assets").when((F.col("revenue") < 0) | (F.col("cost") < 0), "negative_flow")
    reason = F.coalesce(_missing(["revenue", "cost", "assets"]), bad)
    return wide.select("entity", "accession", "fiscal_year", F.when(reason.isNull(), (F.col("revenue") - F.col("cost")) / F.nullif("assets", F.lit(0))).alias("value"), reason.alias("reason"))


def with_prior_year(wide: DataFrame, names: list[str]) -> DataFrame:
    """wide (one row for each entity and year) with prior_ columns of the year before; a skipped year leaves them null."""
    before = wide.select("entity", (F.col("fiscal_year") + 1).alias("fiscal_year"), *(F.col(n).alias(f"prior_{n}") for n in names))
    return wide.join(before, ["entity", "fiscal_year"], "left")


def asset_growth(both: DataFrame) -> DataFrame:
    """(entity, fiscal_year, value, score, reason) of assets over those of the year before."""
    reason = F.coalesce(_missing(["assets", "prior_assets"]), F.when((F.col("assets") <= 0) | (F.col("prior_assets") <= 0), "nonpositive_assets"))
    value = F.when(reason.isNull(), F.col("assets") / F.nullif("prior_assets", F.lit(0)) - 1)
    return both.select("entity", "fiscal_year", value.alias("value"), (-value).alias("score"), reason.alias("reason"))


def accruals(both: DataFrame) -> DataFrame:
    """(entity, fiscal_year, value, score, reason) of (revenue - cost - cash flow) / mean assets."""
    reason = F.coalesce(_missing(["revenue", "cost", "cash_flow", "assets", "prior_assets"]), F.when(F.col("assets") + F.col("prior_assets") <= 0, "nonpositive_assets"))
    value = F.when(reason.isNull(), (F.col("revenue") - F.col("cost") - F.col("cash_flow")) / F.nullif((F.col("assets") + F.col("prior_assets")) / 2, F.lit(0)))
    return both.select("entity", "fiscal_year", value.alias("value"), (-value).alias("score"), reason.alias("reason"))


def identity_audit(wide: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(entity, accession, fiscal_year, residual, relative_error, status) of revenue - cost = gross profit."""
    residual = F.col("revenue") - F.col("cost") - F.col("gross_profit")
    error = F.abs(residual) / F.greatest(F.abs("revenue"), F.abs("cost"), F.abs("gross_profit"), F.lit(1.0))
    status = F.when(residual.isNull(), "incomplete").when(error <= tolerance, "holds").otherwise("violated")
    return wide.select("entity", "accession", "fiscal_year", residual.alias("residual"), error.alias("relative_error"), status.alias("status"))


def gross_profit_identity(facts: DataFrame) -> DataFrame:
    """(entity, fiscal_year, revenue, cost, gross_profit, status): of the candidates of the three metrics the combination of least ranks that adds up.

    facts: entity, fiscal_year, metric_id, rank, value. A rank with several values is no candidate. Where none adds up
    within max(1, 1e-6 of the largest), cost is what revenue and gross profit of the least ranks leave. An entity and year
    has a few candidates, so their combinations are few.
    """
    keys = ["entity", "fiscal_year"]
    sure = facts.groupBy(*keys, "metric_id", "rank").agg(F.countDistinct("value").alias("n"), F.max("value").alias("value")).where("n = 1")
    side = lambda m, v, r: sure.where(F.col("metric_id") == m).select(*keys, F.col("value").alias(v), F.col("rank").alias(r))
    all_ = side("revenue", "revenue", "r1").join(side("gross_profit", "gross_profit", "r3"), keys).join(side("cost", "cost", "r2"), keys, "left")
    gap = F.abs(F.col("revenue") - F.col("cost") - F.col("gross_profit"))
    limit = F.greatest(F.lit(1.0), 1e-6 * F.greatest(F.abs("revenue"), F.abs("cost"), F.abs("gross_profit")))
    marked = all_.withColumn("fits", F.coalesce(gap <= limit, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.col("fits").desc(), "r1", F.col("r2").asc_nulls_last(), "r3")
    best = marked.withColumn("place", F.row_number().over(order)).where("place = 1")
    made = F.greatest(F.lit(0.0), F.col("revenue") - F.col("gross_profit"))
    return best.select(*keys, "revenue", F.when(F.col("fits"), F.col("cost")).otherwise(made).alias("cost"), "gross_profit", F.when(F.col("fits"), "reported").otherwise("derived_cost").alias("status"))


def market_equity_as_of(equity: DataFrame, signals: DataFrame, most_stale: int = 7) -> DataFrame:
    """(signal_date, entity, market_equity, reason): the last measurement on or before the signal that was available by then.

    equity: entity, measured, available, market_equity, is_audited. signals: a stated set of dates.
    """
    known = pit.known_intervals(equity, ["entity"], F.greatest("measured", "available"), F.struct("measured", "available", "market_equity", "is_audited"))
    here = pit.active(F.col("signal_date"), F.col("known_from"), F.col("known_until"))
    last = known.join(F.broadcast(signals.select("signal_date").distinct()), here).select("signal_date", "entity", F.col("v").alias("m"))
    stale = F.datediff("signal_date", "m.measured") > most_stale
    reason = F.when(stale, "stale").when(~F.col("m.is_audited"), "share_classes_not_audited").when(F.col("m.market_equity") <= 0, "nonpositive")
    return last.select("signal_date", "entity", F.when(reason.isNull(), F.col("m.market_equity")).alias("market_equity"), reason.alias("reason"))


def ratio_to_equity(filings: DataFrame, equity: DataFrame, numerator: str) -> DataFrame:
    """(signal_date, entity, value, reason) of a metric of the current filing over market equity; reasons of either side pass on."""
    both = filings.join(equity, ["signal_date", "entity"], "left")
    reason = F.when(F.col(numerator).isNull(), f"missing_metric:{numerator}").otherwise(F.coalesce("reason", F.when(F.col("market_equity").isNull(), F.lit("no_measurement"))))
    return both.select("signal_date", "entity", F.when(reason.isNull(), F.col(numerator) / F.nullif("market_equity", F.lit(0))).alias("value"), reason.alias("reason"))


def readiness(database: DataFrame, least_coverage: float, least_names: int, least_dates: int) -> DataFrame:
    """(factor_id, coverage, n_covered_dates, status) of a factor database (factor_id, signal_date, eligible)."""
    daily = database.groupBy("factor_id", "signal_date").agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("e"))
    whole = daily.groupBy("factor_id").agg((F.sum("e") / F.sum("n")).alias("coverage"), F.sum((F.col("e") >= least_names).cast("long")).alias("n_covered_dates"))
    status = F.when(F.col("coverage") < least_coverage, "low_coverage").when(F.col("n_covered_dates") < least_dates, "too_few_dates").otherwise("ready")
    return whole.withColumn("status", status)


def required(facts: DataFrame, metrics: list[str], flows: list[str]) -> DataFrame:
    """(entity, fiscal_year, one column for each metric, reason): what a ratio needs of a filing, and why it can't have it, joined by semicolons.

    facts: entity, fiscal_year, metric_id, value, unit, period_start. A metric may be missing, ambiguous (several values),
    invalid (not a finite number) or without a unit; flow metrics must share one start of their period.
    """
    keys = ["entity", "fiscal_year"]
    here = facts.where(F.col("metric_id").isin(*metrics))
    invalid = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    one = here.groupBy(*keys, "metric_id").agg(F.countDistinct(F.coalesce("value", F.lit(float("nan")))).alias("n"), F.max("value").alias("value"), F.max(invalid).alias("invalid"), F.max(F.col("unit").isNull()).alias("no_unit"), F.max("period_start").alias("start"))
    state = F.when(F.col("n") > 1, "ambiguous").when(F.col("invalid"), "invalid").when(F.col("no_unit"), "missing_unit")
    wide = one.groupBy(*keys).agg(
        *(F.max(F.when((F.col("metric_id") == m) & state.isNull(), F.col("value"))).alias(m) for m in metrics),
        F.map_from_entries(F.collect_list(F.struct("metric_id", F.coalesce(state, F.lit("")).alias("state")))).alias("states"),
        F.countDistinct(F.when(F.col("metric_id").isin(*flows), F.col("start"))).alias("n_starts"),
    )
    why = [F.when(~F.array_contains(F.map_keys("states"), m), f"missing_metric:{m}").otherwise(F.when(F.try_element_at("states", F.lit(m)) != "", F.concat(F.try_element_at("states", F.lit(m)), F.lit(f":{m}")))) for m in metrics]
    reason = F.nullif(F.concat_ws(";", *why, F.when(F.col("n_starts") > 1, "different_periods")), F.lit(""))
    return wide.select(*keys, *(F.when(reason.isNull(), F.col(m)).alias(m) for m in metrics), reason.alias("reason"))


def sloan_accruals(both: DataFrame) -> DataFrame:
    """(entity, fiscal_year, value, score, reason) of ((change of current assets - of cash) - (of current liabilities - of short debt - of taxes payable) - depreciation) / mean assets; low is good.

    both: this year's and prior_ columns.
    """
    moved = ["current_assets", "cash", "current_liabilities", "short_debt", "taxes_payable"]
    change = lambda c: F.col(c) - F.col(f"prior_{c}")
    needed = [*moved, *(f"prior_{c}" for c in moved), "depreciation", "assets", "prior_assets"]
    mean = (F.col("assets") + F.col("prior_assets")) / 2
    reason = F.coalesce(_missing(needed), F.when(mean <= 0, "nonpositive_assets"))
    total = change("current_assets") - change("cash") - (change("current_liabilities") - change("short_debt") - change("taxes_payable")) - F.col("depreciation")
    value = F.when(reason.isNull(), total / F.nullif(mean, F.lit(0.0)))
    return both.select("entity", "fiscal_year", value.alias("value"), (-value).alias("score"), reason.alias("reason"))


def net_payout_yield(filings: DataFrame, equity: DataFrame) -> DataFrame:
    """(signal_date, entity, value, reason) of (dividends + repurchases - issuance) / market equity; a flow that isn't reported counts as none, but not all three."""
    flows = ["dividends", "repurchases", "issuance"]
    both = filings.join(equity, ["signal_date", "entity"], "left")
    none = F.coalesce(*(F.col(c) for c in flows)).isNull()
    reason = F.when(none, "no_payout_reported").otherwise(F.coalesce("reason", F.when(F.col("market_equity").isNull(), "no_measurement")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    net = zero("dividends") + zero("repurchases") - zero("issuance")
    return both.select("signal_date", "entity", F.when(reason.isNull(), net / F.nullif("market_equity", F.lit(0.0))).alias("value"), reason.alias("reason"))


def coverage_checks(filings: DataFrame, facts: DataFrame, canonical: DataFrame, least: float) -> DataFrame:
    """(check_id, group, numerator, denominator, coverage, status): how many filings have facts, how many facts a filing, and how many filings each canonical metric.

    One row for each check and group: counts over the keys, never rows brought together.
    """
    known = filings.select("accession").distinct()
    has = facts.select("accession").distinct().withColumn("has", F.lit(1))
    by_filing = known.join(has, "accession", "left").agg(F.lit("filings_with_facts").alias("check_id"), F.lit("all").alias("group"), F.count("has").alias("numerator"), F.count("*").alias("denominator"))
    by_fact = facts.join(known.withColumn("has", F.lit(1)), "accession", "left").agg(F.lit("facts_with_filing").alias("check_id"), F.lit("all").alias("group"), F.count("has").alias("numerator"), F.count("*").alias("denominator"))
    n = known.agg(F.count("*").alias("denominator"))
    by_metric = canonical.groupBy(F.col("metric_id").alias("group")).agg(F.countDistinct("accession").alias("numerator")).crossJoin(F.broadcast(n))  # one row
    by_metric = by_metric.select(F.lit("metric_coverage").alias("check_id"), "group", "numerator", "denominator")
    rows = by_filing.unionByName(by_fact).unionByName(by_metric)
    share = F.try_divide("numerator", "denominator")
    return rows.withColumn("coverage", share).withColumn("status", F.when(share.isNull(), "empty").when(share >= least, "pass").otherwise("fail"))


def factor_panel(values: DataFrame, mappings: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal_date, sid, factor_id, value, entity, reason) for every name with an active mapping on each signal date (a stated set), and every factor.

    values: signal_date, entity, factor_id, value, reason. mappings: sid, entity, effective_from, effective_to. A name with
    two entities on a date has none (ambiguous_mapping); a factor without a row is no_value.
    """
    days = F.broadcast(signals.select("signal_date").distinct())
    active = mappings.join(days, pit.active(F.col("signal_date"), F.col("effective_from"), F.col("effective_to")))
    names = active.groupBy("signal_date", "sid").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("n"))
    factors = values.select("factor_id").distinct()  # a registry of some dozen
    keys = names.crossJoin(F.broadcast(factors))
    met = keys.join(values.select("signal_date", "entity", "factor_id", "value", "reason", F.lit(True).alias("has")), ["signal_date", "entity", "factor_id"], "left")
    reason = F.when(F.col("n") > 1, "ambiguous_mapping").when(F.col("has").isNull(), "no_value").otherwise(F.col("reason"))
    return met.select("signal_date", "sid", "factor_id", F.when(reason.isNull(), F.col("value")).alias("value"), F.when(F.col("n") == 1, F.col("entity")).alias("entity"), reason.alias("reason"))


def change_date_states(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """(entity, known_from, known_until, {metric} ...): what is known of each entity, one row from each date on which something of it changes.

    facts: entity, metric_id, value, period_end, available. Of a metric the fact of the latest period, then the latest
    available, counts from when both are past. Rows grow with the facts, not with the dates that ask for them.
    """
    at = F.greatest("available", "period_end")
    known = pit.known_intervals(facts.where(F.col("metric_id").isin(metrics)), ["entity", "metric_id"], at, F.struct("period_end", "available", "value"))
    changes = known.groupBy("entity", "known_from").pivot("metric_id", metrics).agg(F.max("v"))
    over = Window.partitionBy("entity").orderBy("known_from")
    carried = {m: F.last(m, True).over(over.rowsBetween(Window.unboundedPreceding, 0)) for m in metrics}
    wide = changes.select("entity", "known_from", F.lead("known_from").over(over).alias("known_until"), *(c.alias(m) for m, c in carried.items()))
    return wide.select("entity", "known_from", "known_until", *(F.col(f"{m}.value").alias(m) for m in metrics))


def change_date_panel(facts: DataFrame, mapping: DataFrame, metrics: list[str], factors: dict[str, Column]) -> DataFrame:
    """(sid, entity, valid_from, valid_until, factor_id, value, reason): factor values as intervals, computed where an input or the mapping changes.

    mapping: sid, entity, effective_from, effective_to (null: open). factors: expressions over the metrics. A value that
    isn't there has a reason: the metrics that aren't known by then, or undefined.
    """
    states = change_date_states(facts, metrics)
    nothing = mapping.select("entity").distinct().select("entity", F.lit("0001-01-01").cast("date").alias("known_from"), *(F.lit(None).cast("double").alias(m) for m in metrics))
    firsts = states.groupBy("entity").agg(F.min("known_from").alias("known_until"))
    states = states.unionByName(nothing.join(firsts, "entity", "left").select(*states.columns))
    met = mapping.join(states, "entity").where((F.col("effective_to").isNull() | (F.col("known_from") < F.col("effective_to"))) & (F.col("known_until").isNull() | (F.col("known_until") > F.col("effective_from"))))
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("factor_id"), e.cast("double").alias("value")) for f, e in factors.items()))).alias("f")
    reason = F.coalesce(_missing(metrics), F.lit("undefined"))
    out = met.select("sid", "entity", F.greatest("known_from", "effective_from").alias("valid_from"), F.least("known_until", "effective_to").alias("valid_until"), reason.alias("why"), values)
    return out.select("sid", "entity", "valid_from", "valid_until", "f.factor_id", "f.value", F.when(F.col("f.value").isNull(), F.col("why")).alias("reason"))


def at_signals(intervals: DataFrame, signals: DataFrame) -> DataFrame:
    """Intervals laid out on signal dates, a stated set."""
    days = F.broadcast(signals.select("signal_date").distinct())
    return intervals.join(days, pit.active(F.col("signal_date"), F.col("valid_from"), F.col("valid_until"))).drop("valid_from", "valid_until")
