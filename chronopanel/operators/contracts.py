"""Joins that say how many rows of either side may meet, and tables that must hold what they promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.fundamentals import unit_matches


def unique_on(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df; the job fails with a message where two rows share their keys. Rows with a null among their keys share them with none, as no join lets them meet.

    Rows are dealt by the keys, as a join on them deals them too.
    """
    whole = F.when(F.concat(*(F.col(k).isNotNull().cast("string") for k in keys)).contains("false"), None).otherwise(1)
    n = F.count(whole).over(Window.partitionBy(*keys))
    at = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys))
    fault = F.raise_error(F.concat(F.lit(f"{what}: more than one row for "), at))
    return df.withColumn("n_", n).where(F.when(F.col("n_") > 1, fault.cast("boolean")).otherwise(F.lit(True))).drop("n_")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str = "n:1", how: str = "inner") -> DataFrame:
    """A join on equal keys of which each side marked 1 in the cardinality (1:1, 1:n, n:1, n:m) must be unique."""
    keys = list(keys)
    one_left, one_right = (x == "1" for x in cardinality.split(":"))
    left = unique_on(left, keys, "left") if one_left else left
    right = unique_on(right, keys, "right") if one_right else right
    return left.join(right, keys, how)


def cardinality_faults(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, n_keys, n_repeated, n_alone) of the keys of two tables: how many there are, stand more than once, and have no partner."""
    keys = list(keys)
    sizes = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = sizes(left, "a").join(sizes(right, "b"), keys, "full")

    def side(name: str, mine: str, other: str) -> DataFrame:
        count = lambda c: F.sum(c.cast("long"))
        return both.where(F.col(mine).isNotNull()).agg(F.lit(name).alias("side"), F.count("*").alias("n_keys"), count(F.col(mine) > 1).alias("n_repeated"), count(F.col(other).isNull()).alias("n_alone"))

    return side("left", "a", "b").unionByName(side("right", "b", "a"))


def with_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "indicator") -> DataFrame:
    """left with the columns of right, n:1, and both or left_only."""
    return checked_join(left, right.withColumn("found_", F.lit(True)), keys, "n:1", "left").withColumn(name, F.when(F.col("found_"), "both").otherwise("left_only")).drop("found_")


def source_panel(rows: DataFrame, source: str, signals: DataFrame) -> DataFrame:
    """(signal_date, sid, factor_id, raw_value, score, eligible, missing_reason, source_panel) of a factor table as the database takes it.

    Only the signal dates' rows are looked at (a stated set): what later rows hold is of no account. A row is eligible if its score is a
    finite number; one that isn't has a reason: its own, or no_reason_given.
    """
    here = rows.join(F.broadcast(signals.select("signal_date").distinct()), "signal_date", "left_semi")
    finite = lambda c: F.when(F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf"))), None).otherwise(F.col(c))
    made = here.select("signal_date", "sid", "factor_id", finite("raw_value").alias("raw_value"), finite("score").alias("score"), "missing_reason")
    eligible = F.col("score").isNotNull()
    return made.select("signal_date", "sid", "factor_id", "raw_value", "score", eligible.alias("eligible"), F.when(~eligible, F.coalesce("missing_reason", F.lit("no_reason_given"))).alias("missing_reason"), F.lit(source).alias("source_panel"))


def tagged_facts(facts: DataFrame, tags: DataFrame, shortest: int = 300, longest: int = 430) -> DataFrame:
    """Facts with each metric of their tag, n:m; durations must be a year long, instants have none; values must be finite, units of the metric's family.

    A duration's days are those between its ends. tags: tag, metric_id, period_type, unit_family; a stated set.
    """
    met = facts.join(F.broadcast(tags), "tag").withColumn("duration_days", F.datediff("period_end", "period_start"))
    period = F.when(F.col("period_type") == "instant", F.col("period_start").isNull()).otherwise(F.col("duration_days").between(shortest, longest))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & F.col("period_end").isNotNull()
    return met.where(period & finite & unit_matches(F.col("unit"), F.col("unit_family")))


def with_filing(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts (accession, form, filed, ...) with their filing's metadata, n:1, and what differs: form_mismatch, filed_mismatch, and accepted_before_period_end."""
    ledger = filings.select("accession", F.col("form").alias("filing_form"), F.col("filed").alias("filing_filed"), "accepted_at")
    met = checked_join(facts, ledger, ["accession"], "n:1", "left")
    return met.withColumn("form_mismatch", F.col("form") != F.col("filing_form")).withColumn("filed_mismatch", F.col("filed") != F.col("filing_filed")).withColumn("accepted_before_period_end", F.to_date("accepted_at") < F.col("period_end"))


def registered_tags(payload: Column, schema: str, tags: Sequence[str]) -> Column:
    """A JSON map of tags, parsed with only the registered ones kept."""
    return F.map_filter(F.from_json(payload, schema), lambda k, _: k.isin(*tags))


def by_frequency(features: DataFrame, schedules: DataFrame) -> DataFrame:
    """features at the dates of each schedule (frequency, date), stacked with the frequency. Schedules are stated sets."""
    return features.join(F.broadcast(schedules.select("frequency", "date").distinct()), "date")


def development_rows(features: DataFrame, targets: DataFrame, lockbox: str) -> DataFrame:
    """Features and targets of one date, 1:1; the job fails if a row lies in the lockbox or its label ends there."""
    met = checked_join(features, targets, ["date"], "1:1")
    leaks = (F.col("date") >= F.lit(lockbox).cast("date")) | (F.col("label_end") >= F.lit(lockbox).cast("date"))
    return met.where(F.when(leaks, F.raise_error(F.lit("a row reaches into the lockbox")).cast("boolean")).otherwise(F.lit(True)))


def complete_arms(long: DataFrame, arms: Sequence[str], labels: DataFrame) -> DataFrame:
    """One row for each date with a column for each arm and its labels, and is_complete: nothing is missing."""
    wide = long.groupBy("date").pivot("arm", list(arms)).agg(F.max("score"))
    met = checked_join(wide, labels, ["date"], "1:1")
    there = F.lit(True)
    for c in met.columns:
        there = there & F.col(c).isNotNull()
    return met.withColumn("is_complete", there)
