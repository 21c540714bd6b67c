"""Alerts that know only the past, paths around events, and states with perfect foresight for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def past_position(series: DataFrame, x: str, least: int, quantile: float = 0.75, low: bool = False) -> DataFrame:
    """series (one series, idx) with n_past, z, threshold and alert: x against the values strictly before it; null before `least` of them.

    An alert is a value above the quantile of its past; with `low`, one below it.
    """
    past = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = series.withColumn("n_past", F.count(x).over(past))
    ready = F.col("n_past") >= least
    z = (F.col(x) - F.avg(x).over(past)) / F.nullif(F.stddev_samp(x).over(past), F.lit(0.0))
    rows = rows.withColumn("z", F.when(ready, z)).withColumn("threshold", F.when(ready, F.percentile(x, F.lit(quantile)).over(past)))
    return rows.withColumn("alert", (F.col(x) < F.col("threshold")) if low else (F.col(x) > F.col("threshold")))


def event_paths(series: DataFrame, anchors: DataFrame, x: str, offsets: Sequence[int]) -> DataFrame:
    """(event_id, offset, idx, value): the series at offsets from each event's idx; null where it has no row. Events and offsets are stated sets."""
    marks = anchors.select("event_id", F.col("idx").alias("at"), F.explode(F.array(*(F.lit(k) for k in offsets))).alias("offset"))
    marks = marks.select("event_id", "offset", (F.col("at") + F.col("offset")).cast("int").alias("idx"))
    return F.broadcast(marks).join(series.select(F.col("idx").cast("int").alias("idx"), F.col(x).alias("value")), "idx", "left").select("event_id", "offset", "idx", "value")


def alert_leads(series: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(event_id, n_alerts, lead): alerts in the `window` rows up to each event, and how far before it the first stands."""
    marks = F.broadcast(anchors.select("event_id", F.col("idx").alias("at")))
    near = series.where("alert").join(marks, (F.col("idx") <= F.col("at")) & (F.col("idx") > F.col("at") - window), "right")
    return near.groupBy("event_id").agg(F.count("idx").alias("n_alerts"), F.max(F.col("at") - F.col("idx")).alias("lead"))


def perfect_foresight(outcomes: DataFrame, costs_bps: Sequence[float]) -> DataFrame:
    """(policy, cost_bps, n, n_changes, growth): what knowing the next outcome would have earned, against always and never being invested.

    outcomes: idx, r (the outcome), rf. A change of the weight costs its size.
    """
    policies = F.explode(F.array(*(F.struct(F.lit(name).alias("policy"), w.alias("w")) for name, w in (("always", F.lit(1.0)), ("never", F.lit(0.0)), ("foresight", F.when(F.col("r") > F.col("rf"), 1.0).otherwise(0.0))))))
    rows = outcomes.where("r IS NOT NULL").withColumn("p", policies).select("idx", "r", "rf", "p.*")
    over = Window.partitionBy("policy").orderBy("idx")
    rows = rows.withColumn("turn", F.abs(F.col("w") - F.coalesce(F.lag("w").over(over), F.lit(0.0)))).withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in costs_bps))))
    earned = F.log1p(F.col("w") * F.col("r") + (1 - F.col("w")) * F.col("rf")) + F.log1p(-F.col("cost_bps") / 1e4 * F.col("turn"))
    return rows.groupBy("policy", "cost_bps").agg(F.count("*").alias("n"), F.sum((F.col("turn") > 0).cast("long")).alias("n_changes"), F.sum(earned).alias("log_growth"))


def probability_skill(rows: DataFrame, keys: Sequence[str], p: str, outcome: str) -> DataFrame:
    """(keys, n, brier, reference, skill): squared error of a probability against that of the keys' own mean rate."""
    have = rows.where(F.col(p).isNotNull() & F.col(outcome).isNotNull()).withColumn("o_", F.col(outcome).cast("double"))
    made = have.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(p) - F.col("o_")) ** 2).alias("brier"), (F.avg("o_") * (1 - F.avg("o_"))).alias("reference"))
    return made.withColumn("skill", 1 - F.try_divide("brier", "reference"))


def metric_deltas(metrics: DataFrame, parents: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, treatment, parent, metric, delta): each treatment's metrics less its parent's, in long form. parents: treatment, parent; a stated set."""
    side = lambda of: metrics.select(*keys, F.col("path").alias(of), *(F.col(c).alias(f"{of}_{c}") for c in names))
    met = side("treatment").join(F.broadcast(parents), "treatment").join(side("parent"), [*keys, "parent"])
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(f"treatment_{c}") - F.col(f"parent_{c}")).alias("delta")) for c in names)))
    return met.select(*keys, "treatment", "parent", long.alias("m")).select(*keys, "treatment", "parent", "m.*")


def path_differences(a: DataFrame, b: DataFrame, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, n_only_a, n_only_b, max_difference, is_same) of two paths (keys, idx, nav): the same index, and values within the tolerance.

    Differences are parts of the larger of the two values, so that a path that has grown far is held to no finer than its own digits; two zeros don't differ.
    """
    both = a.select(*keys, "idx", F.col("nav").alias("a")).join(b.select(*keys, "idx", F.col("nav").alias("b")), [*keys, "idx"], "full")
    count = lambda c: F.sum(c.cast("long"))
    made = both.groupBy(*keys).agg(F.count("*").alias("n"), count(F.col("b").isNull()).alias("n_only_a"), count(F.col("a").isNull()).alias("n_only_b"), F.max(F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b")))).alias("max_difference"))
    return made.withColumn("is_same", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance))


def monthly_refits(calendar: DataFrame, horizon: int, least: int) -> DataFrame:
    """(refit, n_mature, train_last): month ends with at least `least` sessions whose outcome `horizon` sessions later is known by then."""
    over = Window.orderBy("idx")
    rows = calendar.withColumn("n_mature", F.greatest(F.col("idx") - F.lit(horizon), F.lit(0))).withColumn("train_last", F.lag("date", horizon).over(over))
    return rows.where(F.col("month_last") & (F.col("n_mature") >= least)).select(F.col("date").alias("refit"), "n_mature", "train_last")
