"""Comparison of paths, decomposition of overlays, gates and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scheduled_targets(schedule: DataFrame, members: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """(signal_date, execution_date, sid, weight, is_short) of the n best members by score, ties by sid; is_short where there are fewer than n."""
    have = scores.where("score IS NOT NULL").join(members.select(F.col("date").alias("signal_date"), "sid"), ["signal_date", "sid"])
    part = Window.partitionBy("signal_date")
    ranked = have.withColumn("rank", F.row_number().over(part.orderBy(F.col("score").desc(), "sid"))).withColumn("n_have", F.count(F.lit(1)).over(part))
    chosen = ranked.where(F.col("rank") <= n).select("signal_date", "sid", (F.lit(1.0) / F.least(F.lit(n), "n_have")).alias("weight"), (F.col("n_have") < n).alias("is_short"))
    return F.broadcast(schedule).join(chosen, "signal_date").select("signal_date", "execution_date", "sid", "weight", "is_short")


def target_faults(targets: DataFrame, members: DataFrame) -> DataFrame:
    """(signal_date, sid, fault) of weights that are not finite, repeated, or of names that are no members."""
    again = F.count(F.lit(1)).over(Window.partitionBy("signal_date", "sid")) > 1
    joined = targets.withColumn("again", again).join(members.select(F.col("date").alias("signal_date"), "sid", F.lit(True).alias("is_member")), ["signal_date", "sid"], "left")
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))
    fault = F.when(bad, "not_finite").when(F.col("again"), "repeated").when(F.col("is_member").isNull(), "not_a_member")
    return joined.select("signal_date", "sid", fault.alias("fault")).where("fault IS NOT NULL")


def side_by_side(summary: DataFrame, path: str, paths: Sequence[str], metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row for each key with a column path_metric for each, and the differences of the first path from the second."""
    wide = summary.groupBy(*keys).pivot(path, list(paths)).agg(*(F.first(m).alias(m) for m in metrics))
    if len(metrics) == 1:
        wide = wide.select(*keys, *(F.col(p).alias(f"{p}_{metrics[0]}") for p in paths))
    a, b = paths[0], paths[1]
    return wide.select("*", *((F.col(f"{a}_{m}") - F.col(f"{b}_{m}")).alias(f"delta_{m}") for m in metrics))


def overlay_decomposition(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, defence_benefit, missed_upside, net, mean_exposure) of holding `exposure` of r: losses avoided and gains forgone by the part not held."""
    out = (1 - F.col("exposure")) * F.col("r")
    return returns.where("r IS NOT NULL AND exposure IS NOT NULL").groupBy(*keys).agg(F.sum(F.greatest(-out, F.lit(0.0))).alias("defence_benefit"), F.sum(F.greatest(out, F.lit(0.0))).alias("missed_upside"), F.sum(-out).alias("net"), F.avg("exposure").alias("mean_exposure"))


def relative_path(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, idx, log_ratio, change) of two paths (date, idx, nav); the first change is the level."""
    both = a.select("date", "idx", F.col("nav").alias("a")).join(b.select("idx", F.col("nav").alias("b")), "idx")
    rows = both.select("date", "idx", (F.log("a") - F.log("b")).alias("log_ratio"))
    return rows.withColumn("change", F.col("log_ratio") - F.coalesce(F.lag("log_ratio").over(Window.orderBy("idx")), F.lit(0.0)))


def worst_relative_fall(path: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode, worst): the deepest fall of a log ratio from its running top, within each episode (episode, first, last). Episodes are a ledger."""
    inside = path.join(F.broadcast(episodes), F.col("date").between(F.col("first"), F.col("last")))
    top = F.max("log_ratio").over(Window.partitionBy("episode").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return inside.select("episode", (F.col("log_ratio") - top).alias("fall")).groupBy("episode").agg(F.expm1(F.min("fall")).alias("worst"))


def year_concentration(rows: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, total, largest_share): share of the year that gives most of the sum of x."""
    years = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.year("date").alias("y")).agg(F.sum(x).alias("s"))
    return years.groupBy(*keys).agg(F.sum("s").alias("total"), F.try_divide(F.max(F.abs("s")), F.sum(F.abs("s"))).alias("largest_share"))


def loss_concentration(rows: DataFrame, x: str, share: float) -> DataFrame:
    """(n, n_worst, share_of_losses): of the worst rows, how much of all losses they hold."""
    losses = rows.where(F.col(x) < 0)
    everything = Window.partitionBy()
    n = F.count(F.lit(1)).over(everything)
    marked = losses.select(F.col(x).alias("x"), (F.row_number().over(Window.orderBy(x, "idx")) <= F.ceil(share * n)).alias("is_worst"))
    return marked.agg(F.count("*").alias("n"), F.sum(F.col("is_worst").cast("long")).alias("n_worst"), (F.sum(F.when(F.col("is_worst"), F.col("x"))) / F.sum("x")).alias("share_of_losses"))


def threshold_sensitivity(rows: DataFrame, score: str, outcome: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, n_alerts, hit_rate, base_rate) for several thresholds in one pass."""
    have = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    spread = have.select(score, outcome, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    y = F.col(outcome).cast("double")
    alert = F.col(score) > F.col("threshold")
    return spread.groupBy("threshold").agg(F.sum(alert.cast("long")).alias("n_alerts"), F.avg(F.when(alert, y)).alias("hit_rate"), F.avg(y).alias("base_rate"))


def gates(metrics: DataFrame, rules: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, gate, passes) long, and nothing where a metric is null counts as passed. rules: gate -> SQL condition over the metrics."""
    marked = metrics.select(*keys, *(F.coalesce(F.expr(c), F.lit(False)).alias(g) for g, c in rules.items()))
    return marked.unpivot(list(keys), list(rules), "gate", "passes")


def without_overlap(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode, rows) pairs left for each episode left out: rows (first, last) that don't touch it. Episodes are a ledger; sums of rows follow per episode."""
    e = F.broadcast(episodes.withColumnsRenamed({"first": "e_first", "last": "e_last"}))
    return rows.join(e, (F.col("last") < F.col("e_first")) | (F.col("first") > F.col("e_last")))


def one_standard_error(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The simplest candidate (name, loss, error, capacity) whose loss is within one error of the best, per key."""
    part = Window.partitionBy(*keys)
    best = F.min(F.struct("loss", "error")).over(part)
    near = candidates.withColumn("b", best).where(F.col("loss") <= F.col("b.loss") + F.col("b.error"))
    return near.withColumn("place", F.row_number().over(part.orderBy("capacity", "loss", "name"))).where("place = 1").select(*keys, "name", "loss", "capacity")
