"""Forward labels of decisions: excess returns, adverse excursions, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def with_cumulative_cash(market: DataFrame) -> DataFrame:
    """market with cash_before, the log growth of cash over all sessions before."""
    return market.withColumn("cash_before", F.coalesce(F.sum(F.log1p("rf")).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def weekly_decisions(market: DataFrame) -> DataFrame:
    """(signal_date, week, execution_idx) of week ends that have a next session."""
    rows = market.where("week_last AND next_session IS NOT NULL").select(F.col("date").alias("signal_date"), (F.col("idx") + 1).alias("execution_idx"))
    return rows.withColumn("week", F.row_number().over(Window.orderBy("signal_date")))


def horizon_outcomes(market: DataFrame, weeks: int) -> DataFrame:
    """(signal_date, terminal_excess, worst, worst_date, is_negative) from an execution's open to the open `weeks` executions on.

    worst: the least of 0, the log closes on the way and the terminal log return. A window holds the sessions of so many weeks.
    """
    m = with_cumulative_cash(market)
    decisions = weekly_decisions(market)
    decisions = decisions.withColumn("terminal_idx", F.lead("execution_idx", weeks).over(Window.orderBy("week"))).where("terminal_idx IS NOT NULL")
    at = lambda k: F.broadcast(m.select(F.col("idx").alias(f"{k}_idx"), F.log("open").alias(f"{k}_open"), F.col("cash_before").alias(f"{k}_cash")))
    both = decisions.join(at("execution"), "execution_idx").join(at("terminal"), "terminal_idx")
    path = both.join(F.broadcast(m.select("idx", "date", F.log("close").alias("lc"))), (F.col("idx") >= F.col("execution_idx")) & (F.col("idx") < F.col("terminal_idx")))
    terminal = F.col("terminal_open") - F.col("execution_open")
    step = F.col("lc") - F.col("execution_open")
    worst = path.groupBy("signal_date", terminal.alias("terminal"), (terminal - (F.col("terminal_cash") - F.col("execution_cash"))).alias("terminal_excess")).agg(F.min(step).alias("low"), F.min_by("date", F.struct(step, "date")).alias("worst_date"))
    return worst.select("signal_date", "terminal_excess", F.least(F.lit(0.0), "low", "terminal").alias("worst"), "worst_date", (F.col("terminal_excess") < 0).alias("is_negative"))


def adverse_excursions(market: DataFrame, weeks: int = 13) -> DataFrame:
    """(signal_date, mae_log, mae_simple, beyond_5, beyond_10, worst_date): losses as positive numbers, and what is beyond a dead zone."""
    out = horizon_outcomes(market, weeks)
    simple = 1 - F.exp("worst")
    hinge = lambda k: F.greatest(simple - k, F.lit(0.0))
    return out.select("signal_date", (-F.col("worst")).alias("mae_log"), simple.alias("mae_simple"), hinge(0.05).alias("beyond_5"), hinge(0.10).alias("beyond_10"), "worst_date")


def name_targets(spine: DataFrame, market: DataFrame, flag: str = "month_last") -> DataFrame:
    """(signal_date, sid, excess, target_rank): open-to-open return until the next execution less compounded cash, and its share rank in the date."""
    m = with_cumulative_cash(market)
    signals = m.where(F.col(flag) & F.col("next_session").isNotNull()).select(F.col("date").alias("signal_date"), (F.col("idx") + 1).alias("a"))
    signals = signals.withColumn("b", F.lead("a").over(Window.orderBy("signal_date"))).where("b IS NOT NULL")
    cash = m.select("idx", "cash_before")
    signals = signals.join(cash.withColumnsRenamed({"idx": "a", "cash_before": "ca"}), "a").join(cash.withColumnsRenamed({"idx": "b", "cash_before": "cb"}), "b")
    opens = spine.select("sid", "idx", "open")
    first = opens.join(F.broadcast(signals), F.col("idx") == F.col("a")).select("signal_date", "sid", "b", (F.exp(F.col("cb") - F.col("ca")) - 1).alias("cash"), F.col("open").alias("open_a"))
    out = first.join(opens.select("sid", F.col("idx").alias("b"), F.col("open").alias("open_b")), ["sid", "b"])
    out = out.select("signal_date", "sid", (C.simple_return(F.col("open_b"), F.col("open_a")) - F.col("cash")).alias("excess"))
    n = F.count("excess").over(Window.partitionBy("signal_date"))
    return out.withColumn("target_rank", C.average_rank(F.round("excess", 10), ["signal_date"]) / n)


def yearly_folds(decisions: DataFrame, first_year: int, label_weeks: int = 4) -> DataFrame:
    """(outer_year, n_train, train_last, n_test) of walk-forward folds: training rows are those whose labels are mature before the year begins."""
    rows = decisions.withColumn("y", F.year("signal_date"))
    years = rows.select(F.col("y").alias("outer_year")).distinct().where(F.col("outer_year") >= first_year)
    both = rows.withColumn("label_end", F.lead("signal_date", label_weeks).over(Window.orderBy("signal_date"))).crossJoin(F.broadcast(years))  # weeks times years
    train = (F.year("label_end") < F.col("outer_year")) & F.col("label_end").isNotNull()
    return both.groupBy("outer_year").agg(F.sum(train.cast("long")).alias("n_train"), F.max(F.when(train, F.col("signal_date"))).alias("train_last"), F.sum((F.col("y") == F.col("outer_year")).cast("long")).alias("n_test")).where("n_train > 0")


def inner_folds(decisions: DataFrame, block: int = 52, most: int = 5, purge: int = 5) -> DataFrame:
    """(fold, validation_first, validation_last, n_train) of blocks counted back from the last week; `purge` weeks before a block don't train."""
    rows = decisions.select("signal_date", "week")
    last = rows.agg(F.max("week").alias("n"))
    joined = rows.crossJoin(F.broadcast(last)).withColumn("fold", ((F.col("n") - F.col("week")) / block).cast("int"))
    blocks = joined.groupBy("fold").agg(F.min("week").alias("a"), F.min("signal_date").alias("validation_first"), F.max("signal_date").alias("validation_last"), F.count("*").alias("size"))
    return blocks.where((F.col("size") == block) & (F.col("fold") < most)).select("fold", "validation_first", "validation_last", F.greatest(F.col("a") - 1 - purge, F.lit(0)).cast("long").alias("n_train"))


def development_targets(market: DataFrame, lockbox_start: str) -> DataFrame:
    """(signal_date, excess_1w, is_negative, worst_4w, status) of weekly decisions; from the lockbox on outcomes are withheld.

    status: available, censored (not over yet when the data end) or withheld. An outcome that ends in the lockbox is withheld too.
    """
    one = horizon_outcomes(market, 1).select("signal_date", F.col("terminal_excess").alias("excess_1w"), "is_negative")
    four = horizon_outcomes(market, 4).select("signal_date", F.col("worst").alias("worst_4w"))
    rows = weekly_decisions(market).select("signal_date", "week").join(one, "signal_date", "left").join(four, "signal_date", "left")
    start = F.to_date(F.lit(lockbox_start))
    end = F.lead("signal_date", 4).over(Window.orderBy("week"))
    status = F.when(F.col("signal_date") >= start, "withheld").when(F.col("end") >= start, "withheld").when(F.col("excess_1w").isNull() | F.col("worst_4w").isNull(), "censored").otherwise("available")
    out = rows.withColumn("end", end).withColumn("status", status)
    shown = lambda c: F.when(F.col("status") == "available", F.col(c)).alias(c)
    return out.select("signal_date", shown("excess_1w"), shown("is_negative"), shown("worst_4w"), "status")


def contract_faults(features: DataFrame, targets: DataFrame, lockbox_start: str) -> DataFrame:
    """(fault, n): keys in one of the two only, outcomes shown in the lockbox, worst outcomes above 0."""
    start = F.to_date(F.lit(lockbox_start))
    both = features.select("signal_date", F.lit(True).alias("f")).join(targets.withColumn("t", F.lit(True)), "signal_date", "full")
    kinds = {
        "feature_only": F.col("t").isNull(),
        "target_only": F.col("f").isNull(),
        "shown_in_lockbox": (F.col("signal_date") >= start) & (F.col("excess_1w").isNotNull() | F.col("worst_4w").isNotNull()),
        "worst_above_0": F.coalesce(F.col("worst_4w") > 0, F.lit(False)),
    }
    return both.agg(*(F.sum(c.cast("long")).alias(k) for k, c in kinds.items())).unpivot([], list(kinds), "fault", "n")
