"""The dense factor database: every signal date, member and registered factor, with a value or the reason why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_factor_database(members: DataFrame, registry: DataFrame, source: DataFrame) -> DataFrame:
    """(signal_date, sid, factor_id, raw_value, score, eligible, missing_reason, rank, percentile) for all members (signal_date, sid) and factors.

    registry is a stated set and goes to all executors. Ranks go by score, then sid; percentile 1 is the best.
    """
    keys = members.select("signal_date", "sid").distinct().crossJoin(F.broadcast(registry.select("factor_id").distinct()))
    rows = keys.join(source.select("signal_date", "sid", "factor_id", "raw_value", "score", "missing_reason", F.lit(True).alias("has_row")), ["signal_date", "sid", "factor_id"], "left")
    eligible = F.col("score").isNotNull()
    reason = F.when(~eligible, F.when(F.col("has_row"), F.coalesce("missing_reason", F.lit("missing_score"))).otherwise("no_source_factor_row"))
    part = Window.partitionBy("signal_date", "factor_id")
    rank = F.row_number().over(part.orderBy(F.col("score").desc_nulls_last(), "sid"))
    out = rows.select("signal_date", "sid", "factor_id", "raw_value", "score", eligible.alias("eligible"), reason.alias("missing_reason"))
    return out.withColumn("rank", F.when(F.col("eligible"), rank)).withColumn("percentile", F.when(F.col("eligible"), 1 - (F.col("rank") - 1.0) / F.count("score").over(part)))


def coverage_summary(database: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """(group columns, total, eligible, missing, rate) for several sets of group columns in one pass; columns not in a set are null."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    sets = [[F.col(c) for c in g] for g in groups]
    eligible = F.sum(F.col("eligible").cast("long"))
    return database.groupingSets(sets, *(F.col(c) for c in columns)).agg(F.count("*").alias("total"), eligible.alias("eligible"), (F.count("*") - eligible).alias("missing"), (eligible / F.count("*")).alias("rate"))


def missing_reason_summary(database: DataFrame) -> DataFrame:
    """(factor_id, missing_reason, n, share_of_rows, share_of_missing)."""
    by = database.groupBy("factor_id", "missing_reason").agg(F.count("*").alias("n"))
    part = Window.partitionBy("factor_id")
    all_rows, missing = F.sum("n").over(part), F.sum(F.when(F.col("missing_reason").isNotNull(), F.col("n"))).over(part)
    return by.select("factor_id", "missing_reason", "n", (F.col("n") / all_rows).alias("share_of_rows"), (F.col("n") / missing).alias("share_of_missing")).where("missing_reason IS NOT NULL")


def faults(database: DataFrame) -> DataFrame:
    """(fault, n): repeated keys, eligible rows without a finite score, others without a reason, ranks that don't follow from the scores."""
    part = Window.partitionBy("signal_date", "factor_id")
    again = F.count(F.lit(1)).over(Window.partitionBy("signal_date", "sid", "factor_id")) > 1
    expected = F.row_number().over(part.orderBy(F.col("score").desc_nulls_last(), "sid"))
    marked = database.withColumns({"repeated": again, "expected": expected})
    kinds = {
        "repeated_key": F.col("repeated"),
        "eligible_without_score": F.col("eligible") & (F.col("score").isNull() | F.isnan("score")),
        "missing_without_reason": ~F.col("eligible") & F.col("missing_reason").isNull(),
        "wrong_rank": F.col("eligible") & (F.col("rank") != F.col("expected")),
    }
    counts = marked.agg(*(F.sum(c.cast("long")).alias(k) for k, c in kinds.items()))
    return counts.unpivot([], list(kinds), "fault", "n")


def different_past(a: DataFrame, b: DataFrame, cutoff: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The keys up to the cutoff at which two databases don't agree, or that one of them hasn't."""
    past = lambda df, k: df.where(F.col("signal_date") <= F.to_date(F.lit(cutoff))).select(*keys, F.struct(*values).alias(k))
    return past(a, "va").join(past(b, "vb"), list(keys), "full").where(~F.col("va").eqNullSafe(F.col("vb"))).select(*keys)


def same_past(a: DataFrame, b: DataFrame, cutoff: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(n_a, n_b, n_different): whether two databases agree on all signal dates up to the cutoff."""
    past = lambda df, k: df.where(F.col("signal_date") <= F.to_date(F.lit(cutoff))).select(*keys, F.struct(*values).alias(k))
    both = past(a, "va").join(past(b, "vb"), list(keys), "full")
    return both.agg(F.count("va").alias("n_a"), F.count("vb").alias("n_b"), F.sum((~F.col("va").eqNullSafe(F.col("vb"))).cast("long")).alias("n_different"))
