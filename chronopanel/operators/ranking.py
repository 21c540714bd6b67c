"""Ranking, selection and weights of one cross-section at a time; ties go by sid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def rank_and_select(scores: DataFrame, n: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    """scores (keys, sid, score) with rank, selected and exclusion_reason; rows without a score rank null."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), "sid")
    rank = F.when(F.col("score").isNotNull(), F.row_number().over(order))
    return scores.withColumn("rank", rank).withColumn("selected", F.coalesce(F.col("rank") <= n, F.lit(False))).withColumn("exclusion_reason", F.when(F.col("score").isNull(), F.lit("missing_score")))


def winner_loser_weights(scores: DataFrame, n: int, gross: float = 1.0, keys: Sequence[str] = ("date",)) -> DataFrame:
    """(keys, sid, weight): gross / 2n on the n best, the negative on the n worst; none where there are fewer than 2n."""
    have = scores.where("score IS NOT NULL")
    part = Window.partitionBy(*keys)
    best = F.row_number().over(part.orderBy(F.col("score").desc(), "sid"))
    worst = F.row_number().over(part.orderBy(F.col("score"), "sid"))
    ranked = have.select(*keys, "sid", best.alias("best"), worst.alias("worst"), F.count(F.lit(1)).over(part).alias("n"))
    each = gross / (2 * n)
    weight = F.when(F.col("best") <= n, each).when(F.col("worst") <= n, -each)
    return ranked.where(F.col("n") >= 2 * n).select(*keys, "sid", weight.alias("weight")).where("weight IS NOT NULL")


def equal_weights(rows: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    return rows.select(*keys, "sid", (1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys))).alias("weight"))


def ranking_rows(scores: DataFrame, n: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    """(keys, selected_count, unique_sids, is_monotone) of the n best."""
    top = rank_and_select(scores, n, keys).where("selected")
    falls = F.coalesce(F.lag("score").over(Window.partitionBy(*keys).orderBy("rank")) >= F.col("score"), F.lit(True))
    return top.withColumn("falls", falls).groupBy(*keys).agg(F.count("*").alias("selected_count"), F.countDistinct("sid").alias("unique_sids"), F.min("falls").alias("is_monotone"))


def date_metadata(scores: DataFrame, n: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    """(keys, eligible_count, tied_at_cut, top_sids): how many tie with the n-th score, and the n best joined by |."""
    ranked = rank_and_select(scores, n, keys).where("score IS NOT NULL")
    part = Window.partitionBy(*keys)
    cut = F.max(F.when(F.col("rank") == n, F.col("score"))).over(part)
    marked = ranked.withColumn("at_cut", F.coalesce(F.col("score") == cut, F.lit(False)))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("selected"), F.struct("rank", "sid")))), lambda x: x["sid"]), "|")
    return marked.groupBy(*keys).agg(F.count("*").alias("eligible_count"), F.sum(F.col("at_cut").cast("long")).alias("tied_at_cut"), top.alias("top_sids"))


def _named(frame: DataFrame, n: int | None, keys: Sequence[str]) -> DataFrame:
    return frame.where("label IS NOT NULL") if n is None else rank_and_select(frame, n, keys).where("selected")


def period_ledger(labelled: DataFrame, n: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, n_names, gross_return, turnover) of an equal-weight book of the n best, or of all names.

    labelled: keys, date, sid, score, label (the return until the next date; null counts 0). Turnover is the sum of
    absolute changes from the weights as they drifted.
    """
    keys = list(keys)
    book = _named(labelled, n, [*keys, "date"]).withColumn("r", F.coalesce("label", F.lit(0.0)))
    part = Window.partitionBy(*keys, "date")
    book = book.select(*keys, "date", "sid", "r", (1.0 / F.count(F.lit(1)).over(part)).alias("w"))
    total = book.groupBy(*keys, "date").agg(F.count("*").alias("n_names"), F.sum(F.col("w") * F.col("r")).alias("gross_return"))
    follow = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    dates = total.withColumn("next_date", F.lead("date").over(follow))
    drifted = book.join(dates, [*keys, "date"]).where("next_date IS NOT NULL")
    drifted = drifted.select(*keys, F.col("next_date").alias("date"), "sid", (F.col("w") * (1 + F.col("r")) / (1 + F.col("gross_return"))).alias("was"))
    moved = book.join(drifted, [*keys, "date", "sid"], "full").groupBy(*keys, "date").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))
    return total.join(moved, [*keys, "date"])


def switched_scores(calm: DataFrame, rough: DataFrame, states: DataFrame) -> DataFrame:
    """Scores of `rough` on dates with high volatility, of `calm` on others; states: date, is_high."""
    return calm.select("date", "sid", F.col("score").alias("a")).join(rough.select("date", "sid", F.col("score").alias("b")), ["date", "sid"], "full").join(F.broadcast(states.select("date", "is_high")), "date").select("date", "sid", F.when(F.col("is_high"), F.col("b")).otherwise(F.col("a")).alias("score"))


def pair_similarity(scores: DataFrame, n: int) -> DataFrame:
    """(a, b, median_correlation, median_overlap, n_dates) of pairs of factors: rank correlation of scores and Jaccard overlap of the n best, by date.

    Pairs are of factors, a registered set; names are never paired.
    """
    ranked = rank_and_select(scores.where("score IS NOT NULL"), n, ["factor_id", "date"])
    ranked = ranked.withColumn("r", C.average_rank(F.col("score"), ["factor_id", "date"]))
    mine = lambda k: ranked.select(F.col("factor_id").alias(k), "date", "sid", F.col("r").alias(f"r_{k}"), F.col("selected").alias(f"s_{k}"))
    both = mine("a").join(mine("b"), ["date", "sid"]).where("a < b")
    either = F.sum((F.col("s_a") | F.col("s_b")).cast("int"))
    daily = both.groupBy("a", "b", "date").agg(C.finite(F.corr("r_a", "r_b")).alias("c"), F.try_divide(F.sum((F.col("s_a") & F.col("s_b")).cast("int")), either).alias("j"))
    return daily.groupBy("a", "b").agg(F.percentile("c", 0.5).alias("median_correlation"), F.percentile("j", 0.5).alias("median_overlap"), F.count("*").alias("n_dates"))


def is_nested(holdings: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("date",)) -> DataFrame:
    """(keys, is_nested): whether the best of each size are all among those of the next, with exact sizes."""
    marks = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) == k for k in sizes]
    whole: Column = marks[0]
    for m in marks[1:]:
        whole = whole & m
    return holdings.groupBy(*keys).agg(whole.alias("is_nested"))
