"""Exact ranks and quantiles of any number of rows, in ranges of a sort.

Values are counted first (equal values of one task become one row), the counts are range-sorted and written with the
range they fall in, and what lies before a range is carried over to it: one row for each range and key. No task has all rows of a
key, and none sorts what another has. A value that stands in any share of the rows is one row of counts.

Nulls and NaN are no values: they have no rank and count in no quantile.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C
from chronopanel.sources import store


def counted_values(rows: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n, before, total): each value, how often it stands, how many lesser ones there are, and how many in all."""
    x = F.col(value) if isinstance(value, str) else value
    have = rows.select(*keys, x.alias("value")).where(F.col("value").isNotNull())
    if dict(have.dtypes)["value"] in ("double", "float"):
        have = have.where(~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))
    counts = have.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    dealt = store.materialized(counts.repartitionByRange(*keys, "value").withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "range_").agg(F.sum("n").alias("here_"))
    family = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("here_").over(family.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sizes.select(*(F.col(k).alias(f"of_{k}_") for k in keys), F.col("range_").alias("of_range_"), earlier.alias("earlier_"), F.sum("here_").over(family).alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}_")) for k in keys] + [F.col("range_") == F.col("of_range_")]
    local = F.sum("n").over(Window.partitionBy(*keys, "range_").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = dealt.withColumn("local_", local).join(carried, same)
    return placed.select(*keys, "value", "n", (F.col("local_") + F.col("earlier_")).alias("before"), "total")


def quantiles(rows: DataFrame, values: Sequence[str], probabilities: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, {value}_{name} ...): for each value column its quantiles, between two neighbours by their distance. A column without values has none.

    probabilities: a name for each. All columns are counted in one pass, as (column, value).
    """
    x = F.explode(F.array(*(F.struct(F.lit(v).alias("column_"), F.col(v).cast("double").alias("value_")) for v in values))).alias("x")
    long = rows.select(*keys, x).select(*keys, "x.column_", "x.value_")
    spots = counted_values(long, "value_", [*keys, "column_"])
    made = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("total") - 1)
        pick = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        share = F.max(at - F.floor(at))
        made.append((low + (high - low) * share).alias(name))
    per_column = spots.groupBy(*keys, "column_").agg(*made)
    wide = [F.max(F.when(F.col("column_") == v, F.col(n))).alias(f"{v}_{n}") for v in values for n in probabilities]
    return per_column.groupBy(*keys).agg(*wide)


def with_average_rank(rows: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the rank of a value within the keys, from 1, ties at their mean; null where there is no value.

    Each row meets the one row of its value's counts; a value that many rows share is split by the engine's skew join, as the counts' side has one row for it.
    """
    spots = counted_values(rows, value, keys)
    spots = spots.select(*(F.col(k).alias(f"of_{k}_") for k in keys), F.col("value").alias("of_value_"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}_")) for k in keys] + [F.col(value) == F.col("of_value_")]
    return rows.join(spots, same, "left").select(*rows.columns, name)


def with_place(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """rows with place (from 0) in ascending order within the keys, and total: how many there are. The order must be of distinct rows."""
    dealt = store.materialized(rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "range_").agg(F.count("*").alias("here_"))
    family = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("here_").over(family.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sizes.select(*(F.col(k).alias(f"of_{k}_") for k in keys), F.col("range_").alias("of_range_"), earlier.alias("earlier_"), F.sum("here_").over(family).alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}_")) for k in keys] + [F.col("range_") == F.col("of_range_")]
    local = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(*order)) - 1
    placed = dealt.withColumn("local_", local).join(carried, same)
    return placed.select(*rows.columns, (F.col("local_") + F.col("earlier_")).alias("place"), "total")


def with_tile(rows: DataFrame, order: Sequence[str], n: int, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the number, from 1, of the n parts of nearly one size in which they lie by order; the first parts are larger by one where it doesn't come out even."""
    place, total = F.col("place"), F.col("total")
    small, more = F.floor(total / n), total % n
    tile = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return with_place(rows, order, keys).withColumn(name, (tile + 1).cast("int")).select(*rows.columns, name)


def spearman(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, spearman): correlation of the average ranks of the rows that have both; null without variance."""
    have = rows.select(*keys, F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_")).where("a_ IS NOT NULL AND b_ IS NOT NULL AND NOT isnan(a_) AND NOT isnan(b_)")
    ranked = with_average_rank(with_average_rank(have, "a_", "ra_", keys), "b_", "rb_", keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), C.finite(F.corr("ra_", "rb_")).alias("spearman"))


def pairwise_spearman(long: DataFrame, item: str, value: str, keys: Sequence[str], least: int) -> DataFrame:
    """(a, b, n, spearman) for each two items, over the keys at which both have a value; null with fewer than `least` of them.

    Ranks are taken anew among the rows of each pair. Items are a stated set, so the pairs of a key are as many as its items allow.
    """
    have = long.where(F.col(value).isNotNull()).select(*keys, F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v")).alias("x"))
    lists = have.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    pairs = lists.select(F.posexplode("x").alias("p", "s"), "x").select("s", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("t"))
    made = pairs.select(F.col("s.i").alias("a"), F.col("t.i").alias("b"), F.col("s.v").alias("x"), F.col("t.v").alias("y"))
    out = spearman(made, "x", "y", ["a", "b"])
    return out.withColumn("spearman", F.when(F.col("n") >= least, F.col("spearman")))


def area_under_curve(rows: DataFrame, score: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, n_positive, auc) from the counts of each score among positives and negatives: no row is ranked by itself."""
    have = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    all_ = counted_values(have, score, keys)
    positive = have.where(F.col(outcome).cast("int") == 1).select(*keys, (F.col(score).cast("double") + F.lit(0.0)).alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n_1"))
    of = positive.select(*(F.col(k).alias(f"of_{k}_") for k in keys), F.col("value").alias("of_value_"), "n_1")
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"of_{k}_")) for k in keys] + [F.col("value") == F.col("of_value_")])
    met = all_.join(of, same, "left").withColumn("n_1", F.coalesce("n_1", F.lit(0)))
    n1, n = F.sum("n_1"), F.sum("n")
    return met.groupBy(*keys).agg(n.alias("n"), n1.alias("n_positive"), F.try_divide(F.sum(F.col("n_1") * (F.col("before") + (F.col("n") + 1) / 2.0)) - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))
