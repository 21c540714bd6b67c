"""Repair of names: donors of history, exits, terminal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.sources import store


def best_donors(candidates: DataFrame, spine: DataFrame, least: int = 60) -> DataFrame:
    """(sid, donor, priority, n_valid): of the candidates (sid, donor, priority) the first by priority with enough closes; both given if none has."""
    valid = spine.groupBy(F.col("sid").alias("donor")).agg(F.count("close").alias("n_valid"))
    joined = candidates.join(valid, "donor").where(F.col("n_valid") >= least)
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("sid").orderBy("priority", "donor"))).where("place = 1").select("sid", "donor", "priority", "n_valid")


def nearest_donors(names: DataFrame, spine: DataFrame, least: int = 60) -> DataFrame:
    """(sid, donor, priority): of names (sid, number, both unique) the nearest on either side by number with enough closes; priority is the distance. Names are a stated set."""
    valid = spine.groupBy("sid").agg((F.count("close") >= least).alias("is_valid"))
    over = Window.orderBy("number")
    mark = F.when(F.col("is_valid"), F.struct(F.col("sid").alias("donor"), "number"))
    rows = names.join(valid, "sid").withColumn("mark", mark)
    near = F.array(F.last("mark", True).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.first("mark", True).over(over.rowsBetween(1, Window.unboundedFollowing)))
    pairs = rows.withColumn("near", near).select("sid", "number", F.explode("near").alias("d")).where("d IS NOT NULL")
    return pairs.select("sid", "d.donor", F.abs(F.col("number") - F.col("d.number")).alias("priority"))


def remapped(rows: DataFrame, mapping: DataFrame, column: str = "sid") -> DataFrame:
    """rows with the column's sids replaced by mapping (source_sid, canonical_sid), others as they are."""
    m = mapping.select(F.col("source_sid").alias("from_"), F.col("canonical_sid").alias("to_"))
    out = rows.join(F.broadcast(m), rows[column] == F.col("from_"), "left")
    return out.select(*(F.coalesce("to_", F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns))


def exits(intervals: DataFrame, spine: DataFrame, actions: DataFrame, ahead: int = 5) -> DataFrame:
    """(sid, exit_idx, n_opens_ahead, status) of names whose membership ends: they go on trading, have an action, or are gone.

    intervals: sid, exit_idx. actions: sid.
    """
    window = spine.join(F.broadcast(intervals), "sid").where((F.col("idx") >= F.col("exit_idx")) & (F.col("idx") < F.col("exit_idx") + ahead))
    opens = window.groupBy("sid", "exit_idx").agg(F.count("open").alias("n"))
    joined = intervals.join(opens, ["sid", "exit_idx"], "left").join(F.broadcast(actions.select("sid").distinct().withColumn("has_action", F.lit(True))), "sid", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == ahead, "continues").when(F.col("has_action"), "action").otherwise("unavailable")
    return joined.select("sid", "exit_idx", n.alias("n_opens_ahead"), status.alias("status"))


def liquidations(exits_: DataFrame, spine: DataFrame, oldest: int = 5) -> DataFrame:
    """(sid, exit_idx, price, age): the last close before the exit, at most `oldest` sessions old; null beyond."""
    before = spine.where("close IS NOT NULL").select("sid", "idx", "close").join(F.broadcast(exits_.select("sid", "exit_idx")), "sid").where("idx < exit_idx")
    last = before.groupBy("sid", "exit_idx").agg(F.max_by("close", "idx").alias("close"), (F.col("exit_idx") - F.max("idx")).alias("age"))
    return exits_.select("sid", "exit_idx").join(last, ["sid", "exit_idx"], "left").select("sid", "exit_idx", F.when(F.col("age") <= oldest, F.col("close")).alias("price"), "age")


def gap_returns(spine: DataFrame, least_gap: int = 2) -> DataFrame:
    """(sid, idx, gap, gap_return) across runs without a close: from the last close before to the first after."""
    over = Window.partitionBy("sid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("close").isNotNull(), F.struct("idx", "close")), True).over(over)
    rows = spine.withColumn("k", known).where("close IS NOT NULL AND k IS NOT NULL").withColumn("gap", F.col("idx") - F.col("k.idx"))
    return rows.where(F.col("gap") >= least_gap).select("sid", "idx", "gap", F.try_divide("close", "k.close").alias("ratio")).select("sid", "idx", "gap", (F.col("ratio") - 1).alias("gap_return"))


def identities(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source_sid, canonical_sid, status): the override's sid, or the source's own."""
    met = sources.join(overrides.select("source_sid", F.col("canonical_sid").alias("fixed")), "source_sid", "left")
    return met.select("source_sid", F.coalesce("fixed", "source_sid").alias("canonical_sid"), F.when(F.col("fixed").isNotNull(), "override").otherwise("own").alias("status"))


def ordered_donors(pairs: DataFrame) -> DataFrame:
    """(sid, donors): the few donors of each name in order of priority, joined by bars."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("priority", "donor"))), lambda x: x["donor"])
    return pairs.groupBy("sid").agg(F.array_join(ordered, "|").alias("donors"))


def chained_conversions(edges: DataFrame) -> DataFrame:
    """(source, final, ratio, steps, status) of names that are converted into others, which may be converted in turn.

    edges: source, target, ratio. Pointers double: each round a name's way goes on by the way of the name that it has reached, so
    that a chain of any length takes rounds by its logarithm. status: chain; cycle for names that come back to
    themselves, into_cycle for those that lead there (neither has a final name); ambiguous for sources of several edges,
    where ways end.
    """
    own = edges.groupBy("source").agg(F.count("*").alias("n"), F.max("target").alias("target"), F.max("ratio").alias("ratio"))
    own = store.materialized(own)
    ambiguous = own.where("n > 1").select("source", F.lit(None).cast(own.schema["source"].dataType).alias("final"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("int").alias("steps"), F.lit("ambiguous").alias("status"))
    way = own.where("n = 1").select("source", F.col("target").alias("at"), F.col("ratio").cast("double").alias("ratio"), F.lit(1).alias("steps"))
    n, rounds = way.count(), 0
    while True:
        on = way.select(F.col("source").alias("from_"), F.col("at").alias("on_at"), F.col("ratio").alias("on_ratio"), F.col("steps").alias("on_steps"))
        met = way.join(on, F.col("at") == F.col("from_"), "left")
        goes = F.col("from_").isNotNull()
        way = store.materialized(met.select("source", F.coalesce("on_at", "at").alias("at"), F.when(goes, F.col("ratio") * F.col("on_ratio")).otherwise(F.col("ratio")).alias("ratio"), F.when(goes, F.col("steps") + F.col("on_steps")).otherwise(F.col("steps")).alias("steps"), goes.alias("goes")))
        rounds += 1
        if way.where("goes").isEmpty() or 2**rounds > n:
            break
        way = way.drop("goes")
    ends = own.where("n = 1").select(F.col("source").alias("known_"))
    endless = way.join(ends, F.col("at") == F.col("known_"), "left")
    circles = endless.where("known_ IS NOT NULL").select(F.col("at").alias("circle_")).distinct()
    status = F.when(F.col("known_").isNull(), "chain").when(F.col("circle_").isNotNull(), "cycle").otherwise("into_cycle")
    chained = endless.join(circles, F.col("source") == F.col("circle_"), "left").withColumn("status", status)
    is_chain = F.col("status") == "chain"
    return chained.select("source", *(F.when(is_chain, F.col(c)).alias(to) for c, to in (("at", "final"), ("ratio", "ratio"), ("steps", "steps"))), "status").unionByName(ambiguous)
