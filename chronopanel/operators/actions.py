"""Terminal actions, price policies and fees of held names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import point_in_time as pit


def applied_actions(holdings: DataFrame, actions: DataFrame) -> DataFrame:
    """(idx, sid, shares, cash, action_id) of the holdings (idx, sid, shares) after the actions of their session.

    actions: action_id, apply_idx, source_sid, target_sid, cash_per_share, target_per_share; one for each source. Held
    names without an action pass on; a converted name gives its cash and, where there is a target, the target's shares.
    """
    a = F.broadcast(actions)
    joined = holdings.join(a, (F.col("sid") == F.col("source_sid")) & (F.col("idx") == F.col("apply_idx")), "left")
    converted = F.col("action_id").isNotNull()
    cash = F.when(converted, F.col("shares") * F.coalesce("cash_per_share", F.lit(0.0))).otherwise(0.0)
    shares = F.when(converted, F.col("shares") * F.coalesce("target_per_share", F.lit(0.0))).otherwise(F.col("shares"))
    sid = F.when(converted, F.coalesce("target_sid", F.col("sid"))).otherwise(F.col("sid"))
    rows = joined.select("idx", sid.alias("sid"), shares.alias("shares"), cash.alias("cash"), "action_id")
    return rows.groupBy("idx", "sid").agg(F.sum("shares").alias("shares"), F.sum("cash").alias("cash"), F.min("action_id").alias("action_id"))


def priced(wanted: DataFrame, spine: DataFrame, oldest: int) -> DataFrame:
    """(idx, sid, price, source) for the pairs wanted (idx, sid): the open, else the last close at most `oldest` sessions old, else nothing."""
    over = Window.partitionBy("sid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("close").isNotNull(), F.struct("idx", "close")), True).over(over)
    rows = spine.select("idx", "sid", "open", last.alias("k"))
    joined = wanted.join(rows, ["idx", "sid"], "left")
    is_open, is_carried = F.col("open") > 0, F.col("idx") - F.col("k.idx") <= oldest
    source = F.when(is_open, "open").when(is_carried, "carried").otherwise("none")
    return joined.select("idx", "sid", F.when(is_open, F.col("open")).when(is_carried, F.col("k.close")).alias("price"), source.alias("source"))


def pending(held: DataFrame, actions: DataFrame, ahead: int = 25) -> DataFrame:
    """(idx, sid) of held names with an action of theirs within the next sessions."""
    a = F.broadcast(actions.select("source_sid", "apply_idx"))
    return held.join(a, (F.col("sid") == F.col("source_sid")) & (F.col("apply_idx") > F.col("idx")) & (F.col("apply_idx") <= F.col("idx") + ahead), "left_semi").select("idx", "sid")


def borrow_rates(shorts: DataFrame, by_name: DataFrame, by_date: DataFrame, default: float) -> DataFrame:
    """(date, sid, rate): the rate of the name on the date, else of the date, else the default."""
    joined = shorts.join(by_name.select("date", "sid", F.col("rate").alias("r1")), ["date", "sid"], "left").join(F.broadcast(by_date.select("date", F.col("rate").alias("r2"))), "date", "left")
    return joined.select("date", "sid", F.coalesce("r1", "r2", F.lit(default)).alias("rate"))


def pnl_bridge(nav: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(date, idx, change, cost, market): what a path gained over the day, the part that costs took, and the rest. nav: date, idx, nav."""
    costs = rebalances.select(F.col("execution_idx").alias("idx"), (F.col("pretrade_nav") * F.col("cost_share")).alias("cost"))
    rows = nav.withColumn("change", F.col("nav") - F.coalesce(F.lag("nav").over(Window.orderBy("idx")), F.lit(1.0))).join(F.broadcast(costs), "idx", "left")
    cost = -F.coalesce("cost", F.lit(0.0))
    return rows.select("date", "idx", "change", cost.alias("cost"), (F.col("change") - cost).alias("market"))


def session_faults(actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Actions (action_id, apply_session) within the calendar's range whose day is no session."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    inside = actions.crossJoin(F.broadcast(span)).where(F.col("apply_session").between(F.col("a"), F.col("b"))).drop("a", "b")
    return inside.join(F.broadcast(calendar.select(F.col("date").alias("apply_session"))), "apply_session", "left_anti")


def skip_evidence(gaps: DataFrame, actions: DataFrame, spine: DataFrame, ahead: int = 25) -> DataFrame:
    """(sid, idx, action_idx, evidence, last_open_idx, resumed_idx, is_explained) of names without an open at a rebalance.

    gaps: sid, idx. actions: source_sid, apply_idx. evidence: same_open, pending_action (the nearest one within the next
    `ahead` sessions) or none. A gap is explained if it has evidence and the name's opens resume. Each question is an
    as-of join, one backward and two forward (on the negated session), in buckets of sessions, so that no name's history is one task.
    """
    width = 64
    forward = gaps.select("sid", "idx", (-F.col("idx")).alias("back"))
    applied = actions.select(F.col("source_sid").alias("sid"), (-F.col("apply_idx")).alias("back"), F.col("apply_idx").alias("action_idx"))
    found = pit.asof_backward(forward, applied, ["sid"], "back", ["action_idx"], F.floor(F.col("back") / width))
    opens = spine.where(F.col("open") > 0).select("sid", F.col("idx").alias("open_idx"))
    later = opens.select("sid", (-F.col("open_idx")).alias("back"), F.col("open_idx").alias("resumed_idx"))
    found = pit.asof_backward(found.drop("matched_at"), later, ["sid"], "back", ["resumed_idx"], F.floor(F.col("back") / width), inclusive=False)
    earlier = opens.select("sid", F.col("open_idx").alias("idx"), F.col("open_idx").alias("last_open_idx"))
    found = pit.asof_backward(found.drop("matched_at"), earlier, ["sid"], "idx", ["last_open_idx"], F.floor(F.col("idx") / width), inclusive=False)
    near = F.when(F.col("action_idx") <= F.col("idx") + ahead, F.col("action_idx"))
    evidence = F.when(near == F.col("idx"), "same_open").when(near.isNotNull(), "pending_action").otherwise("none")
    return found.select("sid", "idx", near.alias("action_idx"), evidence.alias("evidence"), "last_open_idx", "resumed_idx", ((evidence != "none") & F.col("resumed_idx").isNotNull()).alias("is_explained"))
