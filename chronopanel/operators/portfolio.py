"""Portfolio values without a day-by-day loop.

Between rebalances a book's value is a sum over its names, so each holding period is a join and a sum; at a rebalance
the value so far, the turnover and the cost are known from that sum, and the values at the rebalances follow as one
running product. Costs scale a path: any cost scenario is the path without costs times a running product.

What only an ordered pass can say (automata with non-disjoint conditions) folds over the ordered rows of one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import columns as C


def _with_period(days: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """days (keys, idx, ...) with r, the path's last rebalance at or before each session, and next_r."""
    marks = targets.select(*keys, F.col("execution_idx").alias("r")).distinct()
    marks = marks.withColumn("next_r", F.lead("r").over(Window.partitionBy(*keys).orderBy("r"))).withColumn("idx", F.col("r"))
    joined = days.join(F.broadcast(marks), [*keys, "idx"], "left")
    over = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("p", F.last(F.when(F.col("r").isNotNull(), F.struct("r", "next_r")), True).over(over)).select(*days.columns, "p.r", "p.next_r").where("r IS NOT NULL")


def book_values(targets: DataFrame, spine: DataFrame, market: DataFrame, cost_bps: float = 0.0, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """nav (keys, date, idx, nav) and rebalances (keys, execution_idx, turnover, pretrade_nav, cost_share) of one book for each key.

    targets: keys, execution_idx, sid, weight; names without an open at the execution stay cash. spine: sid, idx, open,
    close; a name without a price is worth its last one. market: date, idx, rf. Paths are a registered grid: the calendar
    is repeated for each, the panel isn't.
    """
    keys = list(keys)
    name, period = [*keys, "sid", "r"], [*keys, "r"]
    cash = F.sum(F.log1p("rf")).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    days = market.select("date", "idx", cash.alias("cash"))
    days = days.withColumn("cash_before", F.coalesce(F.lag("cash").over(Window.orderBy("idx")), F.lit(0.0)))
    if keys:
        days = days.crossJoin(F.broadcast(targets.select(*keys).distinct()))
    days = _with_period(days, targets, keys)
    opens = spine.select("sid", F.col("idx").alias("execution_idx"), F.col("open").alias("bought"))
    held = targets.join(opens, ["sid", "execution_idx"]).where("bought > 0").select(*keys, "sid", F.col("execution_idx").alias("r"), "weight", "bought")
    lasts = days.groupBy(*period).agg(F.max("idx").alias("until"))
    sessions = held.join(lasts, period).withColumn("idx", F.explode(F.sequence("r", "until"))).drop("until")
    marked = sessions.join(spine.select("sid", "idx", "open", "close"), ["sid", "idx"])
    in_period = Window.partitionBy(*name).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("weight") * F.coalesce(F.last("close", True).over(in_period), F.col("bought")) / F.col("bought")
    daily = marked.withColumn("value", value)
    start = days.where("idx = r").select(*period, "next_r", F.col("cash_before").alias("cash_start"))
    invested = held.groupBy(*period).agg(F.sum("weight").alias("s"))
    periods = start.join(invested, period, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    # what each name is worth when the next rebalance opens
    last = daily.groupBy(*name).agg(F.max_by("value", "idx").alias("last_value"), F.max("weight").alias("weight"), F.max("bought").alias("bought"))
    ends = last.join(periods.select(*period, "next_r"), period).where("next_r IS NOT NULL")
    ends = ends.join(spine.select("sid", F.col("idx").alias("next_r"), F.col("open").alias("sold")), ["sid", "next_r"], "left")
    ends = ends.select(*name, "next_r", F.when(F.col("sold") > 0, F.col("weight") * F.col("sold") / F.col("bought")).otherwise(F.col("last_value")).alias("g"))
    cash_end = days.select(*keys, F.col("idx").alias("next_r"), F.col("cash_before").alias("cash_end"))
    totals = periods.where("next_r IS NOT NULL").join(cash_end, [*keys, "next_r"]).join(ends.groupBy(*period).agg(F.sum("g").alias("sum_g")), period, "left")
    totals = totals.select(*period, "next_r", (F.coalesce("sum_g", F.lit(0.0)) + (1 - F.col("s")) * F.exp(F.col("cash_end") - F.col("cash_start"))).alias("total"))
    drifted = ends.join(totals.select(*period, "total"), period).select(*keys, "sid", F.col("next_r").alias("r"), (F.col("g") / F.col("total")).alias("was"))
    moved = held.select(*name, "weight").join(drifted, name, "full")
    turnover = moved.groupBy(*period).agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))
    steps = periods.select(*period).join(turnover, period, "left").join(totals.select(*keys, F.col("next_r").alias("r"), "total"), period, "left")
    steps = steps.select(*period, F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("total", F.lit(1.0)).alias("total"))
    share = cost_bps / 1e4 * F.col("turnover")
    over = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("base", F.exp(F.sum(F.log("total") + F.log1p(-share)).over(over)))
    worth = daily.groupBy(*keys, "idx").agg(F.sum("value").alias("worth"))
    nav = days.join(worth, [*keys, "idx"], "left").join(periods.select(*period, "s", "cash_start"), period).join(steps.select(*period, "base"), period)
    nav = nav.select(*keys, "date", "idx", (F.col("base") * (F.coalesce("worth", F.lit(0.0)) + (1 - F.col("s")) * F.exp(F.col("cash") - F.col("cash_start")))).alias("nav"))
    return nav, steps.select(*keys, F.col("r").alias("execution_idx"), "turnover", (F.col("base") / (1 - share)).alias("pretrade_nav"), share.alias("cost_share"))


def replay_linear_cost(nav: DataFrame, rebalances: DataFrame, costs_bps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cost_bps, date, idx, nav) for each cost from a path without costs: nav times the running product of 1 - cost * turnover."""
    costs = F.explode(F.array(*(F.lit(float(c)) for c in costs_bps)))
    marks = rebalances.select(*keys, F.col("execution_idx").alias("idx"), "turnover")
    joined = nav.join(F.broadcast(marks), [*keys, "idx"], "left").withColumn("cost_bps", costs)
    over = Window.partitionBy(*keys, "cost_bps").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.exp(F.sum(F.log1p(-F.col("cost_bps") / 1e4 * F.coalesce("turnover", F.lit(0.0)))).over(over))
    return joined.select(*keys, "cost_bps", "date", "idx", (F.col("nav") * kept).alias("nav"))


def drawdown_episodes(nav: DataFrame, value: str = "nav", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, peak_date, trough_date, recovery_date, depth, decline, recovery, first_5, first_10): falls below a running peak until it is reached again.

    nav: keys, date, idx, value. decline and recovery are in sessions; recovery_date is null while it lasts.
    """
    over = Window.partitionBy(*keys).orderBy("idx")
    rows = nav.withColumn("peak", F.max(value).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("is_peak", (F.col(value) >= F.col("peak")).cast("int"))
    rows = rows.withColumn("island", F.sum("is_peak").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("dd", F.col(value) / F.col("peak") - 1)
    starts = rows.where("is_peak = 1").select(*keys, "island", F.col("date").alias("peak_date"), F.col("idx").alias("peak_idx"))
    ends = starts.select(*keys, (F.col("island") - 1).alias("island"), F.col("peak_date").alias("recovery_date"), F.col("peak_idx").alias("recovery_idx"))
    lows = rows.where("is_peak = 0").groupBy(*keys, "island").agg(F.min_by(F.struct("date", "idx"), F.struct("dd", "idx")).alias("low"), F.min("dd").alias("depth"), F.min(F.when(F.col("dd") <= -0.05, F.col("date"))).alias("first_5"), F.min(F.when(F.col("dd") <= -0.10, F.col("date"))).alias("first_10"))
    out = lows.join(starts, [*keys, "island"]).join(ends, [*keys, "island"], "left")
    return out.select(*keys, "peak_date", F.col("low.date").alias("trough_date"), "recovery_date", "depth", (F.col("low.idx") - F.col("peak_idx")).alias("decline"), (F.col("recovery_idx") - F.col("low.idx")).alias("recovery"), "first_5", "first_10")


def fixed_mix(returns: DataFrame, weight: Column | float) -> DataFrame:
    """(date, idx, nav) of weight * r + (1 - weight) * rf, compounded. returns: date, idx, r, rf."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    mixed = F.log1p(w * F.coalesce("r", F.lit(0.0)) + (1 - w) * F.col("rf"))
    return returns.select("date", "idx", F.exp(F.sum(mixed).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))).alias("nav"))


def holding_periods(rebalances: DataFrame) -> DataFrame:
    """(execution_idx, period_return) from one pre-trade value to the next."""
    ahead = F.lead("pretrade_nav").over(Window.orderBy("execution_idx"))
    return rebalances.select("execution_idx", (ahead / F.col("pretrade_nav") - 1).alias("period_return"))


def defence_states(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """weekly (keys, week, risk) with state, transition and age: DEFENSE while risk holds, NORMAL else; null risk keeps the state; age in weeks."""
    over = Window.partitionBy(*keys).orderBy("week")
    state = F.when(F.coalesce(F.last("risk", True).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)), "DEFENSE").otherwise("NORMAL")
    rows = weekly.withColumn("state", state)
    rows = rows.withColumn("before", F.lag("state").over(over)).withColumn("changed", ~F.col("state").eqNullSafe(F.col("before")))
    rows = rows.withColumn("run", C.run_id(F.col("changed"), over))
    age = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("week"))
    transition = F.when(F.col("before").isNull() | ~F.col("changed"), "hold").otherwise(F.concat_ws(">", "before", "state"))
    return rows.withColumn("transition", transition).withColumn("age", age).drop("before", "changed", "run")


def reentry_states(weekly: DataFrame, keys: Sequence[str] = (), block: int = 128) -> DataFrame:
    """(keys, week, state) of an automaton: ARMED goes to DEFENSE on an alert, DEFENSE to RECOVERY when confirmed, RECOVERY to ARMED when calm and back to DEFENSE on an alert. A null says nothing.

    A row is a map from the state before it to the one after. Maps of a block of rows are composed to one, so that what a
    series carries from block to block is one map each, and the rows of a block start from the state that the maps before it lead to.
    """
    keys = list(keys)
    says = lambda c: F.coalesce(F.col(c), F.lit(False))
    names = F.array(F.lit("ARMED"), F.lit("DEFENSE"), F.lit("RECOVERY"))
    move = F.array(F.when(says("alert"), 1).otherwise(0), F.when(says("confirmed"), 2).otherwise(1), F.when(says("alert"), 1).when(says("calm"), 0).otherwise(2))
    follow = lambda maps, start: F.aggregate(maps, start, lambda now, m: m[now])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("week")) - 1
    rows = weekly.select(*keys, "week", move.alias("move"), F.floor(place / block).alias("block_"))
    blocks = rows.groupBy(*keys, "block_").agg(F.sort_array(F.collect_list(F.struct("week", "move"))).alias("rows"))
    blocks = blocks.withColumn("maps", F.col("rows.move")).withColumn("whole", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda s: follow(F.col("maps"), s)))
    before = F.collect_list("whole").over(Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    started = blocks.withColumn("start", follow(before, F.lit(0)))
    each = started.select(*keys, "maps", "start", F.posexplode("rows").alias("at", "row"))
    state = follow(F.slice("maps", F.lit(1), F.col("at") + 1), F.col("start"))
    return each.select(*keys, F.col("row.week").cast("int").alias("week"), names[state].alias("state"))
