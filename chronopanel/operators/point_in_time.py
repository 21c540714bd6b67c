"""Point-in-time selection: memberships, vintages, as-of joins, interval algebra.

Intervals are half-open [effective_from, effective_to); a null end is open. As-of joins sort each key's rows once by
time, in buckets of time, so that no key's whole history has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(date: Column, start: Column, end: Column) -> Column:
    return (start <= date) & (end.isNull() | (date < end))


def members_on(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, sid) of the members on each of the dates, a stated set that goes to all executors."""
    days = F.broadcast(dates.select("date").distinct())
    return intervals.join(days, active(F.col("date"), F.col("effective_from"), F.col("effective_to"))).select("date", "sid").distinct()


def snapshot_members_on(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, snapshot_date, sid): the latest full snapshot on or before each date; none before the first."""
    ends = snapshots.select("date").distinct().select(F.col("date").alias("snapshot_date"), F.lead("date").over(Window.orderBy("date")).alias("until"))
    at = dates.select("date").distinct().join(F.broadcast(ends), active(F.col("date"), F.col("snapshot_date"), F.col("until"))).select("date", "snapshot_date")
    return F.broadcast(at).join(snapshots.select(F.col("date").alias("snapshot_date"), "sid"), "snapshot_date").select("date", "snapshot_date", "sid")


def interval_faults(intervals: DataFrame) -> DataFrame:
    """(sid, effective_from, fault) of rows that break the rules: empty, repeated, after an open one, or overlapping any before."""
    over = Window.partitionBy("sid").orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("was", F.lag(F.struct("effective_from", "effective_to")).over(over))
    rows = rows.withColumn("reach", F.max("effective_to").over(earlier)).withColumn("open_before", F.max(F.col("effective_to").isNull()).over(earlier))
    fault = (
        F.when(F.col("effective_to") <= F.col("effective_from"), "empty")
        .when(F.col("was").isNotNull() & (F.col("was.effective_from") == F.col("effective_from")) & F.col("was.effective_to").eqNullSafe(F.col("effective_to")), "repeated")
        .when(F.col("open_before"), "open_not_last")
        .when(F.col("reach") > F.col("effective_from"), "overlap")
    )
    return rows.select("sid", "effective_from", fault.alias("fault")).where("fault IS NOT NULL")


def snapshots_to_intervals(snapshots: DataFrame) -> DataFrame:
    """(sid, effective_from, effective_to) of unbroken presence in consecutive snapshots (date, sid)."""
    order = snapshots.select("date").distinct()
    order = order.select("date", F.row_number().over(Window.orderBy("date")).alias("n"), F.lead("date").over(Window.orderBy("date")).alias("until"))
    rows = snapshots.select("date", "sid").distinct().join(F.broadcast(order), "date")
    island = F.col("n") - F.row_number().over(Window.partitionBy("sid").orderBy("n"))
    last = F.max(F.struct("n", "until"))["until"]
    return rows.withColumn("island", island).groupBy("sid", "island").agg(F.min("date").alias("effective_from"), last.alias("effective_to")).drop("island")


def overlapping(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals that share a date with [start, end]."""
    return intervals.where((F.col("effective_from") <= end) & (F.col("effective_to").isNull() | (F.col("effective_to") > start)))


def merged(intervals: DataFrame) -> DataFrame:
    """Per sid, overlapping and touching intervals as one."""
    over = Window.partitionBy("sid").orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    is_open = F.col("effective_to").isNull()
    apart = (F.col("effective_from") > F.max("effective_to").over(earlier)) & ~F.max(is_open).over(earlier)
    first = F.row_number().over(over) == 1
    new = intervals.withColumn("is_new", (first | F.coalesce(apart, F.lit(False))).cast("int"))
    island = F.sum("is_new").over(over.rowsBetween(Window.unboundedPreceding, 0))
    out = new.withColumn("island", island).groupBy("sid", "island").agg(F.min("effective_from").alias("effective_from"), F.max("effective_to").alias("end"), F.max(is_open).alias("is_open"))
    return out.select("sid", "effective_from", F.when(~F.col("is_open"), F.col("end")).alias("effective_to"))


def split_at(intervals: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Intervals cut in two at a boundary (sid, boundary) that lies inside."""
    inside = F.col("boundary").isNotNull() & (F.col("boundary") > F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("boundary") < F.col("effective_to")))
    piece = lambda a, b: F.struct(a.alias("effective_from"), b.alias("effective_to"))
    whole = F.array(piece(F.col("effective_from"), F.col("effective_to")))
    parts = F.when(inside, F.array(piece(F.col("effective_from"), F.col("boundary")), piece(F.col("boundary"), F.col("effective_to")))).otherwise(whole)
    return intervals.join(boundaries, "sid", "left").select("sid", F.explode(parts).alias("p")).select("sid", "p.*")


def replaced(intervals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Intervals with those that an override (sid, match_from, match_to, new_from, new_to) names exactly put in its place."""
    overrides = overrides.withColumnRenamed("sid", "of_sid")
    hit = (F.col("sid") == F.col("of_sid")) & (F.col("effective_from") == F.col("match_from")) & F.col("effective_to").eqNullSafe(F.col("match_to"))
    joined = intervals.join(F.broadcast(overrides.withColumn("is_hit", F.lit(True))), hit, "left")
    return joined.select("sid", F.when(F.col("is_hit"), F.col("new_from")).otherwise(F.col("effective_from")).alias("effective_from"), F.when(F.col("is_hit"), F.col("new_to")).otherwise(F.col("effective_to")).alias("effective_to"))


def clipped(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """Intervals within the spans (sid, span_from, span_to) of the same sid; empty ones go."""
    both = intervals.join(spans, "sid")
    out = both.select("sid", F.greatest("effective_from", "span_from").alias("effective_from"), F.least("effective_to", "span_to").alias("effective_to"))
    return out.where("effective_to IS NULL OR effective_from < effective_to")


def facts_as_of(facts: DataFrame, cutoff: Column, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The last version of each economic key that was there at the cutoff; ties go to the greater `tie`."""
    last = F.max_by(F.struct(*(F.col(c) for c in facts.columns if c not in keys)), F.struct(at, tie))
    return facts.where(F.col(at) <= cutoff).groupBy(*keys).agg(last.alias("v")).select(*keys, "v.*")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], bucket: Column | None = None, inclusive: bool = True) -> DataFrame:
    """left with the last row of right (keys, at, values) at or before its own time, and that row's time as matched_at.

    Of rows of one time the one with the greatest values counts.

    One shuffle deals rows of both sides by key and bucket (a coarse time, by default the month of `at`); each bucket
    then starts from the last value before it, which comes from a table of one row for each key and bucket.
    """
    keys = list(keys)
    bucket = F.date_trunc("month", F.col(at)) if bucket is None else bucket
    value = F.struct(F.col(at).alias("matched_at"), *values)
    mine = left.withColumn("is_left", F.lit(1 if inclusive else 0)).withColumn("payload", F.struct(*left.columns)).select(*keys, at, "is_left", "payload", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("v"))
    theirs = right.withColumn("is_left", F.lit(0 if inclusive else 1)).select(*keys, at, "is_left", F.lit(None).cast(mine.schema["payload"].dataType).alias("payload"), value.alias("v"))
    both = mine.unionByName(theirs).withColumn("bucket", bucket)
    within = Window.partitionBy(*keys, "bucket").orderBy(at, "is_left", "v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("v", True).over(within)).where("payload IS NOT NULL")
    ends = theirs.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.max("v").alias("last_here"))
    marks = found.select(*keys, "bucket").distinct().join(ends, [*keys, "bucket"], "full")
    carried = marks.withColumn("before", F.last("last_here", True).over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    out = found.join(carried.select(*keys, "bucket", "before"), [*keys, "bucket"], "left").withColumn("m", F.coalesce("here", "before"))
    return out.select("payload.*", *(F.col(f"m.{c}").alias(c) for c in ["matched_at", *values]))


def first_session_after(events: DataFrame, calendar: DataFrame, at: str, buffer_minutes: int = 10, close: str = "16:00:00") -> DataFrame:
    """events with signal_date, the first session whose close is at or after `at` plus the buffer. The calendar goes to all executors."""
    instants = calendar.select(F.col("date").alias("signal_date"), F.to_timestamp(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.lit(close))).alias("closes"))
    instants = instants.withColumn("closed_before", F.lag("closes").over(Window.orderBy("closes")))
    ready = F.col(at) + F.expr(f"INTERVAL {buffer_minutes} MINUTES")
    return events.withColumn("ready", ready).join(F.broadcast(instants), (F.col("ready") <= F.col("closes")) & (F.col("closed_before").isNull() | (F.col("ready") > F.col("closed_before"))), "left").drop("ready", "closes", "closed_before")


def known_intervals(rows: DataFrame, keys: Sequence[str], at: Column, version: Column) -> DataFrame:
    """(keys, v, known_from, known_until): of each key the greatest version known from each time `at` on, until a row more is known.

    Rows of a key are sorted once; no row is copied to the dates that ask for it.
    """
    over = Window.partitionBy(*keys).orderBy("known_from", "version")
    timed = rows.select(*keys, at.alias("known_from"), version.alias("version"))
    best = F.max("version").over(over.rowsBetween(Window.unboundedPreceding, 0))
    timed = timed.select(*keys, best.alias("v"), "known_from", F.lead("known_from").over(over).alias("known_until"))
    return timed.where("known_until IS NULL OR known_from < known_until")


def latest_filings(filings: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal_date, entity, current, prior): per signal the newest revision of the latest fiscal year that was available, and of the year before.

    Two stages: the newest revision of each year first, then the years; an old year that is revised late doesn't become
    current. Fiscal years of an entity end in their order, so a year is of use until one is known that ends two years later.
    """
    revisions = known_intervals(filings, ["entity", "fiscal_year"], F.col("available"), F.struct("accepted_at", "accession", "value", "period_end"))
    years = filings.groupBy("entity", "fiscal_year").agg(F.min("available").alias("first"))
    later = Window.partitionBy("entity").orderBy("fiscal_year").rangeBetween(2, Window.unboundedFollowing)
    years = years.withColumn("gone", F.min("first").over(later)).drop("first")
    of_use = revisions.join(years, ["entity", "fiscal_year"]).withColumn("until", F.least("known_until", "gone"))
    here = active(F.col("signal_date"), F.col("known_from"), F.col("until"))
    seen = of_use.join(F.broadcast(signals.select("signal_date").distinct()), here)
    seen = seen.withColumn("rank", F.row_number().over(Window.partitionBy("signal_date", "entity").orderBy(F.col("v.period_end").desc(), F.col("fiscal_year").desc())))
    current = seen.where("rank = 1").select("signal_date", "entity", F.col("fiscal_year").alias("current_year"), F.col("v.accession").alias("current_accession"), F.col("v.value").alias("current_value"))
    prior = seen.select("signal_date", "entity", (F.col("fiscal_year") + 1).alias("current_year"), F.col("v.accession").alias("prior_accession"), F.col("v.value").alias("prior_value"))
    return current.join(prior, ["signal_date", "entity", "current_year"], "left")


def with_previous(rows: DataFrame, order: str, value: Column, bucket: Column, name: str) -> DataFrame:
    """rows with the value of the row before by `order`, a unique column; bucket: a coarse form of it, ascending, by which rows are dealt."""
    mine = rows.withColumn("bucket_", bucket).withColumn("value_", F.struct(value.alias("x")))
    within = Window.partitionBy("bucket_").orderBy(order)
    last = mine.groupBy("bucket_").agg(F.max_by("value_", order).alias("last_"))
    last = last.select("bucket_", F.lag("last_").over(Window.orderBy("bucket_")).alias("before_"))  # one row for each bucket
    found = mine.withColumn("here_", F.lag("value_").over(within)).join(last, "bucket_", "left")
    return found.select(*rows.columns, F.coalesce("here_", "before_")["x"].alias(name))


def held(schedule: DataFrame, calendar: DataFrame, value: str, default: float | None = None, order: str | None = None) -> DataFrame:
    """(date, value): a step function of the schedule (date, value) on all sessions, carried forward.

    Of several rows of a date the one with the greatest `order` counts, by default the greatest value.
    """
    steps = schedule.groupBy("date").agg((F.max(value) if order is None else F.max_by(value, order)).alias(value))
    over = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(value, True).over(over)
    return calendar.select("date").join(F.broadcast(steps), "date", "left").select("date", (carried if default is None else F.coalesce(carried, F.lit(default))).alias(value))


def mapping_coverage(members: DataFrame, mappings: DataFrame) -> DataFrame:
    """(date, n_members, n_mapped): how many members of each date any mapping interval covers."""
    hit = members.join(mappings.select("sid", "effective_from", "effective_to"), "sid", "left").withColumn("is_hit", F.coalesce(active(F.col("date"), F.col("effective_from"), F.col("effective_to")), F.lit(False)))
    one = hit.groupBy("date", "sid").agg(F.max("is_hit").alias("is_hit"))
    return one.groupBy("date").agg(F.count("*").alias("n_members"), F.sum(F.col("is_hit").cast("long")).alias("n_mapped"))


def scoped_snapshots(snapshots: DataFrame, allowed: DataFrame, start: str, end: str) -> DataFrame:
    """(date, sid) of the full snapshots from the last one on or before `start` to `end`, of the allowed sids."""
    first = snapshots.where(F.col("date") <= F.lit(start).cast("date")).agg(F.max("date").alias("anchor"))
    here = snapshots.where(F.col("date") <= F.lit(end).cast("date")).join(F.broadcast(first), F.col("date") >= F.col("anchor"))  # one row
    return here.select("date", "sid").join(allowed.select("sid").distinct(), "sid", "left_semi").select("date", "sid").distinct()
