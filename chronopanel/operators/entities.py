"""Names of one entity in several registers: candidates, resolution, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import text as tx


def name_candidates(names: DataFrame, lookup: DataFrame, least: float = 0.5) -> DataFrame:
    """(sid, cik, score, is_exact): entries of lookup (cik, name) with the same normalised name, or with the same first and last word and enough words in common.

    Pairs are made within blocks of equal first and last words and one of a name's rarest words, never across: two names
    with a share of `least` of their words in common have one of the first n - ceil(least * n) + 1 by rarity in common. An
    exact match makes no others for a sid.
    """
    mine = names.select("sid", tx.normalized_name(F.col("name")).alias("a")).where("a <> ''")
    theirs = lookup.select("cik", tx.normalized_name(F.col("name")).alias("b")).where("b <> ''").distinct()
    exact = mine.join(theirs, F.col("a") == F.col("b")).select("sid", "cik", F.lit(1.0).alias("score"), F.lit(True).alias("is_exact"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    times = mine.select(F.explode(words("a")).alias("word")).union(theirs.select(F.explode(words("b")))).groupBy("word").agg(F.count("*").alias("times"))

    def blocks(rows: DataFrame, id_: str, name: str) -> DataFrame:
        ends = F.concat_ws(" ", F.split(name, " ")[0], F.element_at(F.split(name, " "), -1))
        spread = rows.select(id_, name, F.explode(words(name)).alias("word")).join(times, "word")
        first = F.count("*").cast("int") - F.ceil(F.count("*") * least).cast("int") + 1
        rare = F.slice(F.sort_array(F.collect_list(F.struct("times", "word"))), F.lit(1), first)
        return spread.groupBy(id_, name).agg(rare.alias("rare")).select(id_, name, ends.alias("ends"), F.explode("rare.word").alias("word"))

    open_ = mine.join(exact.select("sid").distinct(), "sid", "left_anti")
    pairs = blocks(open_, "sid", "a").join(blocks(theirs, "cik", "b"), ["ends", "word"]).select("sid", "cik", "a", "b").distinct()
    near = pairs.select("sid", "cik", tx.token_jaccard(F.col("a"), F.col("b")).alias("score"), F.lit(False).alias("is_exact"))
    return exact.unionByName(near.where(F.col("score") >= least))


def resolve(names: DataFrame, overrides: DataFrame, tickers: DataFrame, candidates: DataFrame, least: float = 0.92, lead: float = 0.03) -> DataFrame:
    """(sid, cik, method) of each name: the override, else the one entity of its tickers, else the best candidate with a lead, else unresolved.

    tickers: sid, cik, as many as there are; different ones are a conflict.
    """
    by_ticker = tickers.groupBy("sid").agg(F.min("cik").alias("low"), F.max("cik").alias("high"))
    over = Window.partitionBy("sid").orderBy(F.col("score").desc(), "cik")
    ranked = candidates.withColumn("place", F.row_number().over(over)).withColumn("next", F.lead("score").over(over))
    best = ranked.where("place = 1").select("sid", F.col("cik").alias("best"), "score", "next")
    joined = names.select("sid").join(overrides.select("sid", F.col("cik").alias("fixed")), "sid", "left").join(by_ticker, "sid", "left").join(best, "sid", "left")
    sure = (F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= lead)
    method = F.when(F.col("fixed").isNotNull(), "override").when(F.col("low").isNotNull() & (F.col("low") == F.col("high")), "ticker").when(F.col("low").isNotNull(), "ticker_conflict").when(sure, "name").otherwise("unresolved")
    cik = F.when(method == "override", F.col("fixed")).when(method == "ticker", F.col("low")).when(method == "name", F.col("best"))
    return joined.select("sid", cik.alias("cik"), method.alias("method"))


def aliases(master: DataFrame, lineage: DataFrame) -> DataFrame:
    """(sid, alias): the ticker and the sources of a piped list, in all their spellings."""
    own = master.select("sid", F.col("ticker").alias("symbol"))
    sources = lineage.select(F.col("canonical_sid").alias("sid"), F.explode(tx.pipe_list(F.col("source_sid"))).alias("symbol"))
    return own.unionByName(sources).select("sid", F.explode(tx.symbol_variants(tx.provider_symbol(F.col("symbol")))).alias("alias")).distinct()


def without_orphan_copies(facts: DataFrame, ledger: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """facts without rows whose accession isn't in the ledger and that repeat exactly one row that is; and a count of what went.

    keys are compared with nulls equal.
    """
    marked = facts.join(ledger.select("accession").distinct().withColumn("known", F.lit(True)), "accession", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    part = Window.partitionBy(*keys)
    counted = marked.withColumn("n_known", F.sum(F.col("known").cast("int")).over(part))
    gone = ~F.col("known") & (F.col("n_known") == 1)
    return counted.where(~gone).drop("n_known"), counted.agg(F.sum(gone.cast("long")).alias("n_dropped"), F.sum((~F.col("known") & ~gone).cast("long")).alias("n_orphans_left"))


def rekeyed(history: DataFrame, mappings: DataFrame) -> DataFrame:
    """history (symbol, date, ...) with the sid to which its symbol belonged on the date; mappings: sid, symbol, effective_from, effective_to (half-open)."""
    active = (F.col("effective_from") <= F.col("date")) & (F.col("effective_to").isNull() | (F.col("date") < F.col("effective_to")))
    return history.join(mappings, "symbol").where(active).drop("effective_from", "effective_to")


def rekeyed_totals(history: DataFrame, mappings: DataFrame, value: str) -> DataFrame:
    """(sid, n, total): rows and sum of value of each sid in rekeyed(), without a row for each pair of both; dates are days.

    A symbol's history is summed over days and over blocks of 2, 4, 8 ... days, counted back from the last of all. An interval
    is at most two blocks of each length, so that its rows grow with the logarithm of the days. Sums are only added, never
    subtracted: what isn't finite stays in the intervals that hold it.
    """
    span = history.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    span = span.select("last", (F.datediff("last", "first") + 1).alias("width")).withColumn("levels", F.length(F.bin("width")))
    days = history.where("symbol IS NOT NULL AND date IS NOT NULL").groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    level = F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level")
    days = days.crossJoin(F.broadcast(span)).select("symbol", F.datediff("last", "date").alias("back"), "n", "total", level)
    sums = days.groupBy("symbol", "level", F.expr("shiftright(back, level)").alias("block")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    held = mappings.crossJoin(F.broadcast(span)).where("symbol IS NOT NULL AND effective_from <= last")
    # Days back from `low` up to before `high`; an open interval reaches the last day, and none reaches before the first.
    low = F.greatest(F.datediff("last", "effective_to") + 1, F.lit(0))
    high = F.least(F.datediff("last", "effective_from") + 1, F.col("width"))
    ends = held.select("sid", "symbol", low.alias("low"), high.alias("high"), level)
    ends = ends.select("sid", "symbol", "level", F.expr("-shiftright(-low, level)").alias("low"), F.expr("shiftright(high, level)").alias("high")).where("low < high")
    block = F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1))
    parts = ends.select("sid", "symbol", "level", F.explode(block).alias("block")).where("block IS NOT NULL")
    return parts.join(sums, ["symbol", "level", "block"]).groupBy("sid").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def scored_candidates(names: DataFrame, lookup: DataFrame, least: float = 0.5) -> DataFrame:
    """name_candidates() with the score of characters and words; only pairs that share a block are compared, each once."""
    pairs = name_candidates(names, lookup, least).select("sid", "cik", "is_exact")
    mine = names.select("sid", tx.normalized_name(F.col("name")).alias("a"))
    theirs = lookup.select("cik", tx.normalized_name(F.col("name")).alias("b")).distinct()
    scored = pairs.join(mine, "sid").join(theirs, "cik").withColumn("score", tx.name_score(F.col("a"), F.col("b")))
    return scored.groupBy("sid", "cik", "is_exact").agg(F.max("score").alias("score"))
