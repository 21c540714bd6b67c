"""Where queries and their SQL are put together; each module of this package adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the DuckDB SQL with the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# Pieces of the SQL side: the panel of sources/panel.py.
_PAID = "CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS close"
_REST = "MIN(l_extendedprice / l_quantity) AS open, MAX(l_extendedprice / l_quantity) AS high, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS volume"
BRAND, SIZE_GROUP, TYPE = "p_brand", "'G' || CAST(p_size % 5 AS INT)", "p_type"


def px(sid: str = BRAND) -> str:
    return f"px AS (SELECT CAST(l_shipdate AS DATE) AS date, {sid} AS sid, {_PAID}, {_REST} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


MARKET_BARS = f"bars AS (SELECT CAST(l_shipdate AS DATE) AS date, {_PAID}, {_REST} FROM lineitem GROUP BY 1)"


def week(d: str) -> str:
    return f"CAST(date_trunc('week', {d} + 2) AS DATE)"


def month(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


def cal(of: str) -> str:
    return f"""cal AS (SELECT *, COALESCE({month('next_session')} <> {month('date')}, true) AS month_last, COALESCE({week('next_session')} <> {week('date')}, true) AS week_last
  FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS idx, LEAD(date) OVER (ORDER BY date) AS next_session FROM (SELECT DISTINCT date FROM {of}) AS d) AS n)"""


#: The market series as `m`: calendar, bars and rf.
MARKET = f"{MARKET_BARS}, {cal('bars')}, m AS (SELECT cal.*, close, open, high, volume, (1 + idx % 7) * 0.00001 AS rf FROM cal JOIN bars USING (date))"


def spine(sid: str = BRAND) -> str:
    """px, cal and spine."""
    return f"{px(sid)}, {cal('px')}, spine AS (SELECT cal.*, s.sid, close, open, high, volume FROM cal CROSS JOIN (SELECT DISTINCT sid FROM px) AS s LEFT JOIN px USING (date, sid))"


def rolling(fn: str, x: str, n: int, least: int | None = None, part: str = "PARTITION BY sid") -> str:
    frame = f"OVER ({part} ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({x}) {frame} >= {n if least is None else least} THEN {fn}({x}) {frame} END"


def ret(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} / {b} - 1 END"


def lret(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN LN({a}) - LN({b}) END"


def lag(x: str, n: int = 1, part: str = "PARTITION BY sid") -> str:
    return f"LAG({x}, {n}) OVER ({part} ORDER BY idx)"


def avg_rank(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN RANK() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (COUNT(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 END"
