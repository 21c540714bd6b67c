"""Names, tickers and codes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words of company names that say nothing about who it is.
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "sa", "ag", "nv", "group", "holdings", "holding", "the")


def provider_symbol(x: Column) -> Column:
    """Upper case without a provider's prefix "name::", "/" as "-", no spaces."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(x, r"^[^:]+::", "")), "/", "-"), r"\s+", "")


def symbol_variants(x: Column) -> Column:
    """The symbol with ".", "-" or "_" for each of the three, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array(*(F.regexp_replace(x, r"[._-]", s) for s in (".", "-", "_")))))


def normalized_name(x: Column) -> Column:
    """Lower case, "&" as "and", letters and digits only, without a "/state/" tail and legal words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(x, r"\s*/[A-Za-z]{2,}/?\s*$", "")), "&", " and "), r"[^a-z0-9]+", " ")
    words = F.filter(F.split(F.trim(plain), " +"), lambda w: ~w.isin(list(LEGAL_WORDS)) & (w != ""))
    return F.array_join(words, " ")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def padded_code(x: Column, width: int = 10) -> Column:
    return F.lpad(F.regexp_replace(x.cast("string"), r"^0+(?=.)", ""), width, "0")


def pipe_list(x: Column, empty: Sequence[str] = ("NONE", "INHERIT")) -> Column:
    """Items between pipes, trimmed; the marks for nothing, blanks and null give an empty list."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.upper(F.trim(F.coalesce(x, F.lit("")))).isin(list(empty)), F.array().cast("array<string>")).otherwise(items)


def strict_boolean(x: Column) -> Column:
    """true, 1, yes / false, 0, no in any case; anything else is an error, null stays."""
    said = F.lower(F.trim(x))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), x))
    return F.when(x.isNull(), None).when(said.isin("true", "1", "yes"), True).when(said.isin("false", "0", "no"), False).otherwise(wrong.cast("boolean"))


def optional_date(x: Column) -> Column:
    """A date; blank is null."""
    return F.to_date(F.nullif(F.trim(x), F.lit("")))


def matching_characters(a: str, b: str) -> int:
    """Characters in the longest stretch that two texts have in common (the first of equal ones), and in those left and right of it again."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best_i, best_j, best = a0, b0, 0
        ends: dict[int, int] = {}
        for i in range(a0, a1):
            now: dict[int, int] = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    n = now[j] = ends.get(j - 1, 0) + 1
                    if n > best:
                        best_i, best_j, best = i - n + 1, j - n + 1, n
            ends = now
        if best:
            total += best
            todo += [(a0, best_i, b0, best_j), (best_i + best, a1, best_j + best, b1)]
    return total


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters of two texts over the characters of both; 1 for two empty ones, null with a null."""
    return pd.Series([None if x is None or y is None else 2.0 * matching_characters(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def name_score(a: Column, b: Column) -> Column:
    """Of two normalised names: 1 if equal, 0 if one is empty, else six parts of the sequence ratio and four of the words in common."""
    mixed = 0.6 * sequence_ratio(a, b) + 0.4 * token_jaccard(a, b)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(mixed)
