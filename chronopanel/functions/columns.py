"""Column expressions that panel operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(x: Column, fn: Callable[[Column], Column], n: int, over: WindowSpec, least: int | None = None) -> Column:
    """fn over the last n rows, the present one included; null unless `least` (default n) of them are not null."""
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def trailing(x: Column, fn: Callable[[Column], Column], n: int, over: WindowSpec, least: int | None = None) -> Column:
    """fn over the n rows before the present one."""
    frame = over.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def simple_return(now: Column, base: Column) -> Column:
    """now / base - 1 where both are above 0, else null."""
    return F.when((now > 0) & (base > 0), now / base - 1)


def log_return(now: Column, base: Column) -> Column:
    return F.when((now > 0) & (base > 0), F.log(now) - F.log(base))


def average_rank(x: Column, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank from 1 with ties at their mean; nulls rank null. Keys must part the rows."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    ties = Window.partitionBy(*keys, x)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    return F.when(x.isNotNull(), rank + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def centered_rank(x: Column, keys: Sequence[str]) -> Column:
    """Average rank on [-1, 1]; null with fewer than two values."""
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(n >= 2, 2.0 * (average_rank(x, keys) - 1) / (n - 1) - 1)


def sample_skewness(x: Column, over: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness, null below 3 values."""
    n, s = (F.count(x), F.skewness(x)) if over is None else (F.count(x).over(over), F.skewness(x).over(over))
    return F.when(n >= 3, s * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(x: Column, over: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis, null below 4 values."""
    n, k = (F.count(x), F.kurtosis(x)) if over is None else (F.count(x).over(over), F.kurtosis(x).over(over))
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * k + 6.0))


def exponential_mean(x: Column, decay: float, over: WindowSpec) -> Column:
    """v = decay * v_before + (1 - decay) * x, from the first x; nulls keep v.

    The frame reaches back to where a row's weight is below 1e-12, so that memory doesn't grow with the series.
    """
    reach = math.ceil(math.log(1e-12) / math.log(decay))
    past = F.collect_list(x).over(over.rowsBetween(-reach, 0))
    return F.when(F.size(past) > 0, F.aggregate(F.slice(past, 2, reach + 1), past[0], lambda v, r: decay * v + (1 - decay) * r))


def growth(r: Column, over: WindowSpec | None = None) -> Column:
    """1 + r multiplied up, as a sum of logarithms; r must be above -1."""
    total = F.sum(F.log1p(r))
    return F.exp(total if over is None else total.over(over))


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def run_id(changed: Column, over: WindowSpec) -> Column:
    """Number of the run of equal rows that a row is in; changed: whether it differs from the row before."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0))
