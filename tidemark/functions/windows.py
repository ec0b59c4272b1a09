"""Trailing, row-based window expressions over series of (symbol, ts).

Every window is partitioned by the series, so series (and folds) run side by side. Bars are small next to the
ticks they come from; a window never sees ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.stats import safe_div

SERIES = ("symbol",)


def ordered(keys: tuple[str, ...] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def last(n: int, keys: tuple[str, ...] = SERIES) -> WindowSpec:
    return ordered(keys).rowsBetween(-(n - 1), 0)


def full(agg: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """The aggregate over w where it holds at least `least` values of x, else null."""
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def log_return(x: Column, keys: tuple[str, ...] = SERIES) -> Column:
    return F.ln(x) - F.lag(F.ln(x)).over(ordered(keys))


def true_range(keys: tuple[str, ...] = SERIES) -> Column:
    before = F.lag("close").over(ordered(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def t_stat(x: Column, n: int, keys: tuple[str, ...] = SERIES) -> Column:
    """mean * sqrt(n) / standard deviation of the last n values; null for fewer values or a constant window."""
    w = last(n, keys)
    return F.when(F.count(x).over(w) >= n, F.try_divide(F.avg(x).over(w) * (n**0.5), F.stddev_samp(x).over(w)))


def channel(n: int, keys: tuple[str, ...] = SERIES, least: int | None = None) -> tuple[Column, Column]:
    """Highest high and lowest low of the last n rows; null for fewer than `least` (n) rows."""
    w, least = last(n, keys), n if least is None else least
    return full(F.max("high"), F.col("high"), w, least), full(F.min("low"), F.col("low"), w, least)


def crossed(x: Column, keys: tuple[str, ...] = SERIES) -> Column:
    """1 where the sign is opposite to that of the row before; averaged over rows, the zero-cross rate."""
    sign = F.signum(F.coalesce(x, F.lit(0.0)))
    return F.coalesce((sign * F.lag(sign).over(ordered(keys)) < 0).cast("double"), F.lit(0.0))


def turned(x: Column, keys: tuple[str, ...] = SERIES) -> Column:
    """1 where the sign differs from the row before; the first row counts as a turn."""
    sign = F.signum(F.coalesce(x, F.lit(0.0)))
    return (~sign.eqNullSafe(F.lag(sign).over(ordered(keys)))).cast("int")


def sign_entropy(x: Column, n: int, keys: tuple[str, ...] = SERIES) -> Column:
    """Binary entropy (1 at most) of the part of positive values among the last n rows."""
    p = F.avg((F.coalesce(x, F.lit(0.0)) > 0).cast("double")).over(last(n, keys))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q)) / F.ln(F.lit(2.0))


def sigma_filled(df: DataFrame, x: str, n: int, out: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Population deviation of the last n rows, 1e-12 at least; where too few rows are there, the series' least one."""
    raw = full(F.stddev_pop(x), F.col(x), last(n, keys), max(2, n // 3))
    df = df.withColumn("__sigma", raw)
    every = Window.partitionBy(*keys)
    filled = F.coalesce(F.col("__sigma"), F.min("__sigma").over(every), F.stddev_pop(x).over(every), F.lit(0.0))
    return df.withColumn(out, F.greatest(filled, F.lit(1e-12))).drop("__sigma")


def run_lengths(df: DataFrame, x: str, out: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """1, 2, 3, ... along equal neighbours, from 1 again where the value changes."""
    at = F.row_number().over(ordered(keys))
    df = df.withColumns({"__at": at, "__new": (at == 1) | ~F.col(x).eqNullSafe(F.lag(x).over(ordered(keys)))})
    began = F.max(F.when(F.col("__new"), F.col("__at"))).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("__at") - began + 1).drop("__at", "__new")


def rows_since(df: DataFrame, flag: Column, out: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Rows since the flag was last set, 0 where it is; null before it first is."""
    df = df.withColumn("__at", F.row_number().over(ordered(keys)))
    seen = F.max(F.when(flag, F.col("__at"))).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("__at") - seen).drop("__at")


def occupancy(flag: Column, n: int, keys: tuple[str, ...] = SERIES) -> Column:
    """Part of the last n rows in which the flag is set."""
    return F.avg(flag.cast("double")).over(last(n, keys))


def range_ratio(n: int, atr: Column, keys: tuple[str, ...] = SERIES) -> Column:
    hi, lo = channel(n, keys, 1)
    return safe_div(hi - lo, atr)
