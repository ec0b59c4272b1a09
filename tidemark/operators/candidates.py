"""Candidates: gates, thinning and both sides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.stats import lookup
from tidemark.operators.sequential import cusum

#: Column families that candidates carry along.
FAMILIES = ("nl_", "qbin_", "agebin_", "since_", "occ_")


@dataclass
class Gate:
    """Thresholds of the gate; t and accel name the columns of the three horizons, longest first."""

    body_dom_min: float
    close_to_ext_max: float
    t_long_min: float
    accel_min: float
    atr_p_max: float
    dcw_p_max: float
    votes_min: tuple[float, float, float]
    quorum: int
    t: tuple[str, str, str] = ("t_240", "t_60", "t_15")
    accel: str = "accel_15_240"

    def conditions(self, side: str) -> dict[str, Column]:
        sign = 1 if side == "long" else -1
        near = "close_to_hi_atr" if side == "long" else "close_to_lo_atr"
        tests = {
            "body": F.col("body_dom") >= self.body_dom_min, "near": F.col(near) <= self.close_to_ext_max, "trend": F.abs(F.col(self.t[0])) >= self.t_long_min,
            "sign": F.signum(F.col(self.t[0])) == sign, "accel": F.col(self.accel) >= self.accel_min, "atr": F.col("atr_p") <= self.atr_p_max, "dcw": F.col("dcw_p") <= self.dcw_p_max,
        }
        votes = reduce(add, [F.coalesce((sign * F.col(t) >= m).cast("int"), F.lit(0)) for t, m in zip(self.t, self.votes_min, strict=True)])
        return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()} | {"quorum": votes >= self.quorum}

    def mask(self, side: str) -> Column:
        return reduce(and_, self.conditions(side).values())

    def diagnostics(self, df: DataFrame, side: str) -> DataFrame:
        """One row: how many rows pass each condition, and all of them."""
        return df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(f"n_{k}") for k, c in self.conditions(side).items()], F.count_if(self.mask(side)).alias("n_all"))


def every_kth(df: DataFrame, k: int, keys: tuple[str, ...] = W.SERIES) -> DataFrame:
    """Rows 0, k, 2k, ... of each series; all rows for k <= 1."""
    if k <= 1:
        return df
    return df.withColumn("__row", F.row_number().over(W.ordered(keys)) - 1).where(F.col("__row") % k == 0).drop("__row")


def thinned(df: DataFrame, lookback: int = 240, k_sigma: float = 0.75, drift: float = 0.0, min_gap: int = 0, fallback_stride: int = 0, keys: tuple[str, ...] = W.SERIES) -> DataFrame:
    """Rows where returns leave k_sigma rolling deviations; series with too few of them also get every fallback_stride-th row."""
    rows = df.withColumn("__ret", F.coalesce("ret_1m", F.lit(0.0)))
    rows = W.sigma_filled(rows, "__ret", lookback, "__sigma_f", keys).withColumn("__h", F.col("__sigma_f") * k_sigma)
    rows = cusum(rows, "__ret", "__h", drift, min_gap, keys)
    every = W.Window.partitionBy(*keys)
    wanted = F.col("event") == 1
    if fallback_stride > 0:
        few = F.sum("event").over(every) < F.greatest(F.lit(1), F.floor(F.count("*").over(every) / (10 * fallback_stride)))
        rows = rows.withColumns({"__few": few, "__row": F.row_number().over(W.ordered(keys)) - 1})
        wanted = wanted | (F.col("__few") & (F.col("__row") % fallback_stride == 0))
    return rows.where(wanted).select(*df.columns)


def both_sides(df: DataFrame, eta: float = 20.0, eta_table: list[tuple[float, float, float]] = [], min_risk: float = 0.001, sides: tuple[str, ...] = ("long", "short")) -> DataFrame:  # noqa: B006
    """One candidate for each row and side: entry at the close, level eta ATRs against it, risk_dist their distance.

    Candidates that risk less than min_risk ATRs are dropped; the four prices are rounded to 8 places.
    """
    eta_of = lookup(F.col("atr_p"), eta_table, eta) if eta_table else F.lit(float(eta))
    out = df.withColumn("eta", eta_of).withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides])))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    out = out.withColumns({"entry": F.col("close"), "level": F.col("close") - sign * F.col("eta") * F.col("atr")}).withColumn("risk_dist", F.abs(F.col("entry") - F.col("level")))
    out = out.where(F.col("risk_dist") >= min_risk * F.col("atr"))
    return out.withColumns({c: F.round(c, 8) for c in ("entry", "level", "risk_dist", "atr")})


def gated(df: DataFrame, gate: Gate, eta: float = 0.3, eta_table: list[tuple[float, float, float]] = [], eta_cap: tuple[float, float] = (0.0, float("inf")), min_risk: float = 0.0, sides: tuple[str, ...] = ("long", "short")) -> DataFrame:  # noqa: B006
    """One candidate for each row and side that passes all conditions of the gate; prices as in both_sides, eta within its cap.

    Candidates that risk less than min_risk ATRs are dropped; entry, level, risk_dist and eta are rounded to 8 places.
    """
    eta_of = lookup(F.col("atr_p"), eta_table, eta) if eta_table else F.lit(float(eta))
    passed = F.array_compact(F.array(*[F.when(gate.mask(s), F.lit(s)) for s in sides]))
    out = df.withColumn("eta", F.least(F.greatest(eta_of, F.lit(eta_cap[0])), F.lit(eta_cap[1]))).withColumn("side", F.explode(passed))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    out = out.withColumns({"entry": F.col("close"), "level": F.col("close") - sign * F.col("eta") * F.col("atr")}).withColumn("risk_dist", F.abs(F.col("entry") - F.col("level")))
    return out.where(F.col("risk_dist") >= min_risk * F.col("atr")).withColumns({c: F.round(c, 8) for c in ("entry", "level", "risk_dist", "eta")})


def kept_columns(df: DataFrame, base: list[str]) -> DataFrame:
    """The base columns that exist, in their order, then those of the families."""
    names = [c for c in base if c in df.columns]
    return df.select(*dict.fromkeys(names + [c for c in df.columns if c.startswith(FAMILIES)]))


def by_prefix(df: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(include) and not (exclude and c.startswith(exclude))]
