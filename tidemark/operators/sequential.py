"""Operators whose state runs along a series, each cut into pieces where its state allows it.

Averages are affine maps composed over pieces; schedules are chains of successors found by counting and pointer
doubling; the best set of intervals is found in each stretch between gaps. `cusum` and `capped`, whose states neither
compose nor point ahead, are one pandas group for each series and fold.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import pieces as P
from tidemark.sources.staging import saved


def _grouped(df: DataFrame, keys: list[str], f, added: str) -> DataFrame:
    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(f, f"{kept}, {added}" if added else kept)


def ema(df: DataFrame, x: str, n: int, out: str, keys: tuple[str, ...] = ("symbol",), pieces: int | None = None) -> DataFrame:
    """Exponential average with weight 2 / (n + 1), begun at the first value; nulls carry it on. A series may lie in any number of pieces."""
    rows = P.pieced(df, keys, [F.col("ts")], pieces)
    return P.affine_scan(rows, keys, "ts", x, 1 - 2 / (n + 1), out).drop("__piece")


def cusum(df: DataFrame, x: str, threshold: str, drift: float = 0.0, min_gap: int = 0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds `event`: 1 where the running sum of x leaves [-threshold, threshold].

    Both sums restart at each excursion, also at those less than min_gap rows after the last event, which are no events.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        up = down = 0.0
        last, hits = None, np.zeros(len(rows), dtype=np.int32)
        for i, (v, limit) in enumerate(zip(rows[x].to_numpy(float), rows[threshold].to_numpy(float), strict=True)):
            up, down = max(0.0, up + v - drift), min(0.0, down + v + drift)
            if up > limit or down < -limit:
                up = down = 0.0
                if last is None or i - last >= min_gap:
                    hits[i], last = 1, i
        return rows.assign(event=hits)

    return _grouped(df, list(keys), run, "event int")


def _numbered(df: DataFrame) -> DataFrame:
    return saved(df.withColumn("__id", F.monotonically_increasing_id()), "events")


def _met(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.withColumnRenamed("__id", "__met"), F.col("__id") == F.col("__met"), "left_semi").drop("__id")


def best_in_window(df: DataFrame, width_ms: int, keys: tuple[str, ...] = ("symbol", "side"), block: int = P.BLOCK, pieces: int | None = None) -> DataFrame:
    """Keeps the best candidate (least eta, highest atr_p, earliest) of each window.

    A window begins at the first candidate that is free and spans width_ms; after its best one at time t, candidates
    before t + width_ms are passed over. Null eta ranks last, null atr_p as the lowest.

    The best one of the window at each candidate is found among the candidates of its own stretch of width_ms and the next one.
    """
    rows, tie = _numbered(df), F.col("bar_idx" if "bar_idx" in df.columns else "__id")
    rank = F.struct(
        F.coalesce("eta", F.lit(float("inf"))).alias("eta"), (-F.coalesce("atr_p", F.lit(float("-inf")))).alias("atr_p"), F.col("ts").alias("ts"),
        tie.alias("tie"), F.col("__id").alias("id"),
    )
    stretch = F.floor(F.col("ts") / width_ms)
    seen = rows.select(*keys, "ts", "__id", rank.alias("rank"), stretch.alias("own"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    ahead = Window.partitionBy(*keys, "stretch").orderBy("ts").rangeBetween(0, width_ms - 1)
    best = seen.withColumn("best", F.min("rank").over(ahead)).where("stretch = own").select(*keys, "ts", "__id", "best", "rank.tie")
    best = saved(best, "windows")
    ids = P.chained(best, keys, [F.col("tie")], F.col("best.ts") + width_ms, block, pieces)
    chosen = best.join(ids.withColumnRenamed("__id", "__met"), F.col("__id") == F.col("__met"), "left_semi").select(F.col("best.id").alias("__id")).distinct()
    return _met(rows, chosen)


def spaced(df: DataFrame, gap_ms: int, keys: tuple[str, ...] = ("symbol", "side"), block: int = P.BLOCK, pieces: int | None = None) -> DataFrame:
    """Keeps each row that comes gap_ms or more after the last one kept."""
    rows = _numbered(df)
    return _met(rows, P.chained(rows, keys, [F.col("__id")], F.col("ts") + gap_ms, block, pieces))


def one_at_a_time(df: DataFrame, horizon_ms: int, keys: tuple[str, ...] = ("symbol",), block: int = P.BLOCK, pieces: int | None = None) -> DataFrame:
    """Keeps the events that begin while no kept one is open (sorted by ts and side); one without exit stays open for horizon_ms."""
    rows = _numbered(df)
    return _met(rows, P.chained(rows, keys, [F.col("side"), F.col("__id")], F.coalesce(F.col("outcome_ts"), F.col("ts") + horizon_ms), block, pieces))


def capped(df: DataFrame, most: int, most_a_side: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Keeps events while fewer than `most` (and of their side most_a_side) are open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "side"])
        open_, kept = [], []
        for t, side, end in zip(rows["ts"].to_numpy(np.int64), rows["side"], rows["outcome_ts"].to_numpy(np.int64), strict=True):
            open_ = [(e, s) for e, s in open_ if e > t]
            kept.append(len(open_) < most and sum(s == side for _, s in open_) < most_a_side)
            if kept[-1]:
                open_.append((int(end), side))
        return rows[np.array(kept, dtype=bool)]

    return _grouped(df, list(keys), run, "")


def best_schedule(df: DataFrame, weight: str, keys: tuple[str, ...] = ("symbol",), pieces: int | None = None) -> DataFrame:
    """Keeps the events [ts, outcome_ts] that don't overlap and have the greatest total weight.

    Sorted by end (then ts, side), each is taken only if that is better than all choices without it. A series is cut where
    no event is open, that is where one begins at or after the latest end of all before it: each stretch is solved by
    itself, and only a stretch of ever overlapping events is one group.
    """
    order = [F.col("ts"), F.col("outcome_ts"), F.col("side"), F.col("__id")]
    rows = P.earlier_max(P.pieced(_numbered(df), keys, order, pieces), keys, order, F.col("outcome_ts"), "__open")
    rows = rows.withColumn("__cut", F.when(F.col("ts") >= F.col("__open"), 1).otherwise(0))
    rows = P.prefixed(rows, keys, order, {"__cuts": F.col("__cut")}).withColumn("__stretch", F.col("__cuts") + F.col("__cut"))
    rows = rows.drop("__id", "__open", "__cut", "__cuts", "__piece")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["outcome_ts", "ts", "side"])
        starts, ends, w = (rows[c].to_numpy() for c in ("ts", "outcome_ts", weight))
        prior = [bisect_right(ends, s, hi=i) for i, s in enumerate(starts)]
        total, taken = [0.0], []
        for i, p in enumerate(prior):
            taken.append(w[i] + total[p] > total[i])
            total.append(w[i] + total[p] if taken[-1] else total[i])
        kept, i = [], len(taken)
        while i:
            if taken[i - 1]:
                kept.append(i - 1)
            i = prior[i - 1] if taken[i - 1] else i - 1
        return rows.iloc[kept[::-1]]

    return _grouped(rows, [*keys, "__stretch"], run, "").drop("__stretch")
