"""First-touch labels: a range join of candidates and ticks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import safe_div
from tidemark.operators import pieces as P
from tidemark.sources.staging import saved


def risk(df: DataFrame, min_risk_frac: float = 0.001, stop_band: float = 0.05) -> Column:
    """risk_dist, else eta * atr, else atr, else |entry - level|; at least the floors in ATRs, and 1e-6 at last."""
    positive = lambda c: F.when(c > 0, c)
    have = set(df.columns)
    options = [positive(F.col("risk_dist"))] if "risk_dist" in have else []
    options += [positive(F.col("eta") * F.col("atr"))] if {"eta", "atr"} <= have else []
    options += [positive(F.col("atr"))] if "atr" in have else []
    options += [positive(F.abs(F.col("entry") - F.col("level")))] if "level" in have else []
    floor = F.coalesce(F.col("atr"), F.lit(0.0)) * max(min_risk_frac, stop_band) if "atr" in have else F.lit(0.0)
    r = F.greatest(F.coalesce(*options, F.lit(0.0)), floor)
    return F.when(r > 0, r).otherwise(1e-6)


def horizon_ms(hours: float, eta: Column | None = None, base_eta: float = 2.5, clamp: tuple[float, float] = (0.75, 10.0)) -> Column:
    """The horizon, scaled by eta / base_eta within the clamp; half to even, at least 1 ms."""
    scale = F.lit(1.0) if eta is None else F.least(F.lit(clamp[1]), F.greatest(F.lit(clamp[0]), F.coalesce(eta / base_eta, F.lit(1.0))))
    return F.greatest(F.lit(1), F.rint(F.lit(hours * 3_600_000) * scale).cast("long"))


def _bucketed(ticks: DataFrame, width: int) -> DataFrame:
    """Ticks with their time and series as __t and __s, and their bucket __b."""
    return ticks.select(F.col("symbol").alias("__s"), F.col("ts").alias("__t"), *[x for x in ticks.columns if x not in ("symbol", "ts")], F.floor(F.col("ts") / width).alias("__b"))


def _looked(c: DataFrame, bucketed: DataFrame, width: int, can: Column, keys: list[str], parts: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Candidates (with __from and __to), once for each bucket of their windows (and part of it) to look into: those where `can` holds for the lowest and highest price (__lo, __hi) and those at the ends; keys of candidates that have a tick in a bucket wholly inside (__seen)."""
    spans = c.select("*", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor(F.col("__to") / width))).alias("__bucket"))
    ranges = bucketed.groupBy(F.col("__s").alias("__rs"), F.col("__b").alias("__rb"), *[F.col(x).alias(f"__in{x}") for x in parts]).agg(F.min("price").alias("__lo"), F.max("price").alias("__hi"), F.min("__t").alias("__t0"), F.max("__t").alias("__t1"))
    met = spans.join(ranges, (F.col("symbol") == F.col("__rs")) & (F.col("__bucket") == F.col("__rb")) & (F.col("__t1") >= F.col("__from")) & (F.col("__t0") <= F.col("__to")))
    # A bucket wholly inside the window shows by itself that the candidate has ticks; those at its ends are looked into.
    inside = (F.col("__t0") >= F.col("__from")) & (F.col("__t1") <= F.col("__to"))
    met = met.withColumns({"__can": can, "__inside": inside})
    seen = met.where("__inside").groupBy(*keys).agg(F.lit(True).alias("__seen"))
    return met.where("__can OR NOT __inside").select(*c.columns, "__bucket", *[f"__in{x}" for x in parts]), seen


def _in_window(c: DataFrame, ticks: DataFrame, width: int, can: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The candidates to look at, each with the ticks (as __t and their other columns) of its window and bucket; and __seen."""
    bucketed = _bucketed(ticks, width)
    look, seen = _looked(c, bucketed, width, can, keys)
    return look.join(bucketed, (F.col("symbol") == F.col("__s")) & (F.col("__bucket") == F.col("__b")) & F.col("__t").between(F.col("__from"), F.col("__to"))), seen


def first_touch(cands: DataFrame, ticks: DataFrame, r_mult: float = 5.0, hours: float = 480.0, epsilon_ms: int = 1, keep_untouched: bool = True, bucket_ms: int | None = None, scale_by_eta: bool = False) -> DataFrame:
    """outcome (win, loss, timeout), outcome_ts and preempted of each candidate (symbol, ts, side, entry, level, risk_dist, ...).

    Within [ts + epsilon, ts + horizon] the first tick at entry +- r_mult * R wins, at entry -+ R loses; one that does
    both wins. Ticks of one time are ordered by seq. Neither: timeout at the horizon's end. No tick at all: timeout,
    preempted unless keep_untouched.

    Candidates meet the ticks of their window bucket by bucket: first only the lowest and highest price of each
    bucket, then the ticks of those buckets alone in which a price can be crossed. So ticks are joined by key and
    read where something may happen, however long the horizon is.
    """
    width = bucket_ms or int(hours * 3_600_000 // 24) or 1
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    eta = F.col("eta") if scale_by_eta and "eta" in cands.columns else None
    c = cands.withColumn("__r", risk(cands)).withColumns({"__tp": F.col("entry") + sign * r_mult * F.col("__r"), "__sl": F.col("entry") - sign * F.col("__r")})
    c = c.withColumns({"__from": F.col("ts") + epsilon_ms, "__to": F.col("ts") + horizon_ms(hours, eta)})
    keys = ["symbol", "ts", "side"]
    long = F.col("side") == "long"
    can = F.when(long, (F.col("__hi") >= F.col("__tp")) | (F.col("__lo") <= F.col("__sl"))).otherwise((F.col("__lo") <= F.col("__tp")) | (F.col("__hi") >= F.col("__sl")))
    joined, seen = _in_window(c.select(*keys, "__tp", "__sl", "__from", "__to"), ticks.select("symbol", "ts", "seq", "price"), width, can, keys)
    at = F.struct(F.col("__t").alias("t"), "seq")
    hit_tp = F.when(long, F.col("price") >= F.col("__tp")).otherwise(F.col("price") <= F.col("__tp"))
    hit_sl = F.when(long, F.col("price") <= F.col("__sl")).otherwise(F.col("price") >= F.col("__sl"))
    touches = joined.groupBy(*keys).agg(F.min(F.when(hit_tp, at)).alias("__win"), F.min(F.when(hit_sl, at)).alias("__loss"), F.count("*").alias("__n"))
    out = c.join(touches, keys, "left").join(seen, keys, "left")
    win = F.col("__win").isNotNull() & (F.col("__loss").isNull() | (F.col("__win") <= F.col("__loss")))
    outcome = F.when(win, "win").when(F.col("__loss").isNotNull(), "loss").otherwise("timeout")
    empty = F.col("__n").isNull() & F.col("__seen").isNull()
    when = F.when(win, F.col("__win.t")).when(F.col("__loss").isNotNull(), F.col("__loss.t")).otherwise(F.col("__to"))
    out = out.withColumns({"outcome": outcome, "outcome_ts": when, "preempted": empty & F.lit(not keep_untouched)})
    return out.withColumn("risk_dist", F.col("__r")).drop("__r", "__tp", "__sl", "__from", "__to", "__win", "__loss", "__n", "__seen")


_TOUCHES = "__a_ix long, __a_t long, __b_ix long, __b_t long, __r_ix long, __r_end long, __r_t0 long, __r_t1 long"


def _touches(keys: list[str], consec_ticks: int, dwell_ms: int):
    def touches(cands: pd.DataFrame, ticks: pd.DataFrame) -> pd.DataFrame:
        """For each candidate that has ticks here, number and time of the first at one R and at the target (number -1: none) and the runs beyond its
        stop, a row each: those at the ends of its ticks, which may go on elsewhere, and the first that counts by itself."""
        ticks = ticks.sort_values("__ix")
        t, ix, price = ticks["__t"].to_numpy(np.int64), ticks["__ix"].to_numpy(np.int64), ticks["price"].to_numpy(float)
        place, found = [], []
        windows = zip(np.searchsorted(t, cands["__from"]), np.searchsorted(t, cands["__to"], "right"), cands["side"] == "long", *(cands[x].to_numpy(float) for x in ("__r1", "__tp", "__stop")), strict=True)
        for k, (a, b, long, r1, tp, stop) in enumerate(windows):
            if a == b:
                continue
            p = price[a:b]
            firsts = []
            for hit in ((p >= r1, p >= tp) if long else (p <= r1, p <= tp)):
                at = a + hit.argmax()
                firsts += [ix[at], t[at]] if hit.any() else [-1, 0]
            edges = a + np.flatnonzero(np.diff(p < stop if long else p > stop, prepend=False, append=False))
            begin, end = edges[::2], edges[1::2] - 1
            counts = (end - begin + 1 >= consec_ticks) & (t[end] - t[begin] >= dwell_ms)
            kept = (begin == a) | (end == b - 1)
            if counts.any():
                kept[counts.argmax()] = True
            rows = [[*firsts, ix[i], ix[j], t[i], t[j]] for i, j in zip(begin[kept], end[kept], strict=True)] or [[*firsts, -1, -1, 0, 0]]
            found += rows
            place += [k] * len(rows)
        out = pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 8), columns=[x.split()[0] for x in _TOUCHES.split(", ")])
        return pd.concat([cands[keys].iloc[place].reset_index(drop=True), out], axis=1)

    return touches


def stop_band(
    cands: DataFrame, ticks: DataFrame, r_mult: float = 5.0, hours: float = 480.0, quick_hours: float = 2.0, stop_band_atr: float = 0.05, consec_ticks: int = 1, dwell_ms: int = 0, epsilon_ms: int = 1,
    keep_untouched: bool = True, bucket_ms: int | None = None, pieces: int | None = None, block: int = P.BLOCK,
) -> DataFrame:
    """outcome, outcome_ts, r1_ts, tp_ts and preempted of each candidate by the older rules of stop band and quick ignition.

    A candidate loses at the first tick of the first run of successive ticks beyond its level by more than stop_band_atr
    ATRs which has consec_ticks ticks or more and lasts dwell_ms or longer, unless the target came before. It wins at the
    target (r_mult * R) only if one R was reached within quick_hours (r1_ts). Else it times out at the horizon's end.

    Ticks are numbered along their series, in pieces; successive ones have successive numbers. As in first_touch, candidates meet
    only buckets whose prices can matter, here by groups: a bucket's ticks, `block` at most, and the candidates that look at it.
    A candidate takes from a group its first touches and up to three runs, so no pair of candidate and tick is ever shuffled; runs
    that go on from group to group are put together by their numbers.
    """
    width = bucket_ms or int(hours * 3_600_000 // 24) or 1
    order, keys = [F.col("ts"), F.col("seq")], ["symbol", "ts", "side"]
    numbered = P.prefixed(P.pieced(ticks.select("symbol", "ts", "seq", "price"), ["symbol"], order, pieces), ["symbol"], order, {"__ix": F.lit(1)})
    numbered = saved(numbered.select("symbol", "ts", "price", F.col("__ix").cast("long"), F.floor(F.col("__ix") / block).alias("__part")), "numbered")
    sign, long = F.when(F.col("side") == "long", 1).otherwise(-1), F.col("side") == "long"
    c = cands.withColumn("__r", risk(cands, stop_band=0.0))
    c = c.withColumns({"__r1": F.col("entry") + sign * F.col("__r"), "__tp": F.col("entry") + sign * r_mult * F.col("__r"), "__stop": F.col("level") - sign * stop_band_atr * F.coalesce("atr", F.lit(0.0))})
    c = c.withColumns({"__from": F.col("ts") + epsilon_ms, "__to": F.col("ts") + horizon_ms(hours), "__quick": F.col("ts") + horizon_ms(quick_hours)})
    can = F.when(long, (F.col("__hi") >= F.col("__r1")) | (F.col("__lo") < F.col("__stop"))).otherwise((F.col("__lo") <= F.col("__r1")) | (F.col("__hi") > F.col("__stop")))
    bucketed = _bucketed(numbered, width)
    look, seen = _looked(c.select(*keys, "__r1", "__tp", "__stop", "__from", "__to"), bucketed, width, can, keys, ("__part",))
    prices = bucketed.withColumn("price", F.nanvl("price", F.lit(float("inf"))))  # NaN is above all, null isn't compared
    types = ", ".join(f"{k} {c.schema[k].dataType.simpleString()}" for k in keys)
    met = look.groupBy("symbol", "__bucket", "__in__part").cogroup(prices.groupBy("__s", "__b", "__part"))
    met = saved(met.applyInPandas(_touches(keys, consec_ticks, dwell_ms), f"{types}, {_TOUCHES}"), "touches")
    at = lambda x, t: F.min(F.when(F.col(x) >= 0, F.struct(F.col(x).alias("ix"), F.col(t).alias("t"))))
    firsts = met.groupBy(*keys).agg(at("__a_ix", "__a_t").alias("__a"), at("__b_ix", "__b_t").alias("__b"), F.count("*").alias("__n"))
    along = Window.partitionBy(*keys).orderBy("__r_ix")
    runs = met.where("__r_ix >= 0").withColumn("__new", F.when(F.col("__r_ix") == F.lag("__r_end").over(along) + 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(along))
    runs = runs.groupBy(*keys, "__run").agg(F.sum(F.col("__r_end") - F.col("__r_ix") + 1).alias("__m"), at("__r_ix", "__r_t0").alias("__at"), (F.max("__r_t1") - F.min("__r_t0")).alias("__lasts"))
    runs = runs.where((F.col("__m") >= consec_ticks) & (F.col("__lasts") >= dwell_ms))
    out = c.join(firsts, keys, "left").join(runs.groupBy(*keys).agg(F.min("__at").alias("__v")), keys, "left").join(seen, keys, "left")
    lost = F.col("__v").isNotNull() & (F.col("__b").isNull() | (F.col("__v.ix") < F.col("__b.ix")))
    lit = ~lost & F.coalesce(F.col("__a.t") <= F.col("__quick"), F.lit(False))
    won = lit & F.col("__b").isNotNull()
    out = out.withColumns({
        "outcome": F.when(lost, "loss").when(won, "win").otherwise("timeout"), "outcome_ts": F.when(lost, F.col("__v.t")).when(won, F.col("__b.t")).otherwise(F.col("__to")),
        "r1_ts": F.when(lit, F.col("__a.t")), "tp_ts": F.when(won, F.col("__b.t")), "preempted": F.col("__n").isNull() & F.col("__seen").isNull() & F.lit(not keep_untouched), "risk_dist": F.col("__r"),
    })
    return out.drop("__r", "__r1", "__tp", "__stop", "__from", "__to", "__quick", "__a", "__b", "__n", "__v", "__seen")


def preempted_while_busy(labels: DataFrame, policy: str = "quick", quick_hours: float = 2.0, keys: tuple[str, ...] = ("symbol",), block: int = P.BLOCK, pieces: int | None = None) -> DataFrame:
    """Labels where candidates that come while an earlier one is busy time out at once, preempted (sorted by ts and side).

    Busy until: the exit (policy to_exit); else the quick deadline or, if later, the target of a win. A busy candidate's own
    label plays no part, so those that aren't are a chain of successors (see `pieces.chained`).
    """
    rows = saved(labels.withColumn("__id", F.monotonically_increasing_id()), "labels")
    quick = F.col("ts") + horizon_ms(quick_hours)
    until = F.col("outcome_ts") if policy == "to_exit" else F.greatest(quick, F.when(F.col("outcome") == "win", F.col("tp_ts")))
    free = P.chained(rows, keys, [F.col("side"), F.col("__id")], until, block, pieces).select(F.col("__id").alias("__free"))
    busy = F.col("__free").isNull()
    out = rows.join(free, F.col("__id") == F.col("__free"), "left").withColumns({"__busy": busy})
    none = {x: F.when(~F.col("__busy"), F.col(x)) for x in ("r1_ts", "tp_ts")}
    changed = {"outcome": F.when(F.col("__busy"), "timeout").otherwise(F.col("outcome")), "outcome_ts": F.when(F.col("__busy"), F.col("ts")).otherwise(F.col("outcome_ts")), "preempted": F.col("__busy") | F.col("preempted")}
    return out.withColumns(changed | none).drop("__id", "__free", "__busy")


def unlabelled(cands: DataFrame) -> DataFrame:
    """The fixed event columns for candidates of which no tick file exists: all time out at once."""
    return cands.withColumns({"outcome": F.lit("timeout"), "outcome_ts": F.col("ts"), "preempted": F.lit(False)})


def r_multiple(df: DataFrame, r_mult: float) -> DataFrame:
    """Adds R_gross: r_mult for a win, -1 for a loss, 0 for a timeout."""
    return df.withColumn("R_gross", F.when(F.col("outcome") == "win", float(r_mult)).when(F.col("outcome") == "loss", -1.0).otherwise(0.0))


def costs(df: DataFrame, maker_bps: float = 1.0, taker_bps: float = 5.0, entry_is_maker: bool = False, exit_is_maker: bool = True, funding_per_hour: float = 0.0001, funding_sign: float = 1.0, compat: bool = False, roundtrip_bps: float = 0.0) -> DataFrame:
    """Adds R_costs and R: fees and funding in units of risk, by the position's leverage entry / risk_dist.

    compat: hours as milliseconds / 3600, a thousand times too long, as older runs had them. roundtrip_bps: if above 0,
    the fee of entry and exit together.
    """
    bps = roundtrip_bps if roundtrip_bps > 0 else (maker_bps if entry_is_maker else taker_bps) + (maker_bps if exit_is_maker else taker_bps)
    leverage = safe_div(F.col("entry"), F.col("risk_dist"))
    hours = (F.col("outcome_ts") - F.col("ts")) / (3600 if compat else 3_600_000)
    cost = leverage * (bps / 10_000) + leverage * funding_per_hour * funding_sign * F.greatest(hours, F.lit(0.0))
    return df.withColumn("R_costs", cost).withColumn("R", F.col("R_gross") - F.col("R_costs"))
