"""CUSUM events and first-touch labels over streams, with state and event-time timers.

Rows wait in state until the watermark has passed them and are then taken in order of time, so results don't depend on
how they were dealt to micro-batches and equal the batch operators' over all rows in time. State needs the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.labeling import horizon_ms, risk

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "symbol string, ts long, event int"
LABELS = "symbol string, ts long, side string, outcome string, outcome_ts long, preempted boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _rows(state) -> list[tuple]:
    return list(state.get()) if state.exists() else []


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class _Ordered(StatefulProcessor):
    """Keeps input rows until the watermark passes their time; `taken` then gets all of those."""

    columns: list[str]
    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wait, wakes = [], set()
        for part in rows:
            wait += [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in part[self.columns].itertuples(index=False)]
            wakes |= {int(part["ts"].max()), int(part["wake"].max())}
        if wait:
            self.waiting.appendList(wait)
        for at in wakes:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = _rows(self.waiting)
        due = [r for r in waiting if r[0] <= now]
        if due:
            _put(self.waiting, [r for r in waiting if r[0] > now])
        yield from self.taken(key[0], sorted(due, key=lambda r: r[:2]), now)

    def close(self) -> None:
        pass


class _Cusum(_Ordered):
    columns, schema = ["ts", "x", "h"], "ts long, x double, h double"

    def __init__(self, drift: float, min_gap: int):
        self.drift, self.min_gap = drift, min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", "up double, down double, since long")

    def taken(self, symbol: str, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        if not due:
            return
        up, down, since = self.sums.get() if self.sums.exists() else (0.0, 0.0, self.min_gap)
        hits = []
        for _, x, limit in due:
            v = np.nan if x is None else x
            up, down = max(0.0, up + v - self.drift), min(0.0, down + v + self.drift)
            hit = up > limit or down < -limit
            event = hit and since >= self.min_gap
            up, down = (0.0, 0.0) if hit else (up, down)
            since = 1 if event else since + 1
            hits.append(int(event))
        self.sums.update((up, down, since))
        yield pd.DataFrame({"symbol": symbol, "ts": [r[0] for r in due], "event": hits})


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)


def cusum(rows: DataFrame, x: str, threshold: str, late: str, drift: float = 0.0, min_gap: int = 0) -> DataFrame:
    """symbol, ts, event of a stream of (symbol, ts, x, threshold), as `sequential.cusum` gives them; rows later than `late` are dropped.

    State of a symbol: both sums, the rows since the last event, and the rows that the watermark hasn't passed.
    """
    plain = _timed(rows.select("symbol", "ts", F.col(x).cast("double").alias("x"), F.col(threshold).cast("double").alias("h")), late)
    use_rocksdb(rows.sparkSession)
    timed = plain.withColumn("wake", F.col("ts"))
    return timed.groupBy("symbol").transformWithStateInPandas(_Cusum(drift, min_gap), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


class _FirstTouch(_Ordered):
    columns = ["ts", "seq", "kind", "price", "side", "tp", "sl", "begins", "ends"]
    schema = "ts long, seq long, kind string, price double, side string, tp double, sl double, begins long, ends long"

    def __init__(self, keep_untouched: bool):
        self.keep_untouched = keep_untouched

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "ts long, side string, tp double, sl double, begins long, ends long, seen boolean")

    def taken(self, symbol: str, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        ticks = [r for r in due if r[2] == "tick"]
        held = _rows(self.open) + [(ts, side, tp, sl, begins, ends, False) for ts, _, kind, _, side, tp, sl, begins, ends in due if kind != "tick"]
        times, prices = np.array([r[0] for r in ticks], dtype=np.int64), np.array([r[3] for r in ticks])
        done, still = [], []
        for ts, side, tp, sl, begins, ends, seen in held:
            a, b = np.searchsorted(times, begins, "left"), np.searchsorted(times, ends, "right")
            here, seen = prices[a:b], seen or bool(b > a)
            won, lost = (here >= tp, here <= sl) if side == "long" else (here <= tp, here >= sl)
            hits = np.flatnonzero(won | lost)
            if len(hits):
                done.append((symbol, ts, side, "win" if won[hits[0]] else "loss", int(times[a + hits[0]]), False))
            elif ends <= now:
                done.append((symbol, ts, side, "timeout", ends, not seen and not self.keep_untouched))
            else:
                still.append((ts, side, tp, sl, begins, ends, seen))
        _put(self.open, still)
        if done:
            yield pd.DataFrame(done, columns=["symbol", "ts", "side", "outcome", "outcome_ts", "preempted"])


def first_touch(cands: DataFrame, ticks: DataFrame, late: str, r_mult: float = 5.0, hours: float = 480.0, epsilon_ms: int = 1, keep_untouched: bool = True) -> DataFrame:
    """Labels of a stream of candidates by a stream of ticks, as `labeling.first_touch` gives them; an outcome comes when the watermark passes it.

    State of a symbol: its open candidates, and the rows that the watermark hasn't passed. A tick closes candidates; a
    timer at the horizon's end times the others out.
    """
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    c = cands.withColumn("r", risk(cands))
    c = c.select("symbol", "ts", F.lit(0).cast("long").alias("seq"), F.lit("candidate").alias("kind"), F.lit(0.0).alias("price"), "side", (F.col("entry") + sign * r_mult * F.col("r")).alias("tp"), (F.col("entry") - sign * F.col("r")).alias("sl"),
                 (F.col("ts") + epsilon_ms).alias("begins"), (F.col("ts") + horizon_ms(hours)).alias("ends"))
    nothing = [F.lit("").alias("side"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("sl"), F.lit(0).cast("long").alias("begins"), F.col("ts").alias("ends")]
    t = ticks.where("price IS NOT NULL").select("symbol", "ts", "seq", F.lit("tick").alias("kind"), "price", *nothing)
    use_rocksdb(cands.sparkSession)
    both = _timed(c.unionByName(t), late).withColumn("wake", F.col("ends"))
    return both.groupBy("symbol").transformWithStateInPandas(_FirstTouch(keep_untouched), outputStructType=LABELS, outputMode="Append", timeMode="EventTime")
