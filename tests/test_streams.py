"""Streams with state against the batch operators: rows dealt anyhow to micro-batches, and a restart in between."""

import random

import numpy as np
import pytest

from tidemark.operators import labeling, sequential
from tidemark.streaming import stateful
from tidemark.streaming.ticks import TICK_SCHEMA

FAR = 10_000_000_000


def _files(spark, rows, schema, path, last):
    """Rows in shuffled files of their stretch of time, then two far ahead, which move the watermark past all."""
    rng = random.Random(3)
    rows = sorted(rows, key=lambda r: r[1])
    for i in range(0, len(rows), 80):
        part = rows[i : i + 80]
        rng.shuffle(part)
        for k in range(2):
            spark.createDataFrame(part[k::2], schema).coalesce(1).write.mode("append").parquet(path)
    if last:
        for k in range(2):
            spark.createDataFrame([last[k]], schema).coalesce(1).write.mode("append").parquet(path)


def _run(stream, out, checkpoint):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(240)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_streamed_cusum(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(7)
    schema = "symbol string, ts long, x double, h double"
    rows = [(s, int(t) * 1000, float(x), 1.2) for s in ("a", "b") for t, x in zip(rng.permutation(4_000)[:250], rng.normal(size=250), strict=True)]
    half = sorted(rows, key=lambda r: r[1])
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    stream = lambda: stateful.cusum(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path), "x", "h", "10 minutes", min_gap=3)
    _files(spark, half[:240], schema, path, None)
    _run(stream(), out, checkpoint)
    _files(spark, half[240:], schema, path, [("far", FAR, 0.0, 1.0), ("far", FAR + 10**9, 0.0, 1.0)])
    _run(stream(), out, checkpoint)  # a restart: state and place come from the checkpoint
    got = sorted(map(tuple, spark.read.schema(stateful.EVENTS).parquet(out).where("symbol != 'far'").collect()))
    want = sequential.cusum(spark.createDataFrame(rows, schema), "x", "h", min_gap=3).select("symbol", "ts", "event").collect()
    assert got == sorted(map(tuple, want)) and sum(e for *_, e in got) > 20


def test_streamed_first_touch(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(8)
    cand_schema = "symbol string, ts long, side string, entry double, level double, risk_dist double"
    ticks = [(s, int(t) * 1000, i, 100 + float(p)) for s in ("a", "b") for i, (t, p) in enumerate(zip(rng.integers(0, 9_000, 400), rng.normal(size=400).cumsum() * 0.3, strict=True))]
    cands = [(s, int(t) * 1000, side, 100.0 + float(d), 99.0, 1.0) for s in ("a", "b", "quiet") for t, d in zip(rng.permutation(8_000)[:40], rng.normal(size=40), strict=True) for side in ("long", "short")]
    c_path, t_path, out, checkpoint = (str(tmp_path / x) for x in ("c", "t", "out", "cp"))
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    stream = lambda: stateful.first_touch(read(cand_schema, c_path), read(TICK_SCHEMA, t_path), "3 hours", r_mult=2.0, hours=0.3, keep_untouched=False)
    cut = 4_000_000
    _files(spark, [r for r in cands if r[1] < cut], cand_schema, c_path, None)
    _files(spark, [r for r in ticks if r[1] < cut], TICK_SCHEMA, t_path, None)
    _run(stream(), out, checkpoint)
    _files(spark, [r for r in cands if r[1] >= cut], cand_schema, c_path, None)
    _files(spark, [r for r in ticks if r[1] >= cut], TICK_SCHEMA, t_path, [("far", FAR + k * 10**9, 0, 1.0) for k in range(2)])
    _run(stream(), out, checkpoint)
    got = sorted(map(tuple, spark.read.schema(stateful.LABELS).parquet(out).where("symbol != 'far'").collect()))
    batch = labeling.first_touch(spark.createDataFrame(cands, cand_schema), spark.createDataFrame(ticks, TICK_SCHEMA), r_mult=2.0, hours=0.3, keep_untouched=False)
    want = batch.select("symbol", "ts", "side", "outcome", "outcome_ts", "preempted").collect()
    assert got == sorted(map(tuple, want))
    assert {o for _, _, _, o, *_ in got} == {"win", "loss", "timeout"} and any(p for *_, p in got)
