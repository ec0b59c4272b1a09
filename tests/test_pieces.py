"""Sequential operators over series cut into many pieces and blocks, against plain loops over whole series."""

import random
from bisect import bisect_left

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, pieces, quantiles, sequential


def test_prefix_sums_and_maxima(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), t, rng.randrange(9)) for t in rng.sample(range(5_000), 600)]
    df = pieces.pieced(spark.createDataFrame(rows, "k string, t long, v long"), ["k"], [F.col("t")], 16)
    assert df.select("__piece").distinct().count() > 8
    got = pieces.prefixed(df, ["k"], [F.col("t")], {"before": F.col("v")}, totals=True)
    got = pieces.earlier_max(got, ["k"], [F.col("t")], F.col("v"), "top").collect()
    for r in got:
        earlier = [v for k, t, v in rows if k == r["k"] and t < r["t"]]
        assert (r["before"], r["top"]) == (sum(earlier), max(earlier, default=None))
        assert r["all_before"] == sum(v for k, _, v in rows if k == r["k"])


def test_ema_over_pieces(spark):
    rng = np.random.default_rng(6)
    parts = []
    for k, n in (("a", 3_000), ("b", 40), ("c", 1), ("d", 30)):
        x = rng.normal(size=n).round(3)
        x[rng.random(n) < 0.2] = np.nan
        if k in "ad":
            x[:25] = np.nan
        if k == "d":
            x[:] = np.nan
        parts.append(pd.DataFrame({"symbol": k, "ts": np.arange(n) * 60, "x": x}))
    every = pd.concat(parts)
    data = [(s, int(t), None if np.isnan(v) else float(v)) for s, t, v in every.itertuples(index=False)]
    got = sequential.ema(spark.createDataFrame(data, "symbol string, ts long, x double"), "x", 14, "e", pieces=24).toPandas().sort_values(["symbol", "ts"])
    for k, part in every.groupby("symbol"):
        want = part["x"].ewm(span=14, adjust=False, ignore_na=True).mean().ffill().to_numpy()
        np.testing.assert_allclose(got.loc[got["symbol"] == k, "e"].to_numpy(float), want, rtol=1e-9, atol=1e-12)
    assert list(got.columns) == ["symbol", "ts", "x", "e"]


def _busy(rows, free):
    kept, until = [], None
    for r in sorted(rows):
        if until is None or r[0] >= until:
            kept.append(r)
            until = free(r)
    return kept


def test_chain_of_a_hundred_thousand_rows(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("symbol"), (F.col("id") * 10).alias("ts"), F.lit("long").alias("side"), (F.col("id") * 10 + F.pmod(F.col("id") * 7919, F.lit(97))).alias("outcome_ts"))
    got = sorted(r["ts"] for r in sequential.one_at_a_time(df, 10, block=1_000, pieces=16).select("ts").collect())
    assert got == [t for t, _ in _busy([(i * 10, i * 10 + i * 7919 % 97) for i in range(n)], lambda r: r[1])]


@pytest.mark.parametrize("block", [3, 17, 1 << 16])
def test_schedules_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(s, t, rng.choice(["long", "short"]), rng.choice([None, t, t + rng.randrange(1, 60)])) for s in ("a", "b", None) for t in (rng.randrange(400) for _ in range(150))]
    df = spark.createDataFrame(rows, "symbol string, ts long, side string, outcome_ts long")
    busy = sequential.one_at_a_time(df, 25, block=block, pieces=5).collect()
    apart = sequential.spaced(df, 40, ("symbol", "side"), block, 5).collect()
    for s in ("a", "b", None):
        mine = [(t, side, t + 25 if e is None else e) for k, t, side, e in rows if k == s]
        times = [t for t, _, _ in _busy(mine, lambda r: r[2])]
        assert sorted(r["ts"] for r in busy if r["symbol"] == s)[:1] == times[:1]
        kept = sorted((r["ts"], r["side"], r["ts"] + 25 if r["outcome_ts"] is None else r["outcome_ts"]) for r in busy if r["symbol"] == s)
        assert all(a[2] <= b[0] for a, b in zip(kept, kept[1:]))
        for side in ("long", "short"):
            want = [t for (t,) in _busy([(t,) for t, x, _ in mine if x == side], lambda r: r[0] + 40)]
            assert sorted(r["ts"] for r in apart if r["symbol"] == s and r["side"] == side) == want


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_best_in_window_in_blocks(spark, block):
    rng = random.Random(8)
    rows = [("a", rng.choice(["long", "short"]), t, rng.choice([1.0, 2.0, None]), rng.choice([None, 0.1, 0.7])) for t in sorted(rng.randrange(900) for _ in range(200))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "symbol string, side string, ts long, eta double, atr_p double, bar_idx int")
    got = sorted(r["bar_idx"] for r in sequential.best_in_window(df, 50, block=block, pieces=6).collect())
    want = []
    for side in ("long", "short"):
        mine = [(t, np.inf if e is None else e, np.inf if p is None else -p, i) for i, (_, x, t, e, p) in enumerate(rows) if x == side]
        ts, at = [m[0] for m in mine], 0
        while at < len(mine):
            end = bisect_left(ts, ts[at] + 50)
            best = min(mine[at:end], key=lambda m: (m[1], m[2], m[0], m[3]))
            want.append(best[3])
            at = max(end, bisect_left(ts, best[0] + 50))
    assert got == sorted(set(want))


def test_best_schedule_in_stretches(spark):
    rng = random.Random(9)
    rows = [("a", t, rng.choice(["long", "short"]), t + rng.randrange(1, 60), float(rng.randrange(1, 9))) for t in (rng.randrange(20_000) for _ in range(500))]
    rows += rows[:5]
    got = sequential.best_schedule(spark.createDataFrame(rows, "symbol string, ts long, side string, outcome_ts long, w double"), "w", pieces=12)
    kept = sorted((r["ts"], r["outcome_ts"], r["w"]) for r in got.collect())
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
    ends = sorted(rows, key=lambda r: r[3])
    total = [0.0]
    for i, r in enumerate(ends):
        free = next((j for j in range(i, 0, -1) if ends[j - 1][3] <= r[1]), 0)
        total.append(max(total[-1], r[4] + total[free]))
    assert sum(w for *_, w in kept) == total[-1]


@pytest.mark.parametrize("few", [0, 20_000, 1 << 20])
def test_exact_quantiles_of_many_rows(spark, monkeypatch, few):
    """Series of 90,000 and of a few values, ties, nulls, NaN and infinities, against numpy."""
    monkeypatch.setattr(quantiles, "FEW", few)
    n = 90_000
    k = F.when(F.col("id") % 1000 < 3, F.lit(None).cast("string")).when(F.col("id") % 9000 == 5, F.lit("few")).otherwise(F.lit("many"))
    z = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    df = spark.range(n).select(
        k.alias("symbol"), F.when(F.col("id") % 11 == 0, None).otherwise(F.log(z + 0.001)).alias("x"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.floor(z * 40)).alias("tied"),
        F.when(F.col("id") % 50 == 0, float("nan")).when(F.col("id") % 51 == 0, float("-inf")).otherwise(z).alias("odd"), F.lit(None).cast("double").alias("none"),
    ).repartition(7)
    at, columns = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0], ["x", "tied", "odd", "none"]
    found = {r["symbol"]: r for r in quantiles.exact_quantiles(df, columns, at, ["symbol"]).collect()}
    rows = df.toPandas()
    assert set(found) == {None, "few", "many"}
    for symbol, part in ((s, rows[rows["symbol"].isna() if s is None else rows["symbol"] == s]) for s in found):
        for c in columns[:3]:
            got, values = found[symbol][f"q_{c}"], part[c].dropna().to_numpy(float)
            assert got[0] == values.min()
            np.testing.assert_allclose(got[1:], np.quantile(values, at[1:]), rtol=1e-12)
        assert found[symbol]["q_none"] is None
    whole = quantiles.exact_quantiles(df, ["x"], [0.25]).first()["q_x"]
    np.testing.assert_allclose(whole, [np.quantile(rows["x"].dropna(), 0.25)], rtol=1e-12)


def test_ranks_in_pieces(spark):
    rng = np.random.default_rng(12)
    rows = [(str(rng.choice(["a", "b", "c"])), i, None if rng.random() < 0.1 else float(rng.integers(0, 60)), bool(rng.random() < 0.5)) for i in range(900)]
    rows = [(s, i, x, t and s != "c") for s, i, x, t in rows]
    got = features.train_ranks(spark.createDataFrame(rows, "symbol string, ts long, x double, train boolean"), {"x": "p"}, "train", pieces=9).collect()
    assert len(got) == len(rows)
    for r in got:
        known = [x for s, _, x, t in rows if s == r["symbol"] and t and x is not None]
        want = None if not known else 100.0 if r["x"] is None else 100.0 * sum(x <= r["x"] for x in known) / len(known)
        assert r["p"] == pytest.approx(want)
