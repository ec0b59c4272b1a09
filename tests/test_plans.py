"""A small walk-forward run from files, and streamed bars against batch bars."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, gate
from tidemark.plans import reports, walkforward
from tidemark.sources import artifacts, series
from tidemark.streaming import ticks as stream


def test_walkforward_from_files(spark, tmp_path):
    rng, price = random.Random(1), 100.0
    for m, days in ((1, 31), (2, 29), (3, 31)):
        start = 1704067200000 + sum((31, 29, 31)[: m - 1]) * 86_400_000
        bars, ticks = ["ts,open,high,low,close"], ["ts,price"]
        for h in range(days * 24):
            ts = start + h * 3_600_000
            path = [price := price * (1 + rng.gauss(0, 0.004)) for _ in range(3)]
            bars.append(f"{ts},{path[0]},{max(path)},{min(path)},{path[-1]}")
            ticks += [f"{ts + 1200_000 * i},{p}" for i, p in enumerate(path)]
        (tmp_path / f"S-2024-0{m}.csv").write_text("\n".join(bars))
        (tmp_path / f"S-t-2024-0{m}.csv").write_text("\n".join(ticks))
    cfg = {
        "io": {"outputs_root": str(tmp_path / "out")},
        "data": {"symbols": ["S"], "bars_dir": str(tmp_path), "ticks_dir": str(tmp_path), "file_patterns": {"bars": "{SYMBOL}-{YYYY}-{MM}.csv", "ticks": "{SYMBOL}-t-{YYYY}-{MM}.csv"}, "months": {"start": "2024-01", "end": "2024-03"}},
        "walkforward": {"train_months": 2, "test_months": 1}, "features": {"age": {"enabled": False}, "nonlinear": {"enabled": False}},
        "candidates": {"blind": {"thinning": {"params": {"ret_lookback": 48, "k_sigma": 1.0}}}}, "labels": {"r_mult": 1.5, "horizon_hours": 48, "eta_atr": 2.0, "quick_ignition_hours": 2},
        "mining": {"rules": {"min_support": 2, "min_months": 1, "min_wins": 1}}, "gate": {"target_ppv_lcb": 0.1},
    }
    got = walkforward.run(spark, cfg, ("features", "candidates", "labels"))
    assert len(got) == 1 and got[0]["features"] == 91 * 24 and 0 < got[0]["candidates"] == got[0]["labels"]
    assert walkforward.run(spark, cfg, ("labels",))[0]["labels"] == got[0]["labels"]  # read back, not run again
    with pytest.raises(ValueError, match="data.months.end"):
        walkforward.validated({**cfg, "data": {**cfg["data"], "months": {"start": "2024-01"}}})


def test_rules_use_binned_counters(spark, tmp_path):
    rng = random.Random(4)
    rows = [("S", i, "long", f"2024-0{1 + i % 3}", rng.randrange(3), rng.choice([None, *map(float, range(40))]), rng.choice([0.0] * 5 + [0.25, 0.5, 1.0]), rng.choice(["win", "loss"]), i % 11 == 0) for i in range(400)]
    names = ["qbin_a", "since_lowbin_a", "occ_lowbin_a_W60"]
    df = spark.createDataFrame(rows, f"symbol string, ts long, side string, ym string, {names[0]} int, {names[1]} double, {names[2]} float, outcome string, preempted boolean")
    df.write.parquet(str(tmp_path / "S" / "fold_0" / "labels.parquet"))
    cfg = {"io": {"outputs_root": str(tmp_path)}, "features": {"age": {"n_bins_feature": 4}}, "mining": {"rules": {"min_support": 1, "min_months": 1, "min_wins": 1, "max_terms": 1}}}
    fold = walkforward.Fold(spark, cfg, "S", 0, ["2024-01", "2024-02"], ["2024-03"])
    want, bins = {}, {}
    train = [r for r in rows if r[3] != "2024-03" and not r[8]]
    for k, name in ((5, names[1]), (6, names[2])):
        edges = np.quantile([r[k] for r in train if r[k] is not None], [0.25, 0.5, 0.75]).tolist()
        for i in (1, 2):
            edges[i] = edges[i] if edges[i] > edges[i - 1] else edges[i - 1] + 1e-12
        bins[name] = {r[1]: None if r[k] is None else sum(e <= r[k] for e in edges) for r in rows}
        for r in train:
            if r[k] is not None:
                at = want.setdefault(f"B_{name}=={bins[name][r[1]]}", [0, 0])
                at[r[7] == "loss"] += 1
    got = {r["rule_id"]: [r["wins"], r["losses"]] for r in fold.table("rules").collect()}
    assert {k: v for k, v in got.items() if k.startswith("B_")} == {k: v for k, v in want.items() if v[0]} and any(k.startswith("qbin_a==") for k in got)
    for name, by in bins.items():
        assert {r["ts"]: r[f"B_{name}"] for r in fold._events().collect()} == by
    assert fold._literals(fold._events()) == ["qbin_a", "B_since_lowbin_a", "B_occ_lowbin_a_W60"]


def test_gate_is_chosen_on_held_out_months(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.randrange(3), rng.randrange(2)
        month, outcome = 1 + i % 4, "win" if rng.random() < (0.8 if a == 2 else 0.2) else rng.choice(["loss", "loss", "timeout"])
        ts = 1704067200000 + month * 31 * 86_400_000 + i * 3_600_000
        rows.append(("S", ts, "long", f"2024-0{month}", a, b, 100.0, 99.0, 1.0, outcome, ts + 1000, 101.0, False))
    schema = "symbol string, ts long, side string, ym string, qbin_a int, qbin_b int, entry double, level double, risk_dist double, outcome string, outcome_ts long, exit_price double, preempted boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "S" / "fold_0" / "labels.parquet"))
    cfg = {"io": {"outputs_root": str(tmp_path)}, "labels": {"horizon_hours": 1, "r_mult": 1.0}, "gate": {"target_ppv_lcb": 0.5}, "mining": {"rules": {"min_support": 5, "min_months": 1, "min_wins": 1}}}
    seen, months = {}, lambda df: {r["ym"] for r in df.select("ym").distinct().collect()}
    fit, calibrated, threshold = gate.fit, gate.calibrated, evaluate.threshold
    monkeypatch.setattr(gate, "fit", lambda df, *args, validation=None, **kw: seen.update(fit=months(df), validation=validation and months(validation)) or fit(df, *args, validation=validation, grid=(1.0,), **kw))
    monkeypatch.setattr(gate, "calibrated", lambda df, *args: seen.update(calibrated=months(df)) or calibrated(df, *args))
    monkeypatch.setattr(evaluate, "threshold", lambda df, *args: seen.update(threshold=months(df)) or threshold(df, *args))
    fold = walkforward.Fold(spark, cfg, "S", 0, ["2024-01", "2024-02", "2024-03"], ["2024-04"])
    trades = fold.table("trades").collect()
    assert seen == {"fit": {"2024-01", "2024-02"}, "calibrated": {"2024-01", "2024-02"}, "validation": {"2024-03"}, "threshold": {"2024-03"}}
    rules = sorted((r for r in fold.table("rules").collect() if r["precision_lcb"] >= r["base_p"]), key=lambda r: (-r["precision_lcb"], -r["support_n"], r["rule_id"]))
    assert rules and trades and {r["ym"] for r in trades} == {"2024-04"}
    for t in trades:
        held = [r["rule_id"] for r in rules if all(t[c] == int(v) for c, v in (x.split("==") for x in r["rule_id"].split(" & ")))]
        assert t["rule_id"] == (held[0] if held else None)
    assert {t["rule_id"] for t in trades} != {None}
    assert reports.truth(fold.table("rules"), fold.table("trades")).where("wins + losses > 0").count() > 0
    decided = fold.table("decided").collect()
    found = fold.report()
    assert artifacts.read_json(spark, f"{tmp_path}/S/fold_0/simulation.json")["decided"]["entries"] == found["decided"]["entries"] == sum(r["enter"] for r in decided)
    assert found["decided"]["n"] == len(decided) == 150 and found["scheduled"]["entries"] == len(trades)
    assert found["scheduled"]["wins"] == sum(t["outcome"] == "win" for t in trades) and found["net_R_after_costs"] == pytest.approx(sum(t["R"] for t in trades))
    assert found["parity"]["mismatches"] == sum(r["enter"] for r in decided) - len(trades)
    marks = artifacts.read_json(spark, f"{tmp_path}/S/fold_0/fingerprint.json")
    assert marks["tables"]["trades"]["rows"] == len(trades) and len(marks["config"]) == 64
    assert not fold.few_resolved()
    one = walkforward.Fold(spark, cfg, "S", 0, ["2024-03"], ["2024-04"])
    events = one._training(fold._events())
    assert [x.count() for x in one._split(events)] == [events.count()] * 2  # one month: both parts are all rows


def test_small_samples_and_loser_options(spark, tmp_path):
    rng = random.Random(12)
    rows = [("S", i, "long", f"2024-0{1 + i % 2}", rng.randrange(2), "win" if rng.random() < 0.5 else "loss", False) for i in range(120)]
    spark.createDataFrame(rows, "symbol string, ts long, side string, ym string, qbin_a int, outcome string, preempted boolean").write.parquet(str(tmp_path / "S" / "fold_0" / "labels.parquet"))
    spec = {"min_support_frac": 0.25, "min_months": 5, "min_wins": 40, "max_terms": 1, "fdr": {"enabled": True, "alpha": 1e-9}, "loser_top_k": 1, "loser_max_precision_ucb": 1.1, "loser_min_resolve_frac": 0.0, "loser_min_months": 1}
    cfg = {"io": {"outputs_root": str(tmp_path)}, "mining": {"rules": spec}, "loser_mask": {"min_support": 1}}
    fold = walkforward.Fold(spark, cfg, "S", 0, ["2024-01", "2024-02"], [])
    rules = fold.table("rules").collect()
    assert fold.few_resolved() and {r["rule_id"] for r in rules} == {"qbin_a==0", "qbin_a==1"}  # neither months, wins nor the false discovery rate reject any
    assert all(r["support_n"] >= 30 for r in rules)
    worst = min(rules, key=lambda r: (r["precision_ucb"], -r["support_n"], r["rule_id"]))["rule_id"]
    assert fold._losers(fold.table("rules")) == [[("qbin_a", int(worst[-1]))]]
    assert artifacts.read_json(spark, f"{tmp_path}/S/fold_0/loser_mask.json") == [[{"col": "qbin_a", "val": int(worst[-1])}]]
    spec["mine_losers"] = False
    assert fold._losers(fold.table("rules")) == []


def test_gate_learns_and_calibrates(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(2)) for i in range(400)]
    rows = [(i, a, b, int(rng.random() < (0.85 if a == 2 else 0.2)), False) for i, a, b in rows]
    df = spark.createDataFrame(rows, "ts long, qbin_a int, qbin_b int, y int, preempted boolean")
    model = gate.fit(df, "y", ["qbin_a", "qbin_b"], grid=(1.0,))
    scored = gate.scored(gate.codes(df, ["qbin_a", "qbin_b"]), model)
    p = scored.withColumn("p_win", gate.probability(gate.calibrated(scored, "y")))
    by = {r["qbin_a"]: r["p"] for r in p.groupBy("qbin_a").agg(F.avg("p_win").alias("p")).collect()}
    assert by[2] > 0.7 and by[0] < 0.35
    tau = evaluate.threshold(p, "p_win", "y", 0.6, 0.02).first()
    assert tau["ppv_lcb"] >= 0.6
    out = gate.entered(p, tau["tau"], gate.loser_groups([{"rule_id": "qbin_b==1", "support_n": 50}]))
    assert out.where("enter AND qbin_b = 1").count() == 0 < out.where("enter").count()


def test_streamed_bars(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted([("s", 1704067200000 + rng.randrange(6 * 3_600_000), i, rng.random()) for i in range(300)], key=lambda r: r[1])
    df = spark.createDataFrame([*rows, ("s", 1704067200000 + 9 * 3_600_000, 999, 1.0)], stream.TICK_SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.write_bars(stream.bars(stream.tick_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = series.bars_from_ticks(df, 3_600_000).where("ts < 1704067200000 + 6 * 3600000")
    key = lambda t: sorted(map(tuple, t.select("symbol", "ts", "open", "high", "low", "close", "n_ticks").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)


def test_crosses_by_their_own_ranking(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), rng.randrange(3), f"2024-0{1 + i % 3}") for i in range(900)]
    rows = [(i, a, b, ym, int(rng.random() < (0.9 if a == 2 and b == 2 else 0.2))) for i, a, b, ym in rows]
    df = spark.createDataFrame(rows, "ts long, qbin_a int, q_b int, ym string, y int")
    out = gate.curated(df, [("qbin_a:high", "b:top?"), ("qbin_a:low2", "b:eq1"), ("missing:high", "b")])
    assert [c for c in out.columns if c.startswith("xC_")] == ["xC_qbin_a:high__b:top?", "xC_qbin_a:low2__b:eq1"]
    for r in out.collect():
        assert r["xC_qbin_a:high__b:top?"] == (r["qbin_a"] == 2 and r["q_b"] == 2) and r["xC_qbin_a:low2__b:eq1"] == (r["qbin_a"] <= 1 and r["q_b"] == 1)
    x = gate.crosses(df, [(("qbin_a", 2), ("q_b", 2)), (("qbin_a", 0), ("q_b", 1)), (("qbin_a", 9), ("q_b", 1))])
    core, held = x.where("ym < '2024-03'"), x.where("ym = '2024-03'")
    assert gate.chosen_crosses(core, held, "y", ["x_0", "x_1", "x_2"], cap=1) == ["x_0"] and gate.chosen_crosses(core, held, "y", ["x_0", "x_1", "x_2"]) == ["x_0", "x_1"]
    # One binary feature's average precision by hand: the set rows first, then the others.
    y1 = [r["y"] for r in held.collect() if r["x_0"]]
    base = np.mean([r["y"] for r in held.collect()])
    assert sum(y1) / len(y1) > base
    assert gate.chosen_crosses(core.where("y = 0"), held, "y", ["x_1", "x_0"]) == sorted(["x_0", "x_1"], key=lambda c: -core.where(f"y = 0 AND {c} = 1").count())


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_refitted_gate_survives_saving(spark, tmp_path, method):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, int(rng.random() < (0.85 if a == 2 else 0.2)), False) for i, a, b in rows], "ts long, qbin_a int, qbin_b int, y int, preempted boolean")
    pairs = [(("qbin_a", 2), ("qbin_b", 1))]
    x = gate.crosses(df, pairs)
    model = gate.fit(x, "y", ["qbin_a", "qbin_b"], ["x_0"], grid=(1.0,))
    parts = gate.refitted(x, "y", ["qbin_a", "qbin_b"], model, ["x_0"], method=method, strength=model.strength, most=3)
    assert len(parts) == 3
    bundle = gate.Bundle(parts, ["qbin_a", "qbin_b"], pairs, ["x_0"], 0.5, [[("qbin_b", 0)]], [("qbin_a:high", "qbin_b:high")])
    out = bundle.enter(df)
    assert out.columns == [*df.columns, "p_win", "loser_mask", "enter"]
    by = {r["qbin_a"]: r["p"] for r in out.groupBy("qbin_a").agg(F.avg("p_win").alias("p")).collect()}
    assert by[2] > 0.7 and by[0] < 0.35 and out.where("enter AND qbin_b = 0").count() == 0 < out.where("enter").count()
    gate.save_bundle(spark, bundle, str(tmp_path / "gate"))
    again = gate.load_bundle(spark, str(tmp_path / "gate"))
    assert (again.tau, again.losers, again.pairs, again.curated) == (bundle.tau, bundle.losers, bundle.pairs, bundle.curated)
    assert {r["ts"]: round(r["p_win"], 9) for r in again.enter(df).collect()} == {r["ts"]: round(r["p_win"], 9) for r in out.collect()}
    lone = gate.refitted(x.where("y = 0 OR ts = 0").withColumn("y", (F.col("ts") == 0).cast("int")), "y", ["qbin_a", "qbin_b"], model, ["x_0"])
    assert len(lone) == 1 and lone[0][0] is model


def test_gated_candidates_and_forced_runs(spark, tmp_path):
    rng = random.Random(11)
    rows = [("S", 3_600_000 * i, "2024-01", rng.random(), rng.random() * 3, rng.random() * 3, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.random() * 100, rng.random() * 100, 100 + rng.random(), rng.choice([0.0, 1.0, 2.0])) for i in range(500)]
    names = ["symbol", "ts", "ym", "body_dom", "close_to_hi_atr", "close_to_lo_atr", "t_240", "t_60", "t_15", "accel_15_240", "atr_p", "dcw_p", "close", "atr"]
    spark.createDataFrame(rows, "symbol string, ts long, ym string, " + ", ".join(f"{n} double" for n in names[3:])).write.parquet(str(tmp_path / "S" / "fold_0" / "features.parquet"))
    spec = {"body_dom_min": 0.2, "close_to_ext_atr_max": 2.0, "t240_abs_min": 0.3, "accel_15_240_min": -1.0, "compression": {"atr_p_max": 90, "dcw_p_max": 80}, "kappa_sign_thr": {"t_240_min": 0.3, "t_60_min": 0.0, "t_15_min": 0.0, "quorum": 2}}
    cfg = {"io": {"outputs_root": str(tmp_path)}, "candidates": {"mode": "gated"}, "candidate_gate": spec, "labels": {"eta_atr": 0.1, "eta_cap": {"min": 0.4, "max": 9}, "risk_floor_rho": 0.3, "quick_ignition_hours": 0.0001}}
    fold = walkforward.Fold(spark, cfg, "S", 0, ["2024-01"], [])
    want = {}
    for r in rows:
        v = dict(zip(names, r))
        for side, sign, near in (("long", 1, "close_to_hi_atr"), ("short", -1, "close_to_lo_atr")):
            votes = sum(sign * v[t] >= m for t, m in (("t_240", 0.3), ("t_60", 0.0), ("t_15", 0.0)))
            if v["body_dom"] >= 0.2 and v[near] <= 2 and abs(v["t_240"]) >= 0.3 and v["t_240"] * sign > 0 and v["accel_15_240"] >= -1 and v["atr_p"] <= 90 and v["dcw_p"] <= 80 and votes >= 2:
                want[v["ts"], side] = round(v["close"] - sign * 0.4 * v["atr"], 8)
    found = fold.table("candidates").collect()
    assert len(want) > 10 and {(r["ts"], r["side"]): r["level"] for r in found} == want and all(r["eta"] == 0.4 for r in found)
    cfg["labels"]["side"] = "long"
    forced, made = walkforward.Fold(spark, cfg, "S", 0, ["2024-01"], [], force=True), []
    forced.features = lambda: made.append("features") or spark.createDataFrame(rows, "symbol string, ts long, ym string, " + ", ".join(f"{n} double" for n in names[3:]))
    assert {r["side"] for r in forced.table("candidates").collect()} == {"long"}
    forced.table("features"), forced.table("candidates")
    assert made == ["features"]  # made anew once, not at each use


def test_crash_report(spark, tmp_path):
    (tmp_path / "part.csv").write_text("x")
    try:
        raise KeyError("nothing there")
    except KeyError as error:
        found = artifacts.read_json(spark, artifacts.write_report(spark, error, str(tmp_path)))
    assert "nothing there" in found["error"] and any("test_crash_report" in line for line in found["traceback"]) and any(f.endswith("part.csv") and n == 1 for f, n in found["files"].items())


def test_months_in_one_scan(spark, tmp_path):
    """Files of several months, headers and time units: one scan for each header, the unit told apart by file, no job for each month."""
    start = 1704067200000
    for m, (unit, head) in enumerate(((1, "ts,open,high,low,close"), (1000, "ts,open,high,low,close"), (1, None), (1_000_000, "Open_Time,open,high,low,close")), 1):
        rows = [f"{(start + (m * 31 + d) * 86_400_000) // 1000 if unit == 1000 else (start + (m * 31 + d) * 86_400_000) * (unit if unit > 1 else 1)},1,2,0.5,{d + 1}" for d in range(5)]
        (tmp_path / f"S-2024-0{m}.csv").write_text("\n".join([head, *rows] if head else rows))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    df = series.read_bars_months(spark, str(tmp_path / "{SYMBOL}-{YYYY}-{MM}.csv"), "S", [f"2024-0{m}" for m in range(1, 6)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(jobs) <= 3  # the columns of three kinds of CSV, not of four months
    want = sorted((start + (m * 31 + d) * 86_400_000, float(d + 1)) for m in range(1, 5) for d in range(5))
    assert sorted((r["ts"], r["close"]) for r in df.collect()) == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6
