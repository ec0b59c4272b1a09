"""Artifacts and reports on small tables."""

import math

import pytest

from tidemark.plans import reports
from tidemark.sources import artifacts

EVENTS = [("S", 1704067200000, "long", "win", 5), ("S", 1704067200000, "long", "loss", 9), ("S", 1706745600000, "short", "timeout", 7)]
SCHEMA = "symbol string, ts long, side string, outcome string, outcome_ts long"


def test_folds_and_months(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    for fold in (0, 1):
        df.limit(3 - fold).write.parquet(f"{tmp_path}/S/fold_{fold}/labels.parquet")
    events = artifacts.events_of_folds(spark, str(tmp_path))
    got = {(r["fold"], r["ym"]): (r["n"], r["timeouts"], r["ppv"]) for r in reports.by_fold_and_month(events).collect()}
    assert got[0, None] == (3, 1, 0.5) and got[0, "2024-02"] == (1, 1, None) and got[1, None][0] == 2


def test_json_and_fingerprint(spark, tmp_path):
    artifacts.write_json(spark, {"a": [1, math.nan]}, f"{tmp_path}/x.json")
    back = artifacts.read_json(spark, f"{tmp_path}/x.json")
    assert back["a"][0] == 1 and math.isnan(back["a"][1])
    df = spark.createDataFrame(EVENTS, SCHEMA)
    one, two = (artifacts.fingerprint({"k": 1}, {"e": x}) for x in (df, df.repartition(3)))
    assert one == two and one["tables"]["e"]["rows"] == 3 and artifacts.no_trades(spark).count() == 0


def test_label_fallback(spark):
    ev = spark.createDataFrame(EVENTS, SCHEMA)
    cands = spark.createDataFrame([("S", 1704067200000, "long"), ("S", 1, "long")], "symbol string, ts long, side string")
    got = {r["ts"]: r["outcome"] for r in reports.with_labels(cands, ev, ["symbol", "ts", "side"]).collect()}
    assert got == {1704067200000: "loss", 1: None}
    other = spark.createDataFrame([("S", 1704067200000, "short")], "symbol string, ts long, side string")
    assert reports.with_labels(other, ev, ["symbol", "ts", "side"]).first()["outcome"] == "loss"  # by time alone


def test_truth(spark):
    rules = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.1)], "rule_id string, precision_lcb double")
    trades = spark.createDataFrame([("a", "win"), ("a", "loss"), ("b", "loss")], "rule_id string, outcome string")
    assert {r["rule_id"]: r["holds"] for r in reports.truth(rules, trades).collect()} == {"a": True, "b": False, "c": None}


def test_parity_of_two_runs(spark, tmp_path, capsys):
    rows = [("S", i, "long", "win", 1.0 + i) for i in range(6)] + [("S", 9, "short", "loss", None)]
    schema = "symbol string, ts long, side string, outcome string, R double"
    other = [rows[0], (*rows[1][:3], "loss", rows[1][4]), (*rows[2][:4], 3.5), *rows[4:], ("S", 7, "long", "win", 1.0)]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    assert {(r["ts"], r["only_in"]) for r in reports.differences(a, b).collect()} == {(3, "a"), (7, "b"), (1, "differs"), (2, "differs")}
    for name, df in (("x", a), ("y", b)):
        df.write.parquet(str(tmp_path / name / "S" / "fold_0" / "trades.parquet"))
    with pytest.raises(SystemExit) as ended:
        reports.main(["parity", str(tmp_path / "x")])
    assert ended.value.code == 2
