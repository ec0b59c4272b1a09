"""Hand cases, invariants and plain re-statements of the sequential operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import windows as W
from tidemark.operators import binning, evaluate, features, labeling, mining, sequential
from tidemark.sources import series


def test_bins_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(stats.interval_bin(F.col("x"), [1.0, 2.0], 3)).collect()]
    assert got == [0, 1, 1, 2, 2]  # closed on the left; null in the top bin
    assert [r[0] for r in df.select(stats.interval_bin(F.col("x"), [1.0, 2.0], 3, F.lit(None))).collect()][-1] is None


def test_rank_of_null_is_100(spark):
    df = spark.createDataFrame([("a", 1, 1.0, True), ("a", 2, 2.0, True), ("a", 3, None, False), ("a", 4, 1.5, False)], "symbol string, ts long, x double, train boolean")
    got = {r["ts"]: r["p"] for r in features.train_ranks(df, {"x": "p"}, "train").collect()}
    assert got == {1: 50.0, 2: 100.0, 3: 100.0, 4: 50.0}


def test_runs_and_since(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, 2, 2, None, None, 1])], "symbol string, ts long, b int")
    assert [r["n"] for r in W.run_lengths(df, "b", "n").orderBy("ts").collect()] == [1, 2, 1, 2, 3, 1, 2, 1]
    assert [r["n"] for r in W.rows_since(df, F.col("b") == 2, "n").orderBy("ts").collect()] == [None, None, 0, 0, 0, 1, 2, 3]


def _labels(spark, ticks, **options):
    cands = spark.createDataFrame([("s", 1000, "long", 100.0, 99.0, 1.0), ("s", 1000, "short", 100.0, 101.0, 1.0)], "symbol string, ts long, side string, entry double, level double, risk_dist double")
    t = spark.createDataFrame([("s", *x) for x in ticks], "symbol string, ts long, seq long, price double")
    got = labeling.first_touch(cands, t, r_mult=2.0, hours=1.0, epsilon_ms=1, **options).collect()
    return {r["side"]: (r["outcome"], r["outcome_ts"], r["preempted"]) for r in got}


def test_first_touch_edges(spark):
    end = 1000 + 3_600_000
    assert _labels(spark, [(1000, 0, 102.0)])["long"] == ("timeout", end, False)  # before the window
    assert _labels(spark, [(1001, 0, 102.0)]) == {"long": ("win", 1001, False), "short": ("loss", 1001, False)}
    assert _labels(spark, [(end, 0, 98.0)]) == {"long": ("loss", end, False), "short": ("win", end, False)}
    assert _labels(spark, [(5000, 1, 99.0), (5000, 0, 102.0)])["long"] == ("win", 5000, False)  # seq decides
    assert _labels(spark, [], keep_untouched=False)["long"] == ("timeout", end, True)


def test_first_touch_any_bucket_width(spark):
    rng = random.Random(4)
    ticks = [(1000 + rng.randrange(3_700_000), i, 100 + rng.gauss(0, 0.8)) for i in range(200)]
    assert len({str(sorted(_labels(spark, ticks, bucket_ms=w).items())) for w in (1_000, 77_777, 10_000_000)}) == 1


def test_cusum_resets_when_suppressed(spark):
    values = [1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("a", i, v, 1.5) for i, v in enumerate(values)], "symbol string, ts long, x double, h double")
    assert [r["event"] for r in sequential.cusum(df, "x", "h", min_gap=4).orderBy("ts").collect()] == [0, 1, 0, 0, 0, 0, 1]


def _events(spark, n=80, seed=1):
    rng = random.Random(seed)
    rows = [("a", t, rng.choice(["long", "short"]), t + rng.randrange(1, 40), float(rng.randrange(1, 9))) for t in (rng.randrange(300) for _ in range(n))]
    return rows, spark.createDataFrame(rows, "symbol string, ts long, side string, outcome_ts long, w double")


def test_schedules(spark):
    rows, df = _events(spark)
    kept = sequential.one_at_a_time(df, 10).orderBy("ts").collect()
    assert all(a["outcome_ts"] <= b["ts"] for a, b in zip(kept, kept[1:]))
    best = sequential.best_schedule(df, "w").orderBy("ts").collect()
    assert all(a["outcome_ts"] <= b["ts"] for a, b in zip(best, best[1:]))
    assert sum(r["w"] for r in best) >= sum(r["w"] for r in kept)
    total = {-1: 0.0}
    ends = sorted(rows, key=lambda r: r[3])
    best_at = []
    for r in ends:
        best_at.append(max([best_at[-1] if best_at else 0.0, r[4] + max([0.0, *[b for b, e in zip(best_at, ends) if e[3] <= r[1]]])]))
    assert sum(r["w"] for r in best) == pytest.approx(best_at[-1]) and total
    capped = sequential.capped(df, 2, 1).collect()
    for r in capped:
        assert sum(x["ts"] <= r["ts"] < x["outcome_ts"] for x in capped) <= 2 + sum(x["ts"] == r["ts"] for x in capped)


def test_best_in_window_gaps(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", rng.choice(["long", "short"]), rng.randrange(1000), rng.choice([1.0, 2.0, None]), rng.random()) for _ in range(200)], "symbol string, side string, ts long, eta double, atr_p double")
    kept = sequential.best_in_window(df, 50).orderBy("side", "ts").collect()
    for a, b in zip(kept, kept[1:]):
        assert a["side"] != b["side"] or b["ts"] - a["ts"] >= 50


def test_rule_pairs_agree_with_counting(spark):
    rng = random.Random(3)
    rows = [(f"2024-{m:02d}", rng.randrange(3), rng.randrange(3), rng.choice([None, 0, 1]), rng.choice(["win", "loss", "timeout"])) for m in range(1, 7) for _ in range(60)]
    ev = mining.flagged(spark.createDataFrame(rows, "ym string, a int, b int, c int, outcome string"))
    got = {r["rule_id"]: (r["wins"], r["losses"], r["timeouts"]) for r in mining.mine_pairs(ev, ["a", "b", "c"], 1, 1, 1, max_timeout=9).collect()}
    want = {}
    for _, a, b, c, o in rows:
        for x, y in ((("a", a), ("b", b)), (("a", a), ("c", c)), (("b", b), ("c", c))):
            if x[1] is not None and y[1] is not None:
                counts = want.setdefault(f"{x[0]}=={x[1]} & {y[0]}=={y[1]}", [0, 0, 0])
                counts[("win", "loss", "timeout").index(o)] += 1
    assert got == {k: tuple(v) for k, v in want.items() if v[0]}


def test_pairs_at_full_width_hand_on_few_rows(spark):
    """960 literals and 6 months: the tasks hand on less than ten rows for each row they read."""
    rng = np.random.default_rng(4)
    n, columns = 4_000, [f"c{i}" for i in range(192)]
    values = rng.integers(0, 5, (n, 192))
    outcome, month = rng.integers(0, 3, n), rng.integers(1, 7, n)
    rows = [(f"2024-{m:02d}", ["win", "loss", "timeout"][o], *map(int, v)) for m, o, v in zip(month, outcome, values, strict=True)]
    ev = mining.flagged(spark.createDataFrame(rows, "ym string, outcome string, " + ", ".join(f"{c} int" for c in columns))).repartition(4)
    chosen = [(c, v) for c in sorted(columns) for v in range(5)]
    packed = ev.select("ym", *mining._FLAGS, *[F.col(c).cast("long").alias(f"l_{c}") for c in columns]).sortWithinPartitions("ym").mapInArrow(mining._pair_counts(chosen), mining._PAIRS)
    assert packed.count() <= 4 * 6 * 960 < 10 * n
    got = {r["rule_id"]: (r["wins"], r["losses"], r["timeouts"], r["unique_months"]) for r in mining.mine_pairs(ev.select("ym", *mining._FLAGS, *columns[:12], *columns[-12:]), columns[:12] + columns[-12:], 120, 60, 6, min_resolve=0, max_timeout=9).collect()}
    want = {}
    picked = [*range(12), *range(180, 192)]
    for a in range(24):
        for b in range(a + 1, 24):
            for u in range(5):
                for v in range(5):
                    here = (values[:, picked[a]] == u) & (values[:, picked[b]] == v)
                    w, lo, to = (int((here & (outcome == o)).sum()) for o in range(3))
                    months = len(set(month[here]))
                    if w + lo >= 120 and w >= 60 and months >= 6:
                        want[" & ".join(sorted([f"{columns[picked[a]]}=={u}", f"{columns[picked[b]]}=={v}"]))] = (w, lo, to, months)
    assert got == want and len(want) > 5


def test_unknown_operator_and_column(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert df.select(mining.first_match([("r1", [("a", "!=", 1)]), ("r2", [("b", "<", 5)]), ("r3", [("a", ">=", 1)])])).first()[0] == "r3"
    assert df.select(mining.any_literal([[("z", 1)]], df.columns)).first()[0] is False
    assert df.select(mining.any_literal([[]], df.columns)).first()[0] is True


def test_binomial_tails(spark):
    from fractions import Fraction
    from math import comb

    cases = [(k, n, p) for n in (1, 2, 7, 40, 300) for k in sorted({0, 1, n // 3, n // 2, n - 1, n}) for p in (0.0, 0.01, 0.3, 0.5, 0.97, 1.0)]
    df = spark.createDataFrame([*cases, (None, 5, 0.5)], "k long, n long, p double")
    for r in df.select("*", stats.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("tail")).collect():
        if r["k"] is None:
            assert r["tail"] is None
            continue
        p = Fraction(r["p"])
        want = float(sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1)))
        assert r["tail"] == pytest.approx(want, rel=1e-9, abs=1e-13), r


def test_wilson_contains_the_rate(spark):
    df = spark.createDataFrame([(k, n) for n in (0, 1, 5, 50) for k in range(n + 1)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", lo.alias("lo"), hi.alias("hi")).collect():
        assert (r["lo"], r["hi"]) == (0, 0) if r["n"] == 0 else r["lo"] - 1e-9 <= r["k"] / r["n"] <= r["hi"] + 1e-9


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    assert evaluate.average_precision(df, "p", "y").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_metrics_in_pieces(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.5, 0.5, rng.random(), round(rng.random(), 2)]), rng.randrange(2)) for i in range(900)]
    for part in (rows, rows[:1], [(i, 0.5, i % 2) for i in range(40)]):
        df = spark.createDataFrame(part, "id long, p double, y int").repartition(3)
        ap, ece, tau = evaluate.average_precision(df, "p", "y"), evaluate.calibration_error(df, "p", "y", 7, "id"), evaluate.threshold(df, "p", "y", 0.5, 0.02)
        for found in (ap, ece, tau):  # whole tables are sorted within pieces only; sums without a partition are over one row for each piece
            windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip(" :+-").startswith("Window ")]
            assert windows and all("__t_" in w or "[__piece#" in w for w in windows)
        p, y = np.array([r[1] for r in part]), np.array([r[2] for r in part])
        want, before = 0.0, 0.0
        for s in sorted(set(p), reverse=True):
            recall = y[p >= s].sum() / max(y.sum(), 1)
            want, before = want + (recall - before) * y[p >= s].mean(), recall
        assert (ap.first()[0] or 0.0) == pytest.approx(want)
        order = sorted(part, key=lambda r: (r[1], r[0]))
        bins = [order[k * len(order) // 7 : (k + 1) * len(order) // 7] for k in range(7)]
        assert ece.first()[0] == pytest.approx(sum(abs(sum(r[1] for r in b) - sum(r[2] for r in b)) for b in bins) / len(order))
        for target in (0.2, 0.9):  # each quantile of the scores as a threshold
            points = []
            for tau in sorted(set(np.quantile(p, np.linspace(0, 1, 201)).tolist())):
                k, n = int(y[p >= tau].sum()), int((p >= tau).sum())
                share, z = k / n, 1.96
                low = max(0.0, (share + z * z / (2 * n) - z * math.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n))
                points.append((tau, share, low, n / len(p)))
            good = [x for x in points if x[2] >= target]
            want = max(good) if good else max((x for x in points if x[3] >= 0.02 and x[2] > 0), key=lambda x: (x[2], x[0]), default=None)
            found = evaluate.threshold(df, "p", "y", target, 0.02).collect()
            assert [tuple(r) for r in found] == [] if want is None else tuple(found[0]) == pytest.approx(want, abs=1e-9)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Open,High,Low,Close,volume\n1700000000,1,2,0.5,1.5,9\n1700000060,x,2,0.5,1.5,9\n")
    (tmp_path / "b.csv").write_text("1700000000000,1,2,0.5,1.5,9,0,0,0,0,0,0\n")
    (tmp_path / "t.csv").write_text("timestamp,last_price\n1700000000000000,5\n1700000001000000,NaN\n")
    for name in ("a.csv", "b.csv"):
        assert [tuple(r) for r in series.read_bars(spark, str(tmp_path / name), "S").collect()] == [("S", 1700000000000, 1.0, 2.0, 0.5, 1.5)]
    assert [(r["ts"], r["price"]) for r in series.read_ticks(spark, str(tmp_path / "t.csv"), "S").collect()] == [(1700000000000, 5.0)]
    with pytest.raises(ValueError):
        series.read_bars(spark, str(tmp_path / "t.csv"), "S")
    assert series.existing(spark, str(tmp_path / "a.parquet")).endswith("a.csv")
    assert series.folds(["1", "2", "3", "4"], 2, 1, 1) == [(0, ["1", "2"], ["3"]), (1, ["2", "3"], ["4"])]


def test_capped_schedule_by_brute_force(spark):
    for seed in range(4):
        rows, df = _events(spark, seed=seed)
        want, open_ = [], []
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            now = [o for o in open_ if o[3] > r[1]]
            if len(now) < 3 and sum(o[2] == r[2] for o in now) < 2:
                want.append(r)
                open_.append(r)
        # Events of one time and side are interchangeable in the rule, so compare what doesn't depend on their order.
        found = sequential.capped(df, 3, 2).collect()
        if len({r[1:3] for r in rows}) == len(rows):
            assert sorted(tuple(r) for r in found) == sorted(want)
        for r in found:
            others = [x for x in found if x["ts"] < r["ts"] < x["outcome_ts"]]
            assert len(others) < 3 and sum(x["side"] == r["side"] for x in others) < 2


def test_best_schedule_rows(spark):
    """The rows kept, not only their total: disjoint, and no set of disjoint events is worth more."""
    rng = random.Random(9)
    for _ in range(3):
        rows = [("a", t, "long", t + rng.randrange(1, 30), float(rng.randrange(1, 9))) for t in rng.sample(range(60), 12)]
        df = spark.createDataFrame(rows, "symbol string, ts long, side string, outcome_ts long, w double")
        kept = sorted(tuple(r) for r in sequential.best_schedule(df, "w").collect())
        assert set(kept) <= set(rows) and len(set(kept)) == len(kept) and all(a[3] <= b[1] for a, b in zip(kept, kept[1:]))

        def best(left: list, free: int) -> float:
            return max([best(left[1:], free), *([left[0][4] + best(left[1:], left[0][3])] if left[0][1] >= free else [])]) if left else 0.0

        assert sum(r[4] for r in kept) == best(sorted(rows, key=lambda r: r[1]), -1)


def test_pair_counts_with_nulls_and_many_months(spark):
    rng = random.Random(12)
    rows = [(f"2024-{1 + i % 9:02}" if i % 50 else None, rng.choice(["win", "loss", "timeout"]), rng.choice([None, 0, 1, 2]), rng.choice([0, 1]), rng.choice([5, 7, None])) for i in range(900)]
    df = mining.flagged(spark.createDataFrame(rows, "ym string, outcome string, a int, b long, c short"))
    found = {r["rule_id"]: (r["wins"], r["losses"], r["timeouts"]) for r in mining.mine_pairs(df, ["c", "a", "b"], 1, 1, 1, max_timeout=9.0, min_resolve=0.0).collect()}
    want: dict[str, list[int]] = {}
    for _, outcome, *values in rows:
        held = [(n, v) for n, v in zip("abc", values) if v is not None]
        for x in range(len(held)):
            for z in held[x + 1 :]:
                at = want.setdefault(f"{held[x][0]}=={held[x][1]} & {z[0]}=={z[1]}", [0, 0, 0])
                at[["win", "loss", "timeout"].index(outcome)] += 1
    assert found == {k: tuple(v) for k, v in want.items()}


def test_chosen_bins(spark):
    assert binning.merged_bins(np.array([0.3, 0.001, 0.3, 0.399]), 0.005) == [0, 2, 3] or binning.merged_bins(np.array([0.3, 0.001, 0.3, 0.399]), 0.005) == [0, 1, 3]
    assert binning.merged_bins(np.array([0.001, 0.999]), 0.005) == [0] and binning.merged_bins(np.array([0.5, 0.5]), 0.005) == [0, 1]
    n, w = np.array([40.0, 60.0, 100.0]), np.array([10.0, 30.0, 80.0])
    p = binning.bin_probabilities(n, w)
    assert np.abs(p - w / n).max() < 0.03 and np.abs(n @ p - w.sum()) < 3
    assert binning.drift(np.array([[1.0, 0.0], [0.0, 1.0]])) == pytest.approx(np.sqrt(np.log(2))) and binning.drift(np.array([[2.0, 2.0], [1.0, 1.0]])) == 0
    ap, ece, brier, corr = binning.quality(np.array([0.2, 0.8]), np.array([10.0, 10.0]), np.array([2.0, 8.0]))
    ps, ys = np.repeat([0.2, 0.8], 10), np.array([1] * 2 + [0] * 8 + [1] * 8 + [0] * 2)
    assert ap == pytest.approx(0.8 * 0.8 + 0.2 * 0.5) and ece == pytest.approx(0, abs=1e-9) and -brier == pytest.approx(((ps - ys) ** 2).mean()) and corr == pytest.approx(np.corrcoef(ps, ys)[0, 1])
    rng = random.Random(7)
    rows = []
    for i in range(3_000):
        x = rng.random()
        rows.append((f"2024-0{1 + i % 4}", x, 1.0, rng.random() if i % 9 else None, int(rng.random() < 0.1 + 0.8 * x)))
    df = spark.createDataFrame(rows, "ym string, up double, flat double, noise double, y int")
    edges = binning.choose_bins(df, ["up", "flat", "noise"], "y", F.col("ym") != "2024-04")
    assert edges["flat"] == [] and len(edges["up"]) >= 4 and 2 <= len(edges["noise"]) <= 9
    for e in edges.values():
        assert e == sorted(e)
    k = len(edges["up"]) + 1
    assert edges["up"] == pytest.approx(np.quantile([r[1] for r in rows if r[0] != "2024-04"], [j / k for j in range(1, k)]))
    assert set(binning.choose_bins(df.limit(0), ["up"], "y", F.lit(True))["up"]) == set()


def test_stop_band_runs_across_groups_of_ticks(spark, monkeypatch):
    """Runs that go on over groups of a few ticks, against a loop; what is shuffled of a long run is a row for each group."""
    tables, saved = {}, labeling.saved
    monkeypatch.setattr(labeling, "saved", lambda df, name: tables.setdefault(name, saved(df, name)))
    rng = np.random.default_rng(12)
    price = np.round(100 + np.cumsum(rng.normal(0, 0.6, 900)), 2)
    price[500:800] = 80.0  # one run of 300 ticks
    at = np.sort(rng.integers(1, 9000, 900)) * 1000
    ticks = [("S", int(t), i, float(p)) for i, (t, p) in enumerate(zip(at, price, strict=True))]
    cands = [("S", int(at[i]), side, float(price[i]), float(price[i]) - sign * 1.0, 1.5, 1.0) for i in range(0, 900, 30) for side, sign in (("long", 1), ("short", -1))]
    cands = list({(c[1], c[2]): c for c in cands}.values())
    df = spark.createDataFrame(cands, "symbol string, ts long, side string, entry double, level double, risk_dist double, atr double")
    got = labeling.stop_band(df, spark.createDataFrame(ticks, "symbol string, ts long, seq long, price double"), 2.0, 1, 0.25, consec_ticks=3, dwell_ms=20_000, block=16).collect()
    assert len(got) == len(cands)
    for r in got:
        sign = 1 if r["side"] == "long" else -1
        inside = [(i, t, p) for _, t, i, p in ticks if r["ts"] + 1 <= t <= r["ts"] + 3_600_000]
        first = lambda level: next(((i, t) for i, t, p in inside if sign * (p - level) >= 0), None)  # noqa: B023, E731
        one, target, stopped, run = first(r["entry"] + sign * 1.5), first(r["entry"] + sign * 3.0), None, []
        for i, t, p in inside:
            run = [*run, (i, t)] if sign * (p - (r["level"] - sign * 0.05)) < 0 else []
            if len(run) >= 3 and t - run[0][1] >= 20_000:
                stopped = run[0]
                break
        lost = stopped is not None and (target is None or stopped[0] < target[0])
        lit = not lost and one is not None and one[1] <= r["ts"] + 900_000
        won = lit and target is not None
        want = ("loss", stopped[1]) if lost else ("win", target[1]) if won else ("timeout", r["ts"] + 3_600_000)
        assert (r["outcome"], r["outcome_ts"], r["r1_ts"], r["tp_ts"]) == (*want, one[1] if lit else None, target[1] if won else None)
    assert {r["outcome"] for r in got} == {"win", "loss", "timeout"}
    rows = tables["touches"].groupBy("symbol", "ts", "side").count().agg({"count": "max"}).first()[0]
    assert rows < 250  # groups of 16 ticks in 24 buckets or fewer, three runs each at most, not each of the ticks
