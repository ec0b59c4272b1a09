"""Walk-forward run: bars and ticks to features, candidates, labels, rules, gate and scheduled trades, fold by fold.

    python -m tidemark.plans.walkforward --config run.yaml [--from STAGE] [--until STAGE] [--only STAGE] [--force]

Each stage of a fold is a Parquet table under outputs_root/SYMBOL/fold_N and is skipped if it exists.
"""

from __future__ import annotations

import argparse
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import windows as W
from tidemark.operators import candidates, evaluate, features, gate, labeling, mining, sequential
from tidemark.sources import artifacts, series
from tidemark.sources.artifacts import write_report

STAGES = ("features", "candidates", "labels", "rules", "decided", "trades")
HOUR = 3_600_000
#: With fewer resolved training labels than this a fold is mined with relaxed limits.
FEW = 150
BASE = ["t_240", "t_60", "t_15", "accel_15_240", "atr", "dcw", "atr_p", "dcw_p", "body_dom", "close_to_hi_atr", "close_to_lo_atr"]


def validated(cfg: dict) -> dict:
    """The configuration, or a ValueError that names what is missing or out of range."""
    for path in ("data.symbols", "data.file_patterns.bars", "data.file_patterns.ticks", "data.months.start", "data.months.end", "walkforward.train_months", "walkforward.test_months"):
        at = cfg
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                raise ValueError(f"the configuration lacks {path}")
            at = at[key]
    if cfg["walkforward"]["train_months"] < 1 or cfg["walkforward"]["test_months"] < 1:
        raise ValueError("walkforward months must be at least 1")
    return cfg


class Fold:
    """One fold of one symbol; `table` runs a stage or reads its result."""

    def __init__(self, spark: SparkSession, cfg: dict, symbol: str, number: int, train: list[str], test: list[str], force: bool = False):
        self.spark, self.cfg, self.symbol, self.train, self.test, self.force = spark, cfg, symbol, train, test, force
        self.root = f"{cfg.get('io', {}).get('outputs_root', 'outputs')}/{symbol}/fold_{number}"
        self.label, self.done, self._few = cfg.get("labels", {}), set(), None

    def table(self, stage: str) -> DataFrame:
        """The stage's result; with `force` it is made anew, once."""
        path = f"{self.root}/{stage}.parquet"
        if (self.force and stage not in self.done) or not series._exists(self.spark, f"{path}/_SUCCESS"):
            getattr(self, stage)().write.mode("overwrite").parquet(path)
        self.done.add(stage)
        return self.spark.read.parquet(path)

    def _path(self, kind: str) -> str:
        data = self.cfg["data"]
        return f"{data.get(f'{kind}_dir', '.')}/{data['file_patterns'][kind]}"

    def features(self) -> DataFrame:
        spec = self.cfg.get("features", {})
        bars = series.read_bars_months(self.spark, self._path("bars"), self.symbol, self.train + self.test)
        df = features.base_features(bars, spec.get("atr_n", 14), spec.get("donch_n_candidate", 20)).withColumn("is_train", F.col("ym").isin(self.train))
        df = features.train_ranks(df, {"atr": "atr_p", "dcw": "dcw_p"}, "is_train")
        extra = spec.get("nonlinear", {})
        if extra.get("enabled"):
            w = extra.get("windows", {})
            df = features.nonlinear_features(df, extra.get("include", []), w.get("small", 15), w.get("mid", 60))
        age = spec.get("age", {})
        if age.get("enabled"):
            aged = BASE + [c for c in df.columns if c.startswith("nl_")]
            df = features.age_features(df, aged, "is_train", age.get("n_bins_feature", 5), age.get("n_bins_age", 6), tuple(age.get("occ_windows", (60, 240))))
        return df

    def candidates(self) -> DataFrame:
        df = self.table("features").withColumn("bar_idx", F.row_number().over(W.ordered()) - 1)
        df = self._blind(df) if self.cfg.get("candidates", {}).get("mode", "blind") == "blind" else self._gated(df)
        return sequential.best_in_window(df, int(self.label.get("quick_ignition_hours", 2) * HOUR))

    def _eta_table(self) -> list[tuple[float, float, float]]:
        return [(r["lo"], r["hi"], r["eta"]) for r in self.label.get("eta_by_atr_p", [])]

    def _gated(self, df: DataFrame) -> DataFrame:
        """Candidates of the sides in labels.side that pass candidate_gate."""
        g, cap, side = self.cfg["candidate_gate"], self.label.get("eta_cap", {}), self.label.get("side", "both")
        signs = g["kappa_sign_thr"]
        gate_ = candidates.Gate(
            g["body_dom_min"], g["close_to_ext_atr_max"], g["t240_abs_min"], g["accel_15_240_min"], g["compression"]["atr_p_max"], g["compression"]["dcw_p_max"], (signs["t_240_min"], signs["t_60_min"], signs["t_15_min"]), int(signs["quorum"])
        )
        sides = ("long", "short") if side == "both" else (side,)
        return candidates.gated(df, gate_, self.label.get("eta_atr", 0.3), self._eta_table(), (cap.get("min", 0.0), cap.get("max", float("inf"))), self.label.get("risk_floor_rho", 0.0), sides)

    def _blind(self, df: DataFrame) -> DataFrame:
        p = self.cfg.get("candidates", {}).get("blind", {}).get("thinning", {}).get("params", {})
        df = candidates.thinned(df, p.get("ret_lookback", 240), p.get("k_sigma", 0.75), p.get("drift", 0.0), p.get("min_gap_bars", 0), p.get("fallback_stride_k", 0))
        return candidates.both_sides(df, self.label.get("eta_atr", 20.0), self._eta_table(), self.label.get("min_risk_atr_frac", 0.001))

    def labels(self) -> DataFrame:
        cands = self.table("candidates")
        found = series.months_with_files(self.spark, self._path("ticks"), self.symbol, self.train + self.test)
        if not found:
            return labeling.unlabelled(cands)
        ticks = series.read_ticks(self.spark, found, self.symbol)
        keep = self.label.get("no_ticks_policy", "skip") != "skip"
        return labeling.first_touch(cands, ticks, self.label.get("r_mult", 5.0), self.label.get("horizon_hours", 480), self.label.get("intra_bar_epsilon_ms", 1), keep, scale_by_eta="time_scale_from_eta" in self.label)

    def _events(self) -> DataFrame:
        """Labelled events with since_* and occ_* also in bins (B_*), by quantiles of the training rows that rules are mined from; null stays null."""
        ev, bins = mining.flagged(self.table("labels")), self.cfg.get("mining", {}).get("rules", {}).get("n_bins_cont")
        n = int(self.cfg.get("features", {}).get("age", {}).get("n_bins_feature", 5) if bins in (None, "auto") else bins)
        n = max(3, min(5, n)) if self.few_resolved() else n
        counters = [c for c in ev.columns if c.startswith(("since_", "occ_"))]
        edges = features.quantile_edges(self._training(ev), counters, n, rising=True) if counters else None
        return features.with_bins(ev, edges, counters, n, "B_", null_bin=F.lit(None)) if counters else ev

    def _training(self, ev: DataFrame) -> DataFrame:
        return ev.where(F.col("ym").isin(self.train) & ~F.col("preempted"))

    def few_resolved(self) -> bool:
        """Whether fewer than FEW training labels are resolved: then limits are relaxed and no rule is rejected as a false discovery."""
        if self._few is None:
            resolved = self._training(self.table("labels")).where(F.col("outcome").isin("win", "loss"))
            self._few = resolved.limit(FEW).count() < FEW
        return self._few

    def _literals(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c.startswith(("qbin_", "B_"))]

    def rules(self) -> DataFrame:
        spec = self.cfg.get("mining", {}).get("rules", {})
        ev = self._training(self._events())
        if self.few_resolved():
            spec = spec | {"min_months": 1, "min_wins": 1, "wilson_z": 1.64, "fdr": {}}
        support = spec.get("min_support", 0 if "min_support_frac" in spec else 24) or max(1, math.ceil(spec.get("min_support_frac", 0.0) * ev.count()))
        options = {"min_support": support, "min_wins": spec.get("min_wins", 4), "min_months": spec.get("min_months", 4), "include_timeouts": spec.get("precision_include_timeouts", False), "min_resolve": spec.get("min_resolve_frac", 0.0), "max_timeout": spec.get("max_timeout_rate", 1.0), "z": spec.get("wilson_z", 1.96)}
        lits = self._literals(ev)
        out = mining.mine_single(ev, lits, **options).drop("lit", "val")
        if spec.get("max_terms", 2) > 1 and len(lits) > 1:
            out = out.unionByName(mining.mine_pairs(ev, lits, **options).drop("lit1", "val1", "lit2", "val2"))
        fdr = spec.get("fdr", {})
        p = stats.binomial_tail(F.col("wins"), F.col("support_n"), F.col("base_p")) if fdr.get("method") == "binomial" else 1 - F.col("precision_lcb")
        out = mining.false_discovery(out, p, fdr.get("alpha", 0.1))
        return out if not spec.get("fdr", {}).get("enabled") else out.where("rejected = 1")

    def _split(self, train: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that the gate is fitted and calibrated on, and those of the last gate.val_months training months, which choose its grid and threshold; an empty part is replaced by all rows."""
        months = int(self.cfg.get("gate", {}).get("val_months", 1))
        late = F.col("ym").isin(sorted(set(self.train))[-months:]) if months > 0 else F.lit(False)
        core, held = train.where(~late), train.where(late)
        return train if core.isEmpty() else core, train if held.isEmpty() else held

    def _promoted(self, rules: DataFrame) -> DataFrame:
        spec = self.cfg.get("mining", {}).get("rules", {})
        return mining.promoted(
            rules, spec.get("top_k", 25), spec.get("min_precision_uplift_abs", 0.0), spec.get("min_precision_uplift_pp", 0.0), spec.get("min_lift_lcb", 0.0), spec.get("min_resolve_frac", 0.0), spec.get("min_resolve_uplift_pp", 0.0),
            spec.get("max_timeout_rate", 1.0), spec.get("min_wins", 4), spec.get("abs_min_plcb", spec.get("min_precision_lcb", 0.0)),
        )

    def _rule_of(self, rules: DataFrame) -> Column:
        """Id of the first promoted rule that holds, by lower bound."""
        best = [r.asDict() for r in self._promoted(rules).collect()]  # top_k rules at most
        return mining.first_match([(r["rule_id"], [(c, "==", v) for c, v in group]) for r, group in zip(best, gate.loser_groups(best, 0), strict=True)])

    def _losers(self, rules: DataFrame) -> list:
        """Literal groups that bar an entry: loser_top_k rules at most, none unless mine_losers and loser_mask.enabled hold."""
        spec, mask = self.cfg.get("mining", {}).get("rules", {}), self.cfg.get("loser_mask", {})
        if not spec.get("mine_losers", True) or not mask.get("enabled", True):
            return []
        worst = mining.losers(rules, spec.get("loser_top_k", 8), spec.get("loser_max_precision_ucb", 0.35), spec.get("loser_min_resolve_frac", 0.4), spec.get("loser_min_months", 2))
        groups = gate.loser_groups([r.asDict() for r in worst.collect()], mask.get("min_support", 20))
        if mask.get("save_artifact", True):
            artifacts.write_json(self.spark, [[{"col": c, "val": v} for c, v in g] for g in groups], f"{self.root}/loser_mask.json")
        return groups

    def decided(self) -> DataFrame:
        """The test candidates with p_win, loser_mask and enter by a gate that is fitted on the training labels and saved."""
        rules, ev, spec = self.table("rules"), self._events(), self.cfg.get("gate", {})
        lits = self._literals(ev)
        train = self._training(ev).where(F.col("outcome") != "timeout")
        test = ev.where(F.col("ym").isin(self.test)).withColumn("rule_id", self._rule_of(rules))
        core, held = self._split(train)
        kinds = [r[0] for r in core.select("is_win").distinct().limit(2).collect()]
        if len(kinds) < 2:  # nothing to learn from
            return test.withColumns({"p_win": F.lit(0.0), "loser_mask": F.lit(False), "enter": F.lit(False)})
        learner, method = self.cfg.get("ml_gating", {}).get("model", "logreg"), spec.get("calibration", "isotonic")
        groups = [g for g in gate.loser_groups([r.asDict() for r in self._promoted(rules).collect()], 0) if len(g) == 2]  # top_k rules at most
        pairs = [tuple(g) for g in groups if all(c in core.columns for c, _ in g)]
        crossing = self.cfg.get("ml_gating", {}).get("crosses", {})
        curated = [tuple(p) for p in crossing.get("curated", [])] if crossing.get("enable_curated", True) else []
        bundle = gate.Bundle([], lits, pairs, [], 0.5, self._losers(rules), curated)
        core, held = bundle.crossed(core), bundle.crossed(held)
        bundle.extra = gate.chosen_crosses(core, held, "is_win", [c for c in core.columns if c.startswith(("x_", "xC_")) and c in held.columns], crossing.get("max_total", 20))
        model = gate.fit(core, "is_win", lits, bundle.extra, model=learner, validation=held)
        bundle.parts = gate.refitted(core, "is_win", lits, model, bundle.extra, learner, method, model.strength)
        tau = evaluate.threshold(gate.with_probability(held, bundle.parts, lits), "p_win", "is_win", spec.get("target_ppv_lcb", 0.7), spec.get("min_coverage", 0.02)).first()
        bundle.tau = tau["tau"] if tau else 0.5
        gate.save_bundle(self.spark, bundle, f"{self.root}/gate")
        return bundle.enter(test)

    def trades(self) -> DataFrame:
        """The entered candidates that don't overlap, with their costs."""
        out = sequential.one_at_a_time(self.table("decided").where("enter"), int(self.label.get("horizon_hours", 480) * HOUR))
        fees = self.cfg.get("execution_sim", {}).get("fees", {})
        return labeling.costs(labeling.r_multiple(out, self.label.get("r_mult", 5.0)), fees.get("maker_bps", 1.0), fees.get("taker_bps", 5.0), fees.get("entry_is_maker", False), fees.get("exit_is_maker", True), roundtrip_bps=fees.get("roundtrip_bps", 0.0))

    def report(self) -> dict:
        """Metrics of decided and scheduled entries and breached daily limits, written as simulation.json; fingerprint.json beside it.

        A day is breached if the lower bound of the precision over the last window_days days is below ppv_lcb_min, or the rate
        of timeouts above timeout_rate_max.
        """
        wire, r_mult = self.cfg.get("tripwires", {}), self.label.get("r_mult", 5.0)
        decided, trades = self.table("decided"), self.table("trades")
        daily = evaluate.tripwires(mining.flagged(trades).withColumn("day", F.to_date(F.timestamp_millis("ts"))), "day", int(wire.get("window_days", 3)), wire.get("ppv_lcb_min", 0.5), wire.get("timeout_rate_max", 0.6))
        breached = daily.agg(*[F.array_sort(F.collect_list(F.when(F.col(f"breach_{x}") == 1, F.col("day").cast("string")))).alias(x) for x in ("lcb", "timeout")]).first()  # days of the test months
        kept = trades.select("ts", "side", F.lit(True).alias("enter"))
        out = {
            "decided": evaluate.decided(decided, r_mult).first().asDict(), "scheduled": evaluate.decided(trades.withColumn("enter", F.lit(True)), r_mult).first().asDict(),
            "net_R_after_costs": trades.agg(F.coalesce(F.sum("R"), F.lit(0.0)).alias("r")).first()["r"], "breached": breached.asDict(),
            "parity": evaluate.same_signals(decided, kept, "enter", ["ts", "side"]).first().asDict(),
        }
        artifacts.write_json(self.spark, out, f"{self.root}/simulation.json")
        artifacts.write_json(self.spark, artifacts.fingerprint(self.cfg, {s: self.table(s) for s in ("labels", "rules", "decided", "trades")}), f"{self.root}/fingerprint.json")
        return out


def run(spark: SparkSession, cfg: dict, stages: tuple[str, ...] = STAGES, force: bool = False) -> list[dict]:
    """Runs the stages of all folds; one summary for each fold."""
    cfg = validated(cfg)
    months = [r["ym"] for r in series.month_range(spark, cfg["data"]["months"]["start"], cfg["data"]["months"]["end"]).collect()]
    wf, out = cfg["walkforward"], []
    for symbol in cfg["data"]["symbols"]:
        for number, train, test in series.folds(months, wf["train_months"], wf["test_months"], wf.get("step_months", 1)):
            fold = Fold(spark, cfg, symbol, number, train, test, force)
            out.append({"symbol": symbol, "fold": number} | {s: fold.table(s).count() for s in stages})
            if "trades" in stages:
                out[-1]["simulation"] = fold.report()
    return out


def main(argv: list[str] | None = None) -> None:
    import yaml

    parser = argparse.ArgumentParser(prog="walkforward")
    parser.add_argument("--config", required=True)
    parser.add_argument("--only", choices=STAGES)
    parser.add_argument("--from", dest="first", choices=STAGES, default=STAGES[0])
    parser.add_argument("--until", dest="last", choices=STAGES, default=STAGES[-1])
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    with open(args.config, encoding="utf-8-sig") as file:
        cfg = yaml.safe_load(file)
    stages = (args.only,) if args.only else STAGES[STAGES.index(args.first) : STAGES.index(args.last) + 1]
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(spark, cfg, stages, args.force), indent=2))
    except Exception as error:
        write_report(spark, error, cfg.get("io", {}).get("outputs_root", "outputs"))
        raise


if __name__ == "__main__":
    main()
