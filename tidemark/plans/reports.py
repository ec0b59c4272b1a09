"""Reports over finished folds.

    python -m tidemark.plans.reports {months,truth,parity} ROOT [--other ROOT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import month_of
from tidemark.operators import evaluate, mining
from tidemark.sources.artifacts import events_of_folds


def by_fold_and_month(events: DataFrame) -> DataFrame:
    """Counts and rates of each fold and month, and of each fold over all months (ym null)."""
    ev = mining.flagged(events.withColumn("ym", month_of(F.col("ts"))))
    sums = [F.count("*").alias("n"), F.sum("is_win").alias("wins"), F.sum("is_loss").alias("losses"), F.sum("is_to").alias("timeouts")]
    out = ev.rollup("fold", "ym").agg(*sums).where("fold IS NOT NULL")
    return out.withColumns({"timeout_rate": F.round(F.col("timeouts") / F.col("n"), 3), "ppv": F.round(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), 3)})


def truth(rules: DataFrame, trades: DataFrame) -> DataFrame:
    """Each rule's lower bound in training against its precision in the test trades: holds where the test reaches it."""
    done = trades.groupBy("rule_id").agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"))
    out = rules.select("rule_id", F.col("precision_lcb").alias("train_lcb")).join(done, "rule_id", "left").na.fill(0, ["wins", "losses"])
    return out.withColumn("test_ppv", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))).withColumn("holds", F.col("test_ppv") >= F.col("train_lcb"))


def with_labels(cands: DataFrame, events: DataFrame, keys: list[str], fallback: str = "ts") -> DataFrame:
    """Candidates with the last label of their full key; if none matches at all, with that of `fallback` alone."""
    def last(by: list[str]) -> DataFrame:
        newest = Window.partitionBy(*by).orderBy(F.desc("outcome_ts"), F.desc("outcome"))
        return events.withColumn("__n", F.row_number().over(newest)).where("__n = 1").select(*by, "outcome", "outcome_ts")

    if cands.join(events, keys, "left_semi").isEmpty():
        return cands.join(last([fallback]), fallback, "left")
    return cands.join(last(keys), keys, "left")


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Trades (symbol, ts, side) that only one of two runs has (only_in: a or b), or with another outcome or an R further apart than the tolerance (only_in: differs)."""
    keys = ["symbol", "ts", "side"]
    both = a.select(*keys, F.col("outcome").alias("oa"), F.col("R").alias("ra")).join(b.select(*keys, F.col("outcome").alias("ob"), F.col("R").alias("rb")), keys)
    apart = ~F.col("oa").eqNullSafe(F.col("ob")) | F.coalesce(F.abs(F.col("ra") - F.col("rb")) > tolerance, ~F.col("ra").eqNullSafe(F.col("rb")))
    return evaluate.set_difference(a, b, keys).unionByName(both.where(apart).select(*keys, F.lit("differs").alias("only_in")).distinct())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="reports")
    parser.add_argument("report", choices=("months", "truth", "parity"))
    parser.add_argument("root")
    parser.add_argument("--other")
    args = parser.parse_args(argv)
    if args.report == "parity" and not args.other:
        parser.error("parity needs --other")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.report == "months":
        by_fold_and_month(events_of_folds(spark, args.root)).orderBy("fold", F.col("ym").asc_nulls_last()).show(1000, False)
    elif args.report == "truth":
        truth(events_of_folds(spark, args.root, "rules"), events_of_folds(spark, args.root, "trades")).orderBy(F.desc("train_lcb")).show(1000, False)
    else:
        a, b = (events_of_folds(spark, r, "trades") for r in (args.root, args.other))
        differing = differences(a, b)
        differing.show(20, False)
        raise SystemExit(0 if differing.isEmpty() else 1)


if __name__ == "__main__":
    main()
