"""Metrics of scored events: precision, calibration, drift, thresholds, and reports by month and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import safe_div, wilson
from tidemark.operators import pieces as P


def _by_score(df: DataFrame, p: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each score p (null first), with the sums, and before_<name> and all_<name>: their sums over lower scores and over all; sorted in pieces."""
    by_score = df.groupBy(F.col(p).alias("p")).agg(*[v.alias(n) for n, v in sums.items()])
    rows = P.prefixed(P.pieced(by_score, [], [F.col("p")]), [], [F.col("p")], {f"before_{n}": F.col(n) for n in sums}, totals=True)
    return rows.withColumnsRenamed({f"all_before_{n}": f"all_{n}" for n in sums})


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    """One row: average_precision, the sum of precision times gain in recall over falling scores; equal scores count together.

    Aggregated to distinct scores first; a null score is the lowest.
    """
    run = _by_score(df, p, {"tp": F.sum(y), "n": F.count("*")})
    above = lambda x: F.col(f"all_{x}") - F.col(f"before_{x}")
    return run.agg(F.try_divide(F.sum(F.col("tp") * above("tp") / above("n")), F.sum("tp")).alias("average_precision"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def calibration_error(df: DataFrame, p: str, y: str, n_bins: int, tie: str) -> DataFrame:
    """One row: ece over bins of equal count in order of score, cut at floor(i * n / n_bins)."""
    df = P.prefixed(P.pieced(df, [], [F.col(p), F.col(tie)]), [], [F.col(p), F.col(tie)], {"__i": F.lit(1)}, totals=True).withColumnRenamed("all___i", "__n")
    cuts = F.array(*[F.floor(F.lit(i) * F.col("__n") / n_bins) for i in range(1, n_bins)])
    df = df.withColumn("__bin", F.size(F.filter(cuts, lambda c: c <= F.col("__i"))))
    bins = df.groupBy("__bin").agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, p: str, y: str, n_bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate for bins of equal width; a score of 1 is in the last."""
    at = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")
    return df.groupBy(at).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def month_drift(df: DataFrame, month: str, bin_: str) -> DataFrame:
    """One row: max_js, the largest Jensen-Shannon distance between the bin shares of two months.

    Months and bins are few; only their counts are joined.
    """
    counts = df.groupBy(F.col(month).alias("m"), F.col(bin_).alias("b")).agg(F.count("*").alias("n"))
    months, bins = counts.select("m").distinct(), counts.select("b").distinct()
    grid = months.crossJoin(bins).join(counts, ["m", "b"], "left")
    share = grid.withColumn("q", F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy("m"))).select("m", "b", "q")
    other = share.select(F.col("m").alias("m2"), "b", F.col("q").alias("q2"))
    both = share.join(other, "b").where("m < m2").withColumn("mid", (F.col("q") + F.col("q2")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("mid"))).otherwise(0.0)
    js = both.groupBy("m", "m2").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("q") + part("q2")) / 2))).alias("js"))
    return js.agg(F.max("js").alias("max_js"))


def threshold(df: DataFrame, p: str, y: str, target: float, min_cov: float, n_quantiles: int = 201) -> DataFrame:
    """One row: tau, ppv, ppv_lcb, cov. Over quantiles of the score from above, the first whose lower bound of the
    precision reaches the target; else the best bound with at least min_cov of the rows. Rows without y count for
    coverage only; a score reaches tau if it is equal to it.
    """
    sums = {"tp": F.sum(F.coalesce(y, F.lit(0))), "pos": F.count(y), "n": F.count("*"), "none": F.sum(F.when(F.col(p).isNull(), 1).otherwise(0))}
    rows = _by_score(df, p, sums).where("p IS NOT NULL").withColumn("first", F.col("before_n") - F.col("all_none"))
    rows = rows.withColumns({"last": F.col("first") + F.col("n") - 1, "top": F.col("all_n") - F.col("all_none") - 1})
    step = (n_quantiles - 1) / F.greatest(F.col("top"), F.lit(1))
    near = F.sequence(F.greatest(F.floor((F.col("first") - 1) * step), F.lit(0).cast("long")), F.least(F.ceil((F.col("last") + 1) * step), F.lit(n_quantiles - 1).cast("long")))
    upwards = F.struct("p", *[(F.col(f"all_{x}") - F.col(f"before_{x}")).alias(f"c{x}") for x in ("tp", "pos", "n")], "tp", "pos", "n")
    rows = rows.select("first", "last", "top", upwards.alias("s"), F.col("all_n").alias("of"), F.explode(near).alias("i")).withColumn("at", F.col("top") * (F.col("i") / (n_quantiles - 1)))
    here = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("s")))
    ends = rows.groupBy("i", "at", "of").agg(here(F.floor("at")).alias("a"), here(F.ceil("at")).alias("b"))
    between = (F.ceil("at") - F.col("at")) * F.col("a.p") + (F.col("at") - F.floor("at")) * F.col("b.p")
    ends = ends.withColumn("tau", F.when(F.col("a.p") == F.col("b.p"), F.col("a.p")).otherwise(between).cast("double"))
    # Rows that reach tau: from the lower neighbour on, from the upper one, or (tau rounded up) from the next.
    reach = lambda x: F.when(F.col("tau") <= F.col("a.p"), F.col(f"a.c{x}")).when(F.col("tau") <= F.col("b.p"), F.col(f"b.c{x}")).otherwise(F.col(f"b.c{x}") - F.col(f"b.{x}")).alias(f"c{x}")
    run = ends.where("tau IS NOT NULL").select("tau", "of", *[reach(x) for x in ("tp", "pos", "n")]).dropDuplicates(["tau"])
    low, _ = wilson(F.col("ctp"), F.col("cpos"))
    run = run.select("tau", F.coalesce(F.try_divide(F.col("ctp"), F.col("cpos")), F.lit(0.0)).alias("ppv"), low.alias("ppv_lcb"), (F.col("cn") / F.col("of")).alias("cov")).where("cov > 0")
    rank = F.when(F.col("ppv_lcb") >= target, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"), (-F.col("tau")).alias("c"))).when((F.col("cov") >= min_cov) & (F.col("ppv_lcb") > 0), F.struct(F.lit(1).alias("a"), (-F.col("ppv_lcb")).alias("b"), (-F.col("tau")).alias("c")))
    return run.where(rank.isNotNull()).orderBy(rank).limit(1)


def by_month(events: DataFrame) -> DataFrame:
    """Counts and rates by month; ppv is null where nothing is resolved."""
    done = F.col("wins") + F.col("losses")
    out = events.groupBy("ym").agg(F.count("*").alias("n"), F.sum("is_win").alias("wins"), F.sum("is_loss").alias("losses"), F.sum("is_to").alias("timeouts"))
    return out.withColumns({"resolved_rate": F.round(done / F.col("n"), 3), "timeout_rate": F.round(F.col("timeouts") / F.col("n"), 3), "ppv": F.round(F.try_divide(F.col("wins"), done), 3)})


def tripwires(events: DataFrame, day: str, n_days: int = 3, min_lcb: float = 0.5, max_timeout: float = 0.6) -> DataFrame:
    """Rolling counts over the last n_days rows of the daily table, their bounds and whether they breach the limits."""
    daily = events.groupBy(F.col(day).alias("day")).agg(F.sum("is_win").alias("w"), F.sum("is_loss").alias("l"), F.sum("is_to").alias("t"))
    last = Window.orderBy("day").rowsBetween(-(n_days - 1), 0)
    out = daily.withColumns({f"r{x}": F.sum(x).over(last) for x in ("w", "l", "t")})
    low, _ = wilson(F.col("rw"), F.col("rw") + F.col("rl"))
    out = out.withColumns({"lcb": low, "timeout_rate": safe_div(F.col("rt").cast("double"), (F.col("rw") + F.col("rl") + F.col("rt")).cast("double"))})
    return out.withColumns({"breach_lcb": (F.col("lcb") < min_lcb).cast("int"), "breach_timeout": (F.col("timeout_rate") > max_timeout).cast("int")})


def decided(events: DataFrame, r_mult: float) -> DataFrame:
    """One row: entries, wins, losses, timeouts, coverage, ppv, ppv_lcb, net_R, avg_R; `enter` marks the entered ones."""
    go = F.coalesce("enter", F.lit(False))
    count = lambda o: F.count_if(go & (F.col("outcome") == o))
    one = events.agg(F.count("*").alias("n"), F.count_if(go).alias("entries"), count("win").alias("wins"), count("loss").alias("losses"), count("timeout").alias("timeouts"))
    low, _ = wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    net = F.col("wins") * r_mult - F.col("losses")
    return one.withColumns({"coverage": F.coalesce(F.try_divide(F.col("entries"), F.col("n")), F.lit(0.0)), "ppv": F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0)), "ppv_lcb": low, "net_R": net, "avg_R": F.coalesce(F.try_divide(net, F.col("wins") + F.col("losses")), F.lit(0.0))})


def same_signals(a: DataFrame, b: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """One row: mismatches of a flag between two tables (missing counts as false), and the rows compared."""
    both = a.select(*keys, F.col(flag).alias("fa")).join(b.select(*keys, F.col(flag).alias("fb")), keys, "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("fa", F.lit(False)) != F.coalesce("fb", F.lit(False))).alias("mismatches"))


def same_trades(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row: trades whose exit differs, and whose R differs by more than the tolerance (a missing R doesn't count)."""
    both = a.select(*keys, F.col("exit_type").alias("ea"), F.col("R").alias("ra")).join(b.select(*keys, F.col("exit_type").alias("eb"), F.col("R").alias("rb")), keys, "full_outer")
    return both.agg(F.count_if(~F.col("ea").eqNullSafe(F.col("eb"))).alias("exit_mismatches"), F.count_if(F.abs(F.col("ra") - F.col("rb")) > tolerance).alias("r_mismatches"))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the tables has, with the side that has them."""
    only = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("only_in", F.lit(name))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def monotone(df: DataFrame, bin_col: str, y: str, slack: float = 0.02) -> DataFrame:
    """One row: rises, falls and monotone, whether the rate of wins by bin never falls (rises) by more than `slack` from a bin to the next; a few bins at most."""
    rates = df.where(F.col(bin_col).isNotNull()).groupBy(F.col(bin_col).alias("__bin")).agg(F.avg(F.col(y).cast("double")).alias("__rate"))
    step = rates.withColumn("__step", F.col("__rate") - F.lag("__rate").over(Window.orderBy("__bin")))
    rises, falls = (F.coalesce(F.min(test), F.lit(True)) for test in (F.col("__step") >= -slack, F.col("__step") <= slack))
    return step.agg(rises.alias("rises"), falls.alias("falls")).withColumn("monotone", F.col("rises") | F.col("falls"))


def least_gap(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """For each key the least time between successive rows; null for a single row."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("__gap", gap).groupBy(*keys).agg(F.min("__gap").alias("min_gap"))
