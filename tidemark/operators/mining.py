"""Rule mining over literals of labelled events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson
from tidemark.sources.staging import saved

_FLAGS = ("is_win", "is_loss", "is_to")
#: A task holds the sums of one month; it hands them on as a row for each first literal when the month ends.
_PAIRS = "i int, ym string, sums binary"


def counts() -> list[Column]:
    return [F.sum("is_win").alias("wins"), F.sum("is_loss").alias("losses"), F.sum("is_to").alias("timeouts")]


def flagged(events: DataFrame) -> DataFrame:
    """Adds is_win, is_loss, is_to as 0 or 1."""
    return events.withColumns({k: (F.col("outcome") == v).cast("int") for k, v in (("is_win", "win"), ("is_loss", "loss"), ("is_to", "timeout"))})


def baseline(events: DataFrame) -> DataFrame:
    """One row: base_p, the part of wins among resolved events, and base_resolve, the part that is resolved."""
    done = F.sum(F.col("is_win") + F.col("is_loss"))
    return events.agg(F.coalesce(F.try_divide(F.sum("is_win"), done), F.lit(0.0)).alias("base_p"), F.coalesce(F.try_divide(done, F.count("*")), F.lit(0.0)).alias("base_resolve"))


def literals(events: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each event and literal column with a value: lit, val, the flags and ym."""
    pairs = F.array(*[F.struct(F.lit(c).alias("lit"), F.col(c).cast("long").alias("val")) for c in columns])
    return events.select("ym", "is_win", "is_loss", "is_to", F.explode(pairs).alias("l")).select("l.lit", "l.val", "ym", "is_win", "is_loss", "is_to").where("val IS NOT NULL")


def _rated(monthly: DataFrame, keys: list[str], base: DataFrame, include_timeouts: bool, z: float) -> DataFrame:
    """Rule statistics from monthly counts; the baseline is a broadcast row."""
    shown = F.col("wins") + F.col("losses") + (F.col("timeouts") if include_timeouts else F.lit(0))
    monthly = monthly.crossJoin(F.broadcast(base))
    lift_month = F.when(F.col("base_p") > 0, F.coalesce(F.try_divide(F.col("wins"), shown) > F.col("base_p"), F.lit(False))).otherwise(F.col("wins") > 0)
    rules = monthly.groupBy(*keys).agg(
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("timeouts").alias("timeouts"), F.count("*").alias("unique_months"), F.count_if(lift_month).alias("months_with_lift"), F.first("base_p").alias("base_p"), F.first("base_resolve").alias("base_resolve"),
    )
    size = F.col("wins") + F.col("losses") + F.col("timeouts")
    rules = rules.withColumn("support_n", size if include_timeouts else F.col("wins") + F.col("losses"))
    low, high = wilson(F.col("wins"), F.col("support_n"), z)
    rules = rules.withColumns({
        "resolve_frac": (F.col("wins") + F.col("losses")) / size, "timeout_rate": F.col("timeouts") / size, "precision": F.coalesce(F.try_divide(F.col("wins"), F.col("support_n")), F.lit(0.0)), "precision_lcb": low, "precision_ucb": high,
    })
    return rules.withColumns({"lift": F.try_divide(F.col("precision"), F.col("base_p")), "lift_lcb": F.try_divide(F.col("precision_lcb"), F.col("base_p"))})


def _registered(rules: DataFrame, min_support: int, min_wins: int, min_months: int, min_resolve: float, max_timeout: float) -> DataFrame:
    """Registration: resolve and timeout tests use the denominator of the precision."""
    n = F.col("support_n")
    return rules.where((n >= min_support) & (F.col("wins") >= min_wins) & (F.col("unique_months") >= min_months) & (F.coalesce(F.try_divide(F.col("wins") + F.col("losses"), n), F.lit(0.0)) >= min_resolve) & (F.coalesce(F.try_divide(F.col("timeouts"), n), F.lit(0.0)) <= max_timeout))


def mine_single(events: DataFrame, columns: list[str], min_support: int = 24, min_wins: int = 4, min_months: int = 4, include_timeouts: bool = False, min_resolve: float = 0.25, max_timeout: float = 0.6, z: float = 1.96) -> DataFrame:
    """Rules of one literal. Counts by month are aggregated before they are shuffled; there are as many as literal values and months."""
    monthly = literals(events, columns).groupBy("lit", "val", "ym").agg(*counts())
    rules = _registered(_rated(monthly, ["lit", "val"], baseline(events), include_timeouts, z), min_support, min_wins, min_months, min_resolve, max_timeout)
    return rules.withColumn("rule_id", rule_id(("lit", "val")))


def mine_pairs(events: DataFrame, columns: list[str], min_support: int = 24, min_wins: int = 4, min_months: int = 4, include_timeouts: bool = False, min_resolve: float = 0.25, max_timeout: float = 0.6, z: float = 1.96) -> DataFrame:
    """Rules of two literals of different columns.

    Support, wins and months of a pair can't exceed its literals', so literals below them are dropped first; those
    left, columns times bins at most, go to the tasks. Each task sorts its rows by month and counts a month's pairs
    as products of 0/1 matrices over Arrow batches; it hands on one packed row for each first literal and month, whatever
    number of literals a row has (memory: three counts for each pair of literals). The packed rows of a literal are
    added up, and its pairs below the limits end there.
    """
    events = saved(events.select("ym", *_FLAGS, *columns), "mining-events")
    one = saved(literals(events, columns).groupBy("lit", "val", "ym").agg(*counts()), "mining-literals")
    size = F.sum(F.col("wins") + F.col("losses") + (F.col("timeouts") if include_timeouts else F.lit(0)))
    viable = one.groupBy("lit", "val").agg(size.alias("n"), F.sum("wins").alias("w"), F.countDistinct("ym").alias("m"))
    viable = viable.where((F.col("n") >= min_support) & (F.col("w") >= min_wins) & (F.col("m") >= min_months))
    chosen = sorted((r["lit"], r["val"]) for r in viable.select("lit", "val").collect())
    rows = events.select(F.col("ym").cast("string").alias("ym"), *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in _FLAGS], *[F.col(c).cast("long").alias(f"l_{c}") for c in columns])
    packed = rows.sortWithinPartitions("ym").mapInArrow(_pair_counts(chosen), _PAIRS)
    monthly = packed.groupBy("i").applyInArrow(_pair_sums(chosen, min_support, min_wins, min_months, include_timeouts), "lit1 string, val1 long, lit2 string, val2 long, ym string, wins long, losses long, timeouts long")
    keys = ["lit1", "val1", "lit2", "val2"]
    rules = _registered(_rated(monthly, keys, baseline(events), include_timeouts, z), min_support, min_wins, min_months, min_resolve, max_timeout)
    return rules.withColumn("rule_id", rule_id(("lit1", "val1"), ("lit2", "val2")))


def _pair_counts(chosen: list[tuple[str, int]]):
    """For each month of a partition sorted by month and each chosen literal i, the wins, losses and timeouts of its pairs with the later ones (three runs of unsigned 64-bit counts)."""
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(chosen):
        places.setdefault(name, []).append(i)

    def summed(month: str | None, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = [i for i in range(len(chosen)) if sums[:, i, i + 1 :].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([month] * len(some), pa.string()), pa.array([sums[:, i, i + 1 :].astype("<u8").tobytes() for i in some], pa.binary())], names=["i", "ym", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, None
        for batch in batches:
            held = np.zeros((batch.num_rows, len(chosen)), dtype=np.float32)  # exact: a batch has fewer rows than 2**24
            for name, at in places.items():
                column = batch.column(f"l_{name}")
                for i in at:
                    held[:, i] = pc.fill_null(pc.equal(column, chosen[i][1]), False).to_numpy(zero_copy_only=False)
            months = batch.column("ym").dictionary_encode()
            codes = pc.fill_null(months.indices, -1).to_numpy(zero_copy_only=False)
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in _FLAGS]
            for code in codes[np.flatnonzero(np.diff(codes, prepend=-2))]:
                month = None if code < 0 else months.dictionary[int(code)].as_py()
                if sums is not None and month != current:
                    yield from summed(current, sums)
                    sums = None
                current, sums = month, np.zeros((len(_FLAGS), len(chosen), len(chosen))) if sums is None else sums
                for k, flag in enumerate(flags):
                    part = held[(codes == code) & (flag > 0)]
                    sums[k] += part.T @ part
        if sums is not None:
            yield from summed(current, sums)

    return count


def _pair_sums(chosen: list[tuple[str, int]], min_support: int, min_wins: int, min_months: int, include_timeouts: bool):
    """Monthly counts of the pairs of one first literal, added up over tasks; only pairs that reach the limits over all months."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        later = chosen[i + 1 :]
        months: dict[str | None, np.ndarray] = {}
        for month, sums in zip(table.column("ym").to_pylist(), table.column("sums"), strict=True):
            months.setdefault(month, np.zeros((len(_FLAGS), len(later)), dtype=np.int64))
            months[month] += np.frombuffer(sums.as_py(), "<u8").reshape(len(_FLAGS), -1).astype(np.int64)
        every = np.stack(list(months.values()))
        wins, shown = every[:, 0].sum(axis=0), every[:, : 3 if include_timeouts else 2].sum(axis=(0, 1))
        good = (shown >= min_support) & (wins >= min_wins) & (every.any(axis=1).sum(axis=0) >= min_months) & np.array([name != chosen[i][0] for name, _ in later], dtype=bool)
        at, j = np.nonzero(every.any(axis=1) & good)
        names, values = pa.array([n for n, _ in later], pa.string()), pa.array([v for _, v in later], pa.int64())
        columns = [pa.array([chosen[i][0]] * len(j), pa.string()), pa.array([chosen[i][1]] * len(j), pa.int64()), names.take(pa.array(j)), values.take(pa.array(j)), pa.array(list(months), pa.string()).take(pa.array(at))]
        return pa.table(columns + [pa.array(every[at, k, j]) for k in range(len(_FLAGS))], names=["lit1", "val1", "lit2", "val2", "ym", "wins", "losses", "timeouts"])

    return run


def rule_id(*conditions: tuple[str, str]) -> Column:
    """Canonical id: conditions `column==value`, sorted, joined by ` & `."""
    return F.array_join(F.array_sort(F.array(*[F.concat(F.col(a), F.lit("=="), F.col(b).cast("string")) for a, b in conditions])), " & ")


def false_discovery(rules: DataFrame, p: Column, alpha: float = 0.1) -> DataFrame:
    """Adds pval, qval and rejected by Benjamini-Hochberg over all rules (a small table: one row for each rule)."""
    up = Window.orderBy("pval", "rule_id")
    df = rules.withColumn("pval", p).withColumns({"__k": F.row_number().over(up), "__m": F.count("*").over(Window.partitionBy())})
    df = df.withColumn("__q", F.col("pval") * F.col("__m") / F.col("__k"))
    df = df.withColumn("qval", F.least(F.lit(1.0), F.min("__q").over(Window.orderBy(F.desc("__k")))))
    limit = F.max(F.when(F.col("pval") <= F.col("__k") * alpha / F.col("__m"), F.col("__k"))).over(Window.partitionBy())
    return df.withColumn("rejected", (F.col("__k") <= F.coalesce(limit, F.lit(0))).cast("int")).drop("__k", "__m", "__q")


def promoted(rules: DataFrame, top_k: int = 60, uplift: float = 0.0, uplift_pp: float = 0.0, min_lift_lcb: float = 0.0, min_resolve: float = 0.25, resolve_uplift_pp: float = 0.0, max_timeout: float = 0.6, min_wins: int = 4, min_lcb: float = 0.0) -> DataFrame:
    """The top_k rules by lower bound (then support, id) that meet the final thresholds."""
    good = (F.col("precision_lcb") >= F.greatest(F.col("base_p") + uplift, F.col("base_p") + uplift_pp / 100)) & (F.coalesce("lift_lcb", F.lit(0.0)) >= min_lift_lcb)
    good = good & (F.col("resolve_frac") >= F.greatest(F.lit(min_resolve), F.least(F.lit(0.99), F.col("base_resolve") + resolve_uplift_pp / 100))) & (F.col("timeout_rate") <= max_timeout) & (F.col("precision_lcb") >= min_lcb) & (F.col("wins") >= min_wins)
    return rules.where(good).orderBy(F.desc("precision_lcb"), F.desc("support_n"), "rule_id").limit(top_k)


def losers(rules: DataFrame, top_k: int = 8, max_ucb: float = 0.35, min_resolve: float = 0.4, min_months: int = 2) -> DataFrame:
    """The top_k rules with the least upper bound."""
    bad = (F.col("resolve_frac") >= min_resolve) & (F.col("unique_months") >= min_months) & (F.col("precision_ucb") <= max_ucb)
    return rules.where(bad).orderBy("precision_ucb", F.desc("support_n"), "rule_id").limit(top_k)


_OPS = {"==": lambda x, t: x == t, ">=": lambda x, t: x >= t, "<=": lambda x, t: x <= t, ">": lambda x, t: x > t, "<": lambda x, t: x < t}


def first_match(rules: list[tuple[str, list[tuple[str, str, float]]]]) -> Column:
    """Id of the first rule all of whose conditions (column, operator, threshold) hold; null never matches, nor does an unknown operator."""
    cases = []
    for name, conditions in rules:
        hit = F.lit(True)
        for column, op, limit in conditions:
            hit = hit & (F.coalesce(_OPS[op](F.col(column), F.lit(limit)), F.lit(False)) if op in _OPS else F.lit(False))
        cases.append(F.when(hit, F.lit(name)))
    return F.coalesce(*cases, F.lit(None).cast("string")) if cases else F.lit(None).cast("string")


def any_literal(groups: list[list[tuple[str, int]]], columns: list[str]) -> Column:
    """Whether all literals of some group hold; a group with an unknown column never does, an empty one always."""
    out = F.lit(False)
    for group in groups:
        hit = F.lit(all(c in columns for c, _ in group))
        for c, v in group:
            hit = hit & F.coalesce(F.col(c) == v, F.lit(False)) if c in columns else F.lit(False)
        out = out | hit
    return out
