"""Exact quantiles of many columns and series at once, without holding a series' values anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import saved

#: A sketch bounds each quantile's rank to this part of the rows; the exact one is looked for between bounds three times as far.
ACCURACY = 10_000
#: Rows of a series up to which its values are held.
FEW = 20_000


def _bounds(x: DataFrame, n: int, at: Sequence[float], keys: list[str], wide: bool) -> DataFrame:
    """n<i>, lo<i>, hi<i> by series: the number of values of x<i> and, for each quantile, values that bound it."""
    slack = 3 / ACCURACY
    out = x.groupBy(*keys).agg(
        *[e for i in range(n) for e in (
            F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"min{i}"), F.max(f"x{i}").alias(f"max{i}"),
            F.percentile_approx(f"x{i}", [max(0.0, p - slack) for p in at], ACCURACY).alias(f"l{i}"), F.percentile_approx(f"x{i}", [min(1.0, p + slack) for p in at], ACCURACY).alias(f"h{i}"),
        )]
    )
    # Few values, of which neighbours can be further apart than the slack, are all looked at.
    near = lambda i, bound, end: F.transform(bound, lambda b: F.when(F.lit(wide) | (F.col(f"n{i}") < 4 * ACCURACY), F.col(end)).otherwise(b))
    return out.select(*keys, *[c for i in range(n) for c in (F.col(f"n{i}"), near(i, f"l{i}", f"min{i}").alias(f"lo{i}"), near(i, f"h{i}", f"max{i}").alias(f"hi{i}"))])


def _edges(x: DataFrame, n: int, at: Sequence[float], keys: list[str], wide: bool) -> DataFrame:
    """c, e, edge by series, a row for each column and quantile."""
    bounds = saved(_bounds(x, n, at, keys, wide), "quantile-bounds")
    named = bounds.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = x.join(named, same) if keys else x.crossJoin(F.broadcast(named))
    # By a the lower bounds and by b the upper bounds that a value is past: it lies between those of the quantiles b to a - 1.
    cell = lambda i: F.struct(F.lit(i).alias("c"), F.size(F.filter(f"lo{i}", lambda v: v <= F.col(f"x{i}"))).alias("a"), F.size(F.filter(f"hi{i}", lambda v: v < F.col(f"x{i}"))).alias("b"), F.col(f"x{i}").alias("v"))
    cells = both.select(*keys, F.explode(F.array(*[cell(i) for i in range(n)])).alias("p")).where("p.v IS NOT NULL")
    counted = cells.groupBy(*keys, "p.c", "p.a", "p.b", F.when(F.expr("p.b < p.a"), F.col("p.v")).alias("v")).agg(F.count("*").alias("m"))
    counted = saved(counted, "quantile-cells")
    per = Window.partitionBy(*keys, "c", "e")
    inside = counted.where("b < a").select(*keys, "c", F.expr("explode(sequence(b, a - 1))").alias("e"), "v", "m", F.lit(0).alias("below"))
    under = counted.where(f"a < {len(at)}").select(*keys, "c", F.expr(f"explode(sequence(a, {len(at) - 1}))").alias("e"), F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("m"), F.col("m").alias("below"))
    under = under.groupBy(*keys, "c", "e").agg(F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("m"), F.sum("below").alias("below"))
    ranked = inside.unionByName(under).withColumns({"last": F.sum("m").over(per.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) + F.sum("below").over(per) - 1})
    ranked = ranked.where("v IS NOT NULL").withColumn("first", F.col("last") - F.col("m") + 1)
    sizes = bounds.select(*keys, F.posexplode(F.array(*[F.col(f"n{i}") for i in range(n)])).alias("c", "n")).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)} | {"c": "__c"})
    ranked = ranked.join(sizes, [*same, F.col("c") == F.col("__c")]).drop("__c", *[f"__k{i}" for i in range(len(keys))])
    place = F.get(F.array(*[F.lit(p) for p in at]), F.col("e")) * (F.col("n") - 1)
    here = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))
    ends = ranked.withColumn("at", place).groupBy(*keys, "c", "e", "at").agg(here(F.floor("at")).alias("lower"), here(F.ceil("at")).alias("upper"))
    between = (F.ceil("at") - F.col("at")) * F.col("lower") + (F.col("at") - F.floor("at")) * F.col("upper")
    return saved(ends.select(*keys, "c", "e", F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between).alias("edge")), "quantiles")


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row a series: q_<column>, the quantiles `at` (rising) of its values, on a line between neighbours; null without values.

    Where no series has more than FEW rows, Spark's exact percentile finds them, whose buffers then are no larger. Else:

    1. A sketch gives, for each quantile, two values that it lies between.
    2. A second pass counts the values below, and those between by value: a few in ACCURACY of all, whatever their number.
    3. Ranks among those give the exact neighbours. Should a sketch's bounds miss one, the pass is made over all values.

    df is read once and its columns are staged. Null and NaN are no values.
    """
    keys, n = list(keys), len(columns)
    plain = [F.col(c).cast("double") for c in columns]
    x = saved(df.select(*keys, *[F.when(~F.isnan(c), c).alias(f"x{i}") for i, c in enumerate(plain)]), "quantile-values")
    most = x.groupBy(*keys).agg(F.count("*").alias("m")).agg(F.max("m").alias("m")).first()["m"] or 0
    if most <= FEW:
        places = F.array(*[F.lit(p) for p in at])
        return x.groupBy(*keys).agg(*[F.percentile(f"x{i}", places).alias(f"q_{c}") for i, c in enumerate(columns)])
    edges = _edges(x, n, at, keys, wide=False)
    if not edges.where("edge IS NULL").isEmpty():
        edges = _edges(x, n, at, keys, wide=True)
    lists = [F.array_sort(F.collect_list(F.when(F.col("c") == i, F.struct("e", "edge")))) for i in range(n)]
    found = edges.groupBy(*keys).agg(*[F.when(F.size(q) > 0, F.transform(q, lambda s: s["edge"])).alias(f"q_{c}") for q, c in zip(lists, columns, strict=True)])
    if not keys:
        return found
    every = x.select(*keys).distinct().withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    joined = every.join(found, [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)], "left")
    return joined.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[f"q_{c}" for c in columns])
