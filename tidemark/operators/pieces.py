"""Work along sorted series of any length: pieces, prefix sums, affine scans and chains of successors.

A piece is what one task holds of a table sorted by series and order, so a long series lies in many pieces and short
ones share one. Only a row or two for each piece and series cross pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import saved

#: Rows of a series that are chained in one task.
BLOCK = 1 << 16
#: The place after a series' last row, in no block.
END = 1 << 62


def pieced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pieces: int | None = None) -> DataFrame:
    """df, saved, with __piece, which grows along `order` within each series; rows equal in `order` share a piece."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *keys, *order).withColumn("__piece", F.spark_partition_id()), "pieces")


def _joined(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of a table that has a row for each series and piece."""
    names = [*keys, "__piece"]
    other = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(names)})
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
    return rows.join(other, on, "left").drop(*[f"__k{i}" for i in range(len(names))])


def prefixed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], totals: bool = False) -> DataFrame:
    """Adds to a pieced table, for each name in values, the value's sum over the earlier rows of the series and, if totals, all_<name>, its sum over the series.

    Rows must differ in `order` within a series, or their order is arbitrary.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, "__piece").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *keys, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in values],
        *[F.coalesce(F.sum(f"__t_{n}").over(Window.partitionBy(*keys)), F.lit(0)).alias(f"all_{n}") for n in values if totals],
    )
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    return _joined(local, carried, keys).withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in values}).drop(*[f"__c_{n}" for n in values])


def earlier_max(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds to a pieced table the greatest value of the earlier rows of the series, null for the first."""
    keys = list(keys)
    tops = rows.groupBy(*keys, "__piece").agg(F.max(value).alias("__t"))
    carried = tops.select(*keys, "__piece", F.max("__t").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(out, F.max(value).over(inside))
    return _joined(local, carried, keys).withColumn(out, F.greatest(out, "__c")).drop("__c")


def affine_scan(rows: DataFrame, keys: Sequence[str], order: str, x: str, decay: float, out: str) -> DataFrame:
    """Adds to a pieced table y = decay * y before + (1 - decay) * x along each series, begun at the first x; nulls carry it on.

    Each piece is the map carry -> a * carry + b of its last row, found with a carry of 0. The maps of a series, one for
    each piece, are composed in order; each row then adds its own power of the decay times its piece's carry.
    """
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        v = part[x].to_numpy(float)
        known = ~np.isnan(v)
        k = np.cumsum(known)
        values = v[known]
        y = np.zeros(len(values) + 1)
        if len(values):
            own = pd.Series(values).ewm(alpha=1 - decay, adjust=False).mean().to_numpy()
            y[1:] = own - values[0] * decay ** np.arange(1, len(values) + 1)  # as if begun at 0
        return part.assign(__b=y[k], __k=k)

    begun = rows.groupBy(*keys, "__piece").applyInPandas(local, f"{schema}, __b double, __k long")
    begun = saved(begun, "scan")
    ends = begun.groupBy(*keys, "__piece").agg(F.max("__k").alias("k"), F.max_by("__b", order).alias("b"), F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias("first"))

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part, carry, carries, fresh = part.sort_values("__piece"), np.nan, [], []
        for k, b, first in zip(part["k"], part["b"], part["first"], strict=True):
            fresh.append(np.isnan(carry))
            if k and fresh[-1]:
                carry = first  # the first value of all: as its own predecessor it stays what it is
            carries.append(carry)
            carry = decay**k * carry + b if k else carry
        return part[[*keys, "__piece"]].assign(__carry=carries, __fresh=fresh)

    types = ", ".join(f"`{k}` {ends.schema[k].dataType.simpleString()}" for k in keys)
    carried = ends.groupBy(*keys).applyInPandas(composed, f"{types}, __piece int, __carry double, __fresh boolean")
    begun = _joined(begun, carried, keys)
    known = ~F.col("__fresh") | (F.col("__k") > 0)  # else no value has come yet
    return begun.withColumn(out, F.when(known, F.pow(F.lit(decay), F.col("__k")) * F.col("__carry") + F.col("__b"))).drop("__b", "__k", "__carry", "__fresh")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row of a block the first row beyond the block that its chain comes to."""
    rows = rows.sort_values("i")
    first, ahead = int(rows["i"].iloc[0]), rows["next"].tolist()
    out = list(ahead)
    for j in range(len(out) - 1, -1, -1):
        if ahead[j] - first < len(out):
            out[j] = out[ahead[j] - first]
    return rows[["__series", "__block", "i", "next", "__id"]].assign(exit=out)


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Ids of the rows of a block that the chain entering at `entry` comes to."""
    rows = rows.sort_values("i")
    first, ahead, at, met = int(rows["i"].iloc[0]), rows["next"].tolist(), int(rows["entry"].iloc[0]), []
    while at - first < len(ahead):
        met.append(at - first)
        at = ahead[at - first]
    return pd.DataFrame({"__id": rows["__id"].to_numpy()[met]})


def chained(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], free: Column, block: int = BLOCK, pieces: int | None = None) -> DataFrame:
    """Ids of the rows (with `__id`, `ts`) that each series' chain meets: its first row, then each time the first later row with ts >= free.

    1. Rows and their free times are sorted together; counting the rows before each gives a row's place and its successor's.
    2. Places are cut into blocks; within a block each row's chain is followed to where it leaves the block.
    3. Where chains enter blocks, pointers are doubled until the places reached from the first row stop growing: rounds
       in the logarithm of the number of blocks, over the rows at which a block can be entered.
    4. A chain enters a block once at most, and is walked from there.
    """
    series = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    base = rows.select(series.alias("__series"), F.col("ts").alias("t"), "__id", *[c.alias(f"o{i}") for i, c in enumerate(order)], free.alias("free"))
    ties = [f"o{i}" for i in range(len(order))]
    asked = base.select("__series", F.col("free").alias("t"), "__id", *[F.lit(None).cast(base.schema[o].dataType).alias(o) for o in ties], F.lit(0).alias("own"))
    both = pieced(base.select("__series", "t", "__id", *ties, F.lit(1).alias("own")).unionByName(asked), ["__series"], [F.col("t"), F.col("own"), *map(F.col, ties), F.col("__id")], pieces)
    counted = prefixed(both, ["__series"], [F.col("t"), F.col("own"), *map(F.col, ties), F.col("__id")], {"before": F.col("own")}, totals=True)
    pointers = counted.groupBy("__series", "__id").agg(F.max(F.when(F.col("own") == 1, F.col("before"))).alias("i"), F.max(F.when(F.col("own") == 0, F.col("before"))).alias("to"), F.max("all_before").alias("of"))
    following = F.greatest(F.col("to"), F.col("i") + 1)
    pointers = pointers.select("__series", "__id", "i", F.when(following < F.col("of"), following).otherwise(END).alias("next"), F.floor(F.col("i") / block).alias("__block"))
    types = pointers.schema["__series"].dataType.simpleString()
    exits = saved(pointers.groupBy("__series", "__block").applyInPandas(_exits, f"__series {types}, __block long, i long, next long, __id long, exit long"), "exits")

    targets = exits.select(F.col("__series").alias("s"), F.col("exit").alias("node")).distinct()
    jumps = saved(targets.join(exits, (F.col("s") == F.col("__series")) & (F.col("node") == F.col("i"))).select("s", "node", F.col("exit").alias("to")), "jumps")
    met = exits.where("i = 0").select(F.col("__series").alias("s"), F.col("exit").alias("node"))
    if not jumps.isEmpty():
        met, known = saved(met, "met"), -1
        while (count := met.count()) > known:
            known = count
            further = met.join(jumps, ["s", "node"]).select("s", F.col("to").alias("node"))
            met = saved(met.union(further).distinct(), "met")
            onward = jumps.select(F.col("s").alias("s2"), F.col("node").alias("n2"), F.col("to").alias("to2"))
            jumps = saved(jumps.join(onward, (F.col("s") == F.col("s2")) & (F.col("to") == F.col("n2"))).select("s", "node", F.col("to2").alias("to")), "jumps")
    entries = met.union(exits.where("i = 0").select("__series", "i")).select("s", F.floor(F.col("node") / block).alias("b"), F.col("node").alias("entry"))
    entered = exits.join(entries, (F.col("__series") == F.col("s")) & (F.col("__block") == F.col("b"))).drop("s", "b")
    return entered.groupBy("__series", "__block").applyInPandas(_walk, "__id long")
