"""Features of bars: base, non-linear, percentile and age families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.stats import interval_bin, safe_div, sgn
from tidemark.operators import pieces as P
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.sequential import ema
from tidemark.sources.staging import saved

#: Distance to an extreme, in ATR, that counts as near.
NEAR = 0.25


def base_features(bars: DataFrame, atr_n: int = 14, channel_n: int = 20, horizons: tuple[int, int, int] = (240, 60, 15), keys: tuple[str, ...] = W.SERIES) -> DataFrame:
    """atr, true_range, ret_1m, t_<h>, accel, channel, body_dom and distances to the channel's extremes."""
    long, mid, short = horizons
    df = bars.withColumns({"true_range": W.true_range(keys), "ret_1m": W.log_return(F.col("close"), keys)})
    df = ema(df, "true_range", atr_n, "atr", keys)
    hi, lo = W.channel(channel_n, keys)
    t = {f"t_{h}": W.t_stat(F.col("ret_1m"), h, keys) for h in horizons}
    df = df.withColumns(t | {"dch": hi, "dcl": lo}).withColumn("dcw", F.col("dch") - F.col("dcl"))
    atr = F.when(F.col("atr") != 0, F.col("atr"))
    return df.withColumns({
        f"accel_{short}_{long}": F.col(f"t_{short}") - F.col(f"t_{long}"), "body_dom": F.abs(F.col("close") - F.col("open")) / atr,
        "close_to_hi_atr": (F.col("dch") - F.col("close")) / atr, "close_to_lo_atr": (F.col("close") - F.col("dcl")) / atr,
    })


def nonlinear_features(df: DataFrame, include: list[str], small: int = 15, mid: int = 60, horizons: tuple[int, int, int] = (240, 60, 15), keys: tuple[str, ...] = W.SERIES) -> DataFrame:
    """nl_<name> for each included name that the columns allow; unknown names are passed over."""
    a, b, c = horizons
    ta, tb, tc = (F.col(f"t_{h}") for h in horizons)
    near_hi, near_lo = (F.coalesce(F.col(x) <= NEAR, F.lit(False)).cast("int") for x in ("close_to_hi_atr", "close_to_lo_atr"))
    ret = F.coalesce("ret_1m", F.lit(0.0))
    steps = {}
    if "zcr_60" in include:
        steps["__crossed"] = W.crossed(F.col("ret_1m"), keys)
    if "dc_count_60" in include:
        steps["__turned"] = W.turned(F.col("ret_1m"), keys)
    if "volofvol_proxy" in include:
        steps["__tr5"] = W.full(F.avg("true_range"), F.col("true_range"), W.last(5, keys), 3)
    df = df.withColumns(steps) if steps else df
    names: dict[str, Column] = {
        "convexity_15_60_240": tc - 2 * tb + ta, "trend_agree_15_60": (sgn(tc) == sgn(tb)).cast("int"), "trend_agree_60_240": (sgn(tb) == sgn(ta)).cast("int"),
        "trend_ratio_15_60": safe_div(F.abs(tc), F.abs(tb)), "pin_high": near_hi, "pin_low": near_lo, "impulse_near_high": F.col("body_dom") * near_hi, "impulse_near_low": F.col("body_dom") * near_lo,
        "pos_01": safe_div(F.col("close_to_hi_atr"), F.col("close_to_hi_atr") + F.col("close_to_lo_atr")), "sign_entropy_60": W.sign_entropy(ret, mid, keys),
        "rv60_over_atr": safe_div(W.full(F.stddev_samp("ret_1m"), F.col("ret_1m"), W.last(mid, keys), 10), F.col("atr")), "range_ratio_60": W.range_ratio(mid, F.col("atr"), keys),
    }
    if "dcw_p" in df.columns:
        names |= {"squeeze_score": 100 - F.col("dcw_p"), "release_slope_15": F.col("dcw_p") - F.lag("dcw_p", small).over(W.ordered(keys))}
    if "__crossed" in steps:
        names["zcr_60"] = F.avg("__crossed").over(W.last(mid, keys))
    if "__turned" in steps:
        names["dc_count_60"] = F.sum("__turned").over(W.last(mid, keys))
    if "__tr5" in steps:
        names["volofvol_proxy"] = W.full(F.stddev_samp("__tr5"), F.col("__tr5"), W.last(12, keys), 6)
    return df.withColumns({f"nl_{n}": names[n] for n in include if n in names}).drop(*steps)


def _rising(edges: Column) -> Column:
    """Edges of which none equals the one before: such a one is 1e-12 above it."""
    before = lambda done: F.get(done, F.size(done) - 1)
    return F.aggregate(edges, F.array().cast("array<double>"), lambda done, e: F.concat(done, F.array(F.when(e <= before(done), before(done) + 1e-12).otherwise(e))))


def quantile_edges(train: DataFrame, columns: list[str], n_bins: int, keys: tuple[str, ...] = W.SERIES, rising: bool = False) -> DataFrame:
    """One row a series: edges_<column>, the inner linear-interpolation quantiles of the training rows; rising: without equal ones."""
    found = exact_quantiles(train, columns, [i / n_bins for i in range(1, n_bins)], keys)
    return found.select(*keys, *[(_rising(F.col(f"q_{c}")) if rising else F.col(f"q_{c}")).alias(f"edges_{c}") for c in columns])


def with_bins(df: DataFrame, edges: DataFrame, columns: list[str], n_bins: int, prefix: str = "qbin_", keys: tuple[str, ...] = W.SERIES, null_bin: Column | None = None) -> DataFrame:
    """Adds prefix + column: the bin by the fitted edges; null goes to null_bin, the top bin if none is given."""
    joined = df.join(edges, list(keys), "left")
    bins = {f"{prefix}{c}": interval_bin(F.col(c), F.coalesce(f"edges_{c}", F.array().cast("array<double>")), n_bins, null_bin) for c in columns}
    return joined.withColumns(bins).drop(*[f"edges_{c}" for c in columns])


def train_ranks(df: DataFrame, ranks: dict[str, str], is_train: str, keys: tuple[str, ...] = W.SERIES, pieces: int | None = None) -> DataFrame:
    """For each column x of `ranks` its rank: the percentage of the series' training values that are <= x; 100 for null x, null without training values.

    Only distinct values are put in order, in pieces, with the number of training rows that have them. df is read once and staged.
    """
    rows = saved(df, "ranked")
    for x, out in ranks.items():
        values = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("__x")).agg(F.count_if(is_train).alias("__n"))
        counted = P.prefixed(P.pieced(values, keys, [F.col("__x")], pieces), keys, [F.col("__x")], {"__before": F.col("__n")}, totals=True)
        table = counted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__x", F.try_divide((F.col("__before") + F.col("__n")) * 100.0, F.col("all___before")).alias(out), (F.col("all___before") > 0).alias("__some"))
        table = saved(table, "ranks")
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        some = table.where("__some").select(*[f"__k{i}" for i in range(len(keys))], F.lit(100.0).alias("__top")).distinct()
        ids = [f"__k{i}" for i in range(len(keys))]
        rows = rows.join(table.drop("__some"), [*same, F.col(x) == F.col("__x")], "left").drop("__x", *ids)
        rows = rows.join(some, same, "left").withColumn(out, F.when(F.col(x).isNull(), F.col("__top")).otherwise(F.col(out))).drop("__top", *ids)
    return rows


def age_features(df: DataFrame, columns: list[str], is_train: str, n_bins: int = 5, n_age_bins: int = 6, windows: tuple[int, ...] = (60, 240), keys: tuple[str, ...] = W.SERIES) -> DataFrame:
    """For each column its bin, how long it has been there, since when it was low and high, how often, and the bin of its age."""
    df = with_bins(df, quantile_edges(df.where(is_train), columns, n_bins, keys), columns, n_bins, keys=keys)
    for c in columns:
        low, high = F.col(f"qbin_{c}") == 0, F.col(f"qbin_{c}") == n_bins - 1
        df = W.run_lengths(df, f"qbin_{c}", f"agebin_{c}", keys)
        df = W.rows_since(W.rows_since(df, low, f"since_lowbin_{c}", keys), high, f"since_highbin_{c}", keys)
        df = df.withColumns({f"occ_{n}bin_{c}_W{w}": W.occupancy(f, w, keys).cast("float") for w in windows for n, f in (("low", low), ("high", high))})
    ages = [f"agebin_{c}" for c in columns]
    return with_bins(df, quantile_edges(df.where(is_train), ages, n_age_bins, keys), ages, n_age_bins, keys=keys)
