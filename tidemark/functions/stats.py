"""Statistics as Column expressions: proportions, bins, safe arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where either is null or b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def sgn(x: Column) -> Column:
    """Sign with null as 0."""
    return F.coalesce(F.signum(x), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of a proportion of k in n; 0 where n is 0."""
    p, zz = k / n, z * z
    centre = p + zz / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    scale = 1 + zz / n
    low, high = F.greatest((centre - spread) / scale, F.lit(0.0)), F.least((centre + spread) / scale, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def logit(p: Column) -> Column:
    """Log odds, p kept within 1e-6 of 0 and 1."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def interval_bin(x: Column, inner: list[float] | Column, n_bins: int, null_bin: Column | None = None) -> Column:
    """Bin of x by the n_bins - 1 inner edges: intervals closed on the left, the outer ones open-ended.

    A null x gets null_bin: the top bin if none is given (features), or F.lit(None) to stay null (literals).
    """
    edges = F.array(*[F.lit(float(e)) for e in inner]) if isinstance(inner, list) else inner
    found = F.size(F.filter(edges, lambda e: e <= x))
    return F.when(x.isNull(), F.lit(n_bins - 1) if null_bin is None else null_bin).otherwise(F.least(found, F.lit(n_bins - 1))).cast("int")


def lookup(x: Column, table: list[tuple[float, float, float]], default: float) -> Column:
    """Value of the last row (low, high, value) with low <= x < high; null counts as 50; no row: default."""
    at = F.coalesce(x, F.lit(50.0))
    out = F.lit(float(default))
    for low, high, value in table:
        out = F.when((at >= low) & (at < high), F.lit(float(value))).otherwise(out)
    return out


def to_epoch_ms(ts: Column, largest: Column) -> Column:
    """Epoch milliseconds from seconds, ms, microseconds or ns, told apart by the largest value of the column."""
    return F.when(largest < 10**12, ts * 1000).when(largest < 10**14, ts).when(largest < 10**17, F.floor(ts / 1000)).otherwise(F.floor(ts / 1_000_000)).cast("long")


def month_of(ts_ms: Column) -> Column:
    """YYYY-MM in UTC (the session time zone is UTC)."""
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM")


def time_unit(median_step: Column) -> Column:
    """Unit of time stamps by the median of their positive steps: sec, ms or ns; sec without any."""
    return F.when(median_step >= 1e10, "ns").when(median_step >= 1e4, "ms").otherwise("sec")


# The coefficients of Lanczos' approximation for g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1."""
    series = sum((F.lit(c) / (x + (i - 1)) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def binomial_tail(k: Column, n: Column, p: Column, terms: int = 400) -> Column:
    """Probability of k or more successes in n trials of probability p, by the continued fraction of the incomplete beta function; null for null arguments.

    The fraction needs about the square root of n terms where k is close to n * p, so 400 serve up to some 100,000 trials.
    """
    a, b, x = k.cast("double"), (n - k + 1).cast("double"), p.cast("double")
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast on this side; else the other tail is found
    args = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x"))
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        a_, b_, x_ = state["a"], state["b"], state["x"]
        even = m * (b_ - m) * x_ / ((a_ - 1 + 2 * m) * (a_ + 2 * m))
        odd = -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 1 + 2 * m))
        d, c = 1 / safe(1 + even * state["d"]), safe(1 + even / state["c"])
        d2, c2 = 1 / safe(1 + odd * d), safe(1 + odd / c)
        return F.struct(a_.alias("a"), b_.alias("b"), x_.alias("x"), d2.alias("d"), c2.alias("c"), (state["h"] * d * c * d2 * c2).alias("h"))

    first = F.transform(F.array(args), lambda s: F.struct(s["a"], s["b"], s["x"], (1 / safe(1 - (s["a"] + s["b"]) * s["x"] / (s["a"] + 1))).alias("d"), F.lit(1.0).alias("c"), (1 / safe(1 - (s["a"] + s["b"]) * s["x"] / (s["a"] + 1))).alias("h")))[0]
    last = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), first, step)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    beta = front * last["h"] / F.when(swap, b).otherwise(a)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(swap, 1 - beta).otherwise(beta))
