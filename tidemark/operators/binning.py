"""The number of bins of each feature, chosen by what its bins alone tell of wins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import interval_bin
from tidemark.operators.quantiles import exact_quantiles


def _apart(edges: np.ndarray) -> np.ndarray:
    """Edges of which none equals the one before."""
    out = [float(edges[0])]
    for e in edges[1:]:
        out.append(float(e) if e > out[-1] else out[-1] + 1e-9)
    return np.array(out)


def merged_bins(shares: np.ndarray, least: float) -> list[int]:
    """The first of the old bins in each new one: while a bin has a share below `least`, the first such joins its smaller neighbour (the left one if they are equal in nothing but being there)."""
    starts, sizes = list(range(len(shares))), [float(s) for s in shares]
    while len(sizes) > 1 and min(sizes) < least:
        i = next(k for k, s in enumerate(sizes) if s < least)
        right = i == 0 or i < len(sizes) - 1 and sizes[i + 1] <= sizes[i - 1]
        a = i if right else i - 1
        sizes[a : a + 2] = [sizes[a] + sizes[a + 1]]
        del starts[a + 1]
    return starts


def bin_probabilities(n: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """Probability of a win in each bin by a logistic regression over one-hot bins with an intercept, all weights shrunk (L2, C = 1)."""
    design = np.column_stack([np.eye(len(n)), np.ones(len(n))])
    w = np.zeros(len(n) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.eye(len(w)), design.T @ (n * p - wins) + w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-design @ w))


def quality(p: np.ndarray, n: np.ndarray, wins: np.ndarray) -> tuple[float, float, float, float]:
    """Average precision, negative calibration error (ten equal parts), negative Brier score and absolute correlation of rows given by bins."""
    total, won = n.sum(), wins.sum()
    if not total:
        return 0.0, 0.0, -1.0, 0.0
    order = np.argsort(-p, kind="stable")
    scores, first = np.unique(-p[order], return_index=True)
    tn, tw = (np.add.reduceat(x[order], first) for x in (n, wins))
    precision = float((tw / max(won, 1) * np.cumsum(tw) / np.maximum(np.cumsum(tn), 1)).sum())
    ends = np.cumsum(tn[::-1])  # rows by rising score; rows of one score count as equal
    cuts = np.linspace(0, total, 11).astype(np.int64)
    at = lambda values: np.interp(cuts, np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(values[::-1])]))
    error = float(np.abs(np.diff(at(-scores * tn)) - np.diff(at(tw))).sum() / total)
    brier = float((n * p**2 - 2 * p * wins + wins).sum() / total)
    mean, rate = (n * p).sum() / total, won / total
    spread = np.sqrt(max(0.0, (n * (p - mean) ** 2).sum() / total) * rate * (1 - rate))
    correlation = abs(float(((wins * p).sum() / total - mean * rate) / spread)) if spread > 0 else 0.0
    return precision, -error, -brier, correlation


def drift(months: np.ndarray) -> float:
    """Largest Jensen-Shannon distance of two months' histograms (rows)."""
    shares = [m / m.sum() for m in months if m.sum() > 0]
    worst = 0.0
    for i, p in enumerate(shares):
        for q in shares[:i]:
            m = (p + q) / 2
            kl = sum(float((x[x > 0] * np.log(x[x > 0] / m[x > 0])).sum()) for x in (p, q)) / 2
            worst = max(worst, float(np.sqrt(max(0.0, kl))))
    return worst


def choose_bins(
    df: DataFrame, columns: list[str], y: str, fit: Column, ym: str = "ym", candidates: tuple[int, ...] = (3, 4, 5, 7, 10), min_share: float = 0.005, corr_gain: float = 0.002,
    ece_gain: float = 0.002, max_drift: float = 0.15, prefer_monotone: bool = True, slack: float = 0.02,
) -> dict[str, list[float]]:
    """The inner edges of each column's bins.

    For each number of bins in turn: quantiles of the rows where `fit` holds, bins with less than min_share of them
    joined to a neighbour (fewer than three: terciles instead), win rates by a small logistic regression. The bins are
    acceptable if no two months' histograms are further apart than max_drift, rates move one way (but for `slack`) and
    correlation or calibration on the other rows gains on the last choice. The best of them counts, by average
    precision, calibration error, Brier score and correlation; without any, the fewest bins' plain quantiles.

    A column without two values has one bin. Null belongs to the top bin, but to no month's histogram. Three passes over
    df, whatever the number of columns; what comes back is a row for each column, number of bins, bin and month.
    """
    sizes = sorted({3, *candidates})
    places = sorted({i / k for k in sizes for i in range(1, k)})
    found = df.where(fit).agg(
        *[(F.min(c) < F.max(c)).alias(f"some{i}") for i, c in enumerate(columns)],
    ).first()
    known = [i for i in range(len(columns)) if found[f"some{i}"]]
    if not known:
        return {c: [] for c in columns}
    edges = exact_quantiles(df.where(fit), [columns[i] for i in known], places).first()
    inner = {(i, k): _apart(np.array([edges[f"q_{columns[i]}"][places.index(j / k)] for j in range(1, k)])) for i in known for k in sizes}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), interval_bin(F.col(columns[i]).cast("double"), e.tolist(), k).cast("int").alias("b"), F.col(columns[i]).isNotNull().alias("valid")) for (i, k), e in inner.items()])
    rows = df.select(F.coalesce(fit, F.lit(False)).alias("fit"), F.col(ym).cast("string").alias("ym"), F.col(y).cast("long").alias("y"), F.explode(cells).alias("c"))
    counts = rows.groupBy("c.i", "c.k", "c.b", "c.valid", "fit", "ym").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("w"))
    counted: dict[tuple[int, int], list] = {}
    for r in counts.collect():
        counted.setdefault((r["i"], r["k"]), []).append(r)

    def table(of: tuple[int, int], starts: list[int], wanted) -> np.ndarray:
        out = np.zeros((2, len(starts)))
        for r in filter(wanted, counted.get(of, [])):
            out[:, int(np.searchsorted(starts, r["b"], side="right")) - 1] += (r["n"], r["w"])
        return out

    chosen = {c: [] for c in columns}
    for i in known:
        best, last_corr, last_ece = None, 0.0, 1.0
        for k in candidates:
            of, starts = (i, k), list(range(k))
            n = table(of, starts, lambda r: r["fit"])[0]
            if n.sum():
                starts = merged_bins(n / n.sum(), min_share)
            if len(starts) < 3:
                of, starts = (i, 3), [0, 1, 2]
            (n, w), (held_n, held_w) = (table(of, starts, lambda r, f=f: r["fit"] == f) for f in (True, False))
            both = 0 < w.sum() < n.sum() and 0 < held_w.sum() < held_n.sum()
            p = bin_probabilities(n, w) if both else np.full(len(starts), w.sum() / max(n.sum(), 1))
            ap, ece, brier, corr = quality(p, held_n, held_w)
            months = sorted({r["ym"] for r in counted.get(of, []) if r["fit"]}, key=str)
            wandering = drift(np.array([table(of, starts, lambda r, m=m: r["fit"] and r["valid"] and r["ym"] == m)[0] for m in months]))
            steps = np.diff(w[n > 0] / n[n > 0])
            one_way = not prefer_monotone or bool((steps >= -slack).all() or (steps <= slack).all())
            if wandering <= max_drift and one_way and (corr - last_corr >= corr_gain or last_ece + ece >= ece_gain):
                edges = [float(inner[of][s - 1]) for s in starts[1:]]
                if best is None or (ap, ece, brier, corr, edges) > best:
                    best, last_corr, last_ece = (ap, ece, brier, corr, edges), corr, -ece
        chosen[columns[i]] = best[-1] if best else inner[i, max(3, candidates[0]) if max(3, candidates[0]) in sizes else 3].tolist()
    return chosen
