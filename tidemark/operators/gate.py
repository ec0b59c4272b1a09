"""Gate: a calibrated classifier over bins and crosses, scored events, loser literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.operators.mining import any_literal
from tidemark.sources.artifacts import read_json, write_json


def codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each expected column as a category from 0 up: the value + 1; missing columns and nulls are category 0."""
    return df.withColumns({f"c_{c}": (F.coalesce(F.col(c).cast("int"), F.lit(-1)) + 1).cast("double") if c in df.columns else F.lit(0.0) for c in columns})


def crosses(df: DataFrame, pairs: list[tuple[tuple[str, int], tuple[str, int]]]) -> DataFrame:
    """x_<i>: 1 where both literals of the pair hold."""
    return df.withColumns({f"x_{i}": F.coalesce(((F.col(a) == v) & (F.col(b) == w)).cast("double"), F.lit(0.0)) for i, ((a, v), (b, w)) in enumerate(pairs)})


#: Conditions of curated crosses, as the end of a column's range and how many steps from it.
CONDITIONS = {
    "high": ("top", 1), "high2": ("top", 2), "low": ("bot", 1), "low2": ("bot", 2), "old": ("top", 1), "near": ("bot", 1),
    "near_or_low": ("bot", 2), "pos": ("top", 1), "neg": ("bot", 1), "eq1": ("eq", 1),
}


def curated(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """xC_<a>__<b>: 1 where both conditions `column:condition` of a pair hold, relative to the columns' ranges in df.

    A column that doesn't exist is looked for as q_<column>; pairs without it are left out. Null never meets a
    condition; unknown conditions are `high`. The ranges are one row.
    """
    known = []
    for a, b in pairs:
        halves = [(x, *(x.split(":", 1) if ":" in x else (x, "high"))) for x in (a, b)]
        columns = [next((c for c in (name, f"q_{name}") if c in df.columns), None) for _, name, _ in halves]
        if None not in columns:
            known.append([(c, name, spec) for c, (_, name, spec) in zip(columns, halves, strict=True)])
    used = sorted({c for pair in known for c, _, _ in pair})
    if not used:
        return df
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(used) for k, f in (("top", F.max), ("bot", F.min))]).first()

    def holds(column: str, spec: str) -> Column:
        end, k = CONDITIONS.get(spec, ("top", 1))
        i, x = used.index(column), F.col(column).cast("double")
        if ends[f"top_{i}"] is None:
            return F.lit(False)
        return x == k if end == "eq" else x >= ends[f"top_{i}"] - (k - 1) if end == "top" else x <= ends[f"bot_{i}"] + (k - 1)

    name = lambda pair: "xC_" + "__".join(f"{n}:{spec}" for _, n, spec in pair)
    return df.withColumns({name(pair): F.coalesce((holds(*pair[0][::2]) & holds(*pair[1][::2])).cast("double"), F.lit(0.0)) for pair in known})


def chosen_crosses(core: DataFrame, held: DataFrame, y: str, names: list[str], cap: int = 20, min_support: float = 0.005) -> list[str]:
    """The `cap` crosses that rank the held rows best by themselves.

    Of the crosses set in min_support of the core rows, but not all, the 2 * cap most frequent are tried: each orders
    the held rows by the rate of wins that its two values have in the core rows, and average precision counts. If
    either part knows one outcome only, support ranks them. One pass over each part; one row of counts comes back.
    """
    if not names or cap <= 0:
        return []

    def counted(df: DataFrame) -> dict:
        sums = [F.count("*").alias("n"), F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("w")]
        for i, c in enumerate(names):
            on = F.col(f"`{c}`") > 0
            sums += [F.count_if(on).alias(f"n{i}"), F.coalesce(F.sum(F.when(on, F.col(y).cast("double"))), F.lit(0.0)).alias(f"w{i}")]
        return df.agg(*sums).first().asDict()

    fit_, val = counted(core), counted(held)
    able = 0 < fit_["w"] < fit_["n"] and 0 < val["w"] < val["n"]
    tried = sorted((i for i in range(len(names)) if fit_[f"n{i}"] >= min_support * max(1, fit_["n"]) and 0 < fit_[f"n{i}"] < fit_["n"]), key=lambda i: (-fit_[f"n{i}"], names[i]))[: 2 * cap]

    def precision(i: int) -> float:
        if not able:
            return fit_[f"n{i}"] / fit_["n"]
        on, off = fit_[f"w{i}"] / fit_[f"n{i}"], (fit_["w"] - fit_[f"w{i}"]) / (fit_["n"] - fit_[f"n{i}"])
        n1, w1 = (val[f"n{i}"], val[f"w{i}"]) if on >= off else (val["n"] - val[f"n{i}"], val["w"] - val[f"w{i}"])
        base = val["w"] / val["n"]
        return base if on == off or not n1 else (w1 / val["w"]) * (w1 / n1) + (1 - w1 / val["w"]) * base

    return [names[i] for i in sorted(tried, key=lambda i: (-precision(i), -fit_[f"n{i}"], names[i]))[:cap]]


def learned(df: DataFrame, y: str, columns: list[str], extra: list[str], model: str, strength: float) -> PipelineModel:
    """One classifier over one-hot columns (see codes) and `extra`, with class weights."""
    row = df.agg(F.avg(F.col(y).cast("double")).alias("share"), F.count("*").alias("n")).first()
    share = row["share"] or 0.5
    rows = codes(df, columns).withColumn("__w", F.when(F.col(y) == 1, 1 - share).otherwise(share)).withColumn("__y", F.col(y).cast("double"))
    encoders = [OneHotEncoder(inputCols=[f"c_{c}" for c in columns], outputCols=[f"o_{c}" for c in columns], handleInvalid="keep", dropLast=False)] if columns else []
    assembler = VectorAssembler(inputCols=[f"o_{c}" for c in columns] + extra, outputCol="__x")
    common = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "__w", "probabilityCol": "__p"}
    learner = GBTClassifier(**common, maxDepth=max(2, int(strength)), maxIter=40, seed=7) if model == "gbdt" else LogisticRegression(**common, regParam=1 / (strength * max(row["n"], 1)), standardization=False)
    return Pipeline(stages=[*encoders, assembler, learner]).fit(rows)


def fit(df: DataFrame, y: str, columns: list[str], extra: list[str] = [], model: str = "logreg", grid: tuple[float, ...] = (0.1, 1.0, 10.0), validation: DataFrame | None = None) -> PipelineModel:  # noqa: B006
    """One-hot classifier with class weights; of the grid (inverse regularisation, or tree depth) the best average precision on the validation rows.

    The model's `strength` is the value of the grid that was chosen.
    """
    held = codes(validation if validation is not None else df, columns)
    best, found = -1.0, None
    for g in grid:
        fitted = learned(df, y, columns, extra, model, g)
        ap = evaluate.average_precision(scored(held, fitted), "p_raw", y).first()[0] or 0.0
        if ap > best:
            best, found, found_g = ap, fitted, g
    found.strength = found_g
    return found


def scored(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds p_raw, the model's probability of a win."""
    out = model.transform(df).withColumn("p_raw", vector_to_array("__p")[1])
    return out.select(*df.columns, "p_raw")


def calibrated(df: DataFrame, y: str, n_folds: int = 3, tie: str = "ts") -> list:
    """Isotonic models of p_raw, one for each fold (by a hash of `tie`) fitted on that fold's rows."""
    folded = df.withColumn("__fold", F.pmod(F.xxhash64(tie), F.lit(n_folds))).withColumn("__y", F.col(y).cast("double"))
    parts = [folded.where(F.col("__fold") == k) for k in range(n_folds)]
    return [IsotonicRegression(featuresCol="p_raw", labelCol="__y").fit(p) for p in parts if not p.isEmpty()]


@dataclass
class Curve:
    """A map from raw to calibrated probabilities: a line through points (isotonic), or a logistic curve of the log odds (sigmoid)."""

    xs: list[float]
    ys: list[float]
    sigmoid: tuple[float, float] | None = None

    def of(self, p: Column) -> Column:
        if self.sigmoid:
            q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
            return 1 / (1 + F.exp(-(F.lit(self.sigmoid[0]) * F.log(q / (1 - q)) + self.sigmoid[1])))
        value = F.lit(self.ys[-1])
        for i in range(len(self.xs) - 1, 0, -1):
            width = self.xs[i] - self.xs[i - 1]
            on = F.lit(self.ys[i]) if width <= 0 else F.lit(self.ys[i - 1]) + (p - self.xs[i - 1]) / width * (self.ys[i] - self.ys[i - 1])
            value = F.when(p <= self.xs[i], on).otherwise(value)
        return F.when(p <= self.xs[0], F.lit(self.ys[0])).otherwise(value)


def curve(df: DataFrame, y: str, method: str = "isotonic") -> Curve:
    """A curve from rows with p_raw and outcome."""
    if method in ("sigmoid", "platt"):
        q = F.least(F.greatest(F.col("p_raw"), F.lit(1e-9)), F.lit(1 - 1e-9))
        rows = VectorAssembler(inputCols=["__z"], outputCol="__x").transform(df.select(F.log(q / (1 - q)).alias("__z"), F.col(y).cast("double").alias("__y")))
        line = LogisticRegression(featuresCol="__x", labelCol="__y", standardization=False).fit(rows)
        return Curve([], [], (float(line.coefficients[0]), float(line.intercept)))
    (m,) = calibrated(df, y, 1)
    return Curve(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist())


def refitted(df: DataFrame, y: str, columns: list[str], first: PipelineModel, extra: list[str] = [], model: str = "logreg", method: str = "isotonic", strength: float = 1.0, most: int = 5, tie: str = "ts") -> list[tuple[PipelineModel, Curve]]:  # noqa: B006
    """Models with their curves: each learnt without one fold of the rows (by a hash of `tie`), its curve fitted on that fold.

    There are as many folds as rows of the rarer outcome, 2 to `most`. With fewer than two rows of an outcome, or
    where a fold or the rest lacks one, the `first` model is calibrated as it is, on all rows.
    """
    counts = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0)).alias("w")).first()
    rarer = min(counts["w"], counts["n"] - counts["w"])
    if rarer >= 2:
        k = max(2, min(most, rarer))
        folded = df.withColumn("__fold", F.pmod(F.xxhash64(tie), F.lit(k)))
        by = {r["__fold"]: (r["n"], r["w"]) for r in folded.groupBy("__fold").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("w")).collect()}
        if len(by) == k and all(0 < w < n and 0 < counts["w"] - w < counts["n"] - n for n, w in by.values()):
            parts = []
            for fold in range(k):
                fitted = learned(folded.where(F.col("__fold") != fold).drop("__fold"), y, columns, extra, model, strength)
                parts.append((fitted, curve(scored(codes(folded.where(F.col("__fold") == fold), columns), fitted), y, method)))
            return parts
    return [(first, curve(scored(codes(df, columns), first), y, method))]


def with_probability(df: DataFrame, parts: list[tuple[PipelineModel, Curve]], columns: list[str]) -> DataFrame:
    """Adds p_win, the mean of the calibrated models."""
    out, total = codes(df, columns), F.lit(0.0)
    for i, (model, calibration) in enumerate(parts):
        out = scored(out, model).withColumn(f"__c{i}", calibration.of(F.col("p_raw"))).drop("p_raw")
        total = total + F.col(f"__c{i}")
    return out.withColumn("p_win", total / len(parts)).drop(*[f"__c{i}" for i in range(len(parts))], *[f"c_{c}" for c in columns])


@dataclass
class Bundle:
    """All that scoring new candidates takes: models and curves, columns, crosses (mined and curated), threshold and loser groups."""

    parts: list[tuple[PipelineModel, Curve]]
    columns: list[str]
    pairs: list[tuple[tuple[str, int], tuple[str, int]]]
    extra: list[str]
    tau: float
    losers: list[list[tuple[str, int]]]
    curated: list[tuple[str, str]] = field(default_factory=list)

    def crossed(self, df: DataFrame) -> DataFrame:
        return curated(crosses(df, self.pairs), self.curated)

    def enter(self, df: DataFrame) -> DataFrame:
        """df with p_win, loser_mask and enter."""
        out = self.crossed(df)
        missing = [c for c in self.extra if c not in out.columns]
        out = with_probability(out.withColumns({c: F.lit(0.0) for c in missing}), self.parts, self.columns)
        return entered(out.select(*df.columns, "p_win"), self.tau, self.losers)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Models in their own folders and the rest as JSON, below `path` in any file system that Spark reaches."""
    for i, (model, _) in enumerate(bundle.parts):
        model.write().overwrite().save(f"{path}/model_{i}")
    curves = [{"xs": c.xs, "ys": c.ys, "sigmoid": c.sigmoid} for _, c in bundle.parts]
    write_json(spark, {"curves": curves, "columns": bundle.columns, "pairs": bundle.pairs, "extra": bundle.extra, "tau": bundle.tau, "losers": bundle.losers, "curated": bundle.curated}, f"{path}/gate.json")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    kept = read_json(spark, f"{path}/gate.json")
    curves = [Curve(c["xs"], c["ys"], tuple(c["sigmoid"]) if c["sigmoid"] else None) for c in kept["curves"]]
    parts = [(PipelineModel.load(f"{path}/model_{i}"), c) for i, c in enumerate(curves)]
    pairs = [tuple(tuple(x) for x in pair) for pair in kept["pairs"]]
    return Bundle(parts, kept["columns"], pairs, kept["extra"], kept["tau"], [[tuple(x) for x in group] for group in kept["losers"]], [tuple(p) for p in kept["curated"]])


def probability(models: list) -> Column:
    """Mean of the isotonic models at p_raw: each a line through its few boundaries."""
    parts = [Curve(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()).of(F.col("p_raw")) for m in models]
    return sum(parts[1:], parts[0]) / len(parts)


def loser_groups(losers: list[dict], min_support: int = 20) -> list[list[tuple[str, int]]]:
    """Literal groups of mined losers with enough support; a rule's conditions are joined by ` & `, columns and values by `==`."""
    groups = []
    for rule in losers:
        if rule["support_n"] >= min_support:
            groups.append([(part.split("==")[0], int(part.split("==")[1])) for part in rule["rule_id"].split(" & ")])
    return groups


def entered(df: DataFrame, tau: float, losers: list[list[tuple[str, int]]]) -> DataFrame:
    """Adds loser_mask and enter: the probability reaches tau, no loser rule holds and the event isn't preempted."""
    out = df.withColumn("loser_mask", any_literal(losers, df.columns))
    return out.withColumn("enter", (F.col("p_win") >= tau) & ~F.col("loser_mask") & ~F.coalesce("preempted", F.lit(False)))
