"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest (operator 11); DataFrame functions and Spark ML only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import BROADCAST_ROWS, saved, seeded_key

# Rules as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Trees are fitted on about so many distinct labelled URLs, drawn by hash; suffix statistics count them all.
FIT_URLS = 200_000
TREES, DEPTH, STEP = 20, 3, 0.3
#: Suffix shares are smoothed by so many URLs of the overall share, and those of fewer URLs than SEEN aren't used.
PRIOR, SEEN = 4.0, 3
#: A labelled URL is judged by the suffix shares of the other folds in training.
FOLDS = 4
#: A suffix is hot if more than this part of the labelled URLs has it; each URL has three suffixes, so 3 / HOT rows at most are hot.
HOT = 0.001

_LEXICAL = ["length", "host_length", "labels", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "hyphens"]
_SUFFIXES = ["tld", "domain", "section"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first ://, and the path up to ? or #; both empty for a null url or one without ://."""
    scheme = F.substring_index(url, "://", 1)
    after = F.when(url.contains("://"), url.substr(F.length(scheme) + 4, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), "^[^?#]*", 0), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits (host and path as one text; null if none does) and its verdict.

    A rule fits its host and the hosts below it, where the path starts with its path. Of several the longest counts, of
    equally long ones the first by text. Meant for lists that a person keeps: each rule is a test of one expression.
    """
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in best]
    rule = reduce(lambda c, x: c.when(x[0], F.lit(x[1][0] + x[1][1])), zip(fits, best, strict=True), F.when(F.lit(False), F.lit("")))
    verdict = reduce(lambda c, x: c.when(x[0], F.lit(x[1][2])), zip(fits, best, strict=True), F.when(F.lit(False), F.lit("")))
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, by runs of the sorted characters; 0 for an empty text."""
    runs = F.aggregate(
        F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, c: F.when(c == a["c"], F.struct(a["c"].alias("c"), (a["k"] + 1).alias("k"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("k"), (a["s"] + a["k"] * F.log2(F.greatest(a["k"], F.lit(1.0)))).alias("s"))),
        lambda a: a["s"] + a["k"] * F.log2(F.greatest(a["k"], F.lit(1.0))),
    )
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.log2(n) - runs / n, F.lit(0.0))).otherwise(0.0)


def featured(rows: DataFrame) -> DataFrame:
    """Adds __host, __path, the lexical features and the suffixes (kind before the text) to rows with __url."""
    host, path = host_and_path(F.col("__url"))
    rows = rows.withColumns({"__host": host, "__path": path})
    url, n = F.coalesce("__url", F.lit("")), F.length(F.coalesce("__url", F.lit("")))
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]+", ""))
    labels, segments = F.split("__host", "\\."), F.array_remove(F.split("__path", "/"), "")
    hosts = F.length("__host")
    return rows.withColumns({
        "length": n, "host_length": hosts, "labels": F.size(labels), "depth": F.size(segments), "digit_ratio": digits(url) / F.greatest(n, F.lit(1)),
        "host_digits": digits(F.col("__host")) / F.greatest(hosts, F.lit(1)), "entropy": _entropy(url), "host_entropy": _entropy(F.col("__host")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.array_remove(F.split(query, "&"), ""))), "hyphens": n - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "tld": F.concat(F.lit("t:"), F.substring_index("__host", ".", -1)), "domain": F.concat(F.lit("d:"), F.substring_index("__host", ".", -2)),
        "section": F.concat(F.lit("s:"), F.coalesce(F.get(segments, 0), F.lit(""))),
    })


@dataclass
class UrlModel:
    """Fitted trees (None where the labels are all alike), suffix counts and the share of block labels."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    share: float
    urls: int


def _suffix_counts(labelled: DataFrame) -> DataFrame:
    """suffix, n and b (URLs, those to block), ns and bs (the same by fold) of the distinct labelled URLs."""
    fold = F.pmod(seeded_key("fold", F.col("__url")), F.lit(FOLDS)).cast("int")
    rows = labelled.select(F.explode(F.array(*_SUFFIXES)).alias("__suffix"), "label", fold.alias("fold"))
    by_fold = lambda x: F.array(*[F.sum(F.when(F.col("fold") == f, x).otherwise(0)) for f in range(FOLDS)])
    out = rows.groupBy("__suffix").agg(F.count("*").alias("__n"), F.sum("label").alias("__b"), by_fold(F.lit(1)).alias("__ns"), by_fold(F.col("label")).alias("__bs"))
    return out.where(F.col("__n") >= SEEN)


def _looked_up(rows: DataFrame, suffix: str, model: UrlModel, columns: list[str]) -> DataFrame:
    """rows with the columns of their suffix; a table too large to be sent about is joined by shuffle, but for hot suffixes."""
    table = model.suffixes.select("__suffix", *columns)
    if model.suffixes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), F.col(suffix) == F.col("__suffix"), "left").drop("__suffix")
    hot = F.broadcast(model.suffixes.where(F.col("__n") > HOT * model.urls).select(F.col("__suffix").alias("__hot"), *[F.col(c).alias(f"{c}_hot") for c in columns]))
    found = rows.join(hot, F.col(suffix) == F.col("__hot"), "left")
    key = F.when(F.col("__hot").isNull(), F.col(suffix)).otherwise(F.concat(F.lit("~"), F.xxhash64("__url").cast("string")))  # such a key meets nothing
    found = found.withColumn("__key", key).join(table.hint("merge"), F.col("__key") == F.col("__suffix"), "left")
    return found.withColumns({c: F.coalesce(f"{c}_hot", c) for c in columns}).drop("__key", "__hot", "__suffix", *[f"{c}_hot" for c in columns])


def _vectors(rows: DataFrame, model: UrlModel, training: bool) -> DataFrame:
    """Adds `features`; in training a URL's own fold is left out of the suffix shares."""
    names = []
    for suffix in _SUFFIXES:
        rows = _looked_up(rows, suffix, model, ["__n", "__b", "__ns", "__bs"] if training else ["__n", "__b"])
        fold = F.pmod(seeded_key("fold", F.col("__url")), F.lit(FOLDS)).cast("int")
        n, b = (F.col("__n") - F.get("__ns", fold), F.col("__b") - F.get("__bs", fold)) if training else (F.col("__n"), F.col("__b"))
        known = n >= SEEN
        share = F.when(known, (b + PRIOR * model.share) / (n + PRIOR)).otherwise(model.share)
        rows = rows.withColumns({f"{suffix}_share": share, f"{suffix}_seen": F.when(known, F.log1p(n)).otherwise(0.0)}).drop("__n", "__b", "__ns", "__bs")
        names += [f"{suffix}_share", f"{suffix}_seen"]
    return VectorAssembler(inputCols=_LEXICAL + names, outputCol="features").transform(rows.withColumns({c: F.col(c).cast("double") for c in _LEXICAL}))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", fit_urls: int = FIT_URLS) -> UrlModel:
    """Gradient-boosted trees from URLs labelled 1 (block) or 0 (allow).

    Each distinct URL counts once (block, if its labels differ). Suffix shares are counted over all of them; the trees
    are fitted on about `fit_urls`, drawn by hash, both labels weighing alike. Rows with a null url or label are passed over;
    without labels nothing is blocked, and with one kind of label that is the verdict.
    """
    known = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    known = saved(known.groupBy(F.col(url_col).alias("__url")).agg(F.max(F.col(label_col).cast("int")).alias("label")), "url-labels")
    urls, block = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = UrlModel(None, saved(_suffix_counts(featured(known)), "url-suffixes"), block / urls if urls else 0.0, urls)
    if block in (0, urls):
        return model
    drawn = known.where(seeded_key("sample", F.col("__url")) < int(min(1.0, fit_urls / urls) * (1 << 60)))
    weighed = featured(drawn).withColumn("weight", F.when(F.col("label") == 1, urls / (2.0 * block)).otherwise(urls / (2.0 * (urls - block))))
    rows = saved(_vectors(weighed, model, training=True).select("features", "label", "weight"), "url-vectors")
    if rows.select("label").distinct().count() == 2:
        trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=7)
        model.trees = trees.fit(rows)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (null if none fits), verdict, p_block (by the trees).

    The verdict is the rule's; where none fits, block if the trees give a probability of one half or more.

    Null url, or one without ://: host and path are empty, so that no rule fits, and the trees judge what text there is.
    Repeated rows get equal results; a null id is an id. Empty table: no rows. Other columns are ignored. Very long
    URLs are judged as a whole.
    """
    rows = featured(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")))
    if model.trees is None:
        scored = rows.withColumn("p_block", F.lit(1.0 if model.share > 0.5 else 0.0))
    else:
        scored = model.trees.transform(_vectors(rows, model, training=False)).withColumn("p_block", vector_to_array("probability")[1])
    rule, verdict = ruled(F.col("__host"), F.col("__path"), rules)
    judged = F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), judged.alias("verdict"), "p_block")


def labelled_by(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """url and label of the pages that a rule decides: the labelled URLs from which the verdicts of the others are learned."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    _, verdict = ruled(F.col("host"), F.col("path"), rules)
    return rows.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label")).where("label IS NOT NULL")
