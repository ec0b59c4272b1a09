"""Quality rules with cross-document line frequency (operator 4); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import small

#: A line is boilerplate of its host if more than MAX_DOCUMENTS of the host's documents, and more than MAX_SHARE of
#: them or more than CEILING, have it.
MAX_DOCUMENTS, MAX_SHARE, CEILING = 10, 0.02, 10_000
#: A document is depleted if less than this part of its words is outside boilerplate lines.
MIN_LEFT = 0.2
#: Base rules: fewer words, or more than this percentage of them in repeated windows, fail.
MIN_WORDS, MAX_REPEATED = 20, 30
WINDOW = 8

_SPACES = "[\\x20\\x09-\\x0D]+"


def _pairs(array: str, gap: int) -> str:
    """Hashes of each element with the one `gap` places on."""
    return f"zip_with(slice({array}, 1, size({array}) - {gap}), slice({array}, {1 + gap}, size({array}) - {gap}), (a, b) -> xxhash64(a, b))"


def measured(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Adds the base counts and base_failed; windows are compared by 64-bit hashes of their words."""
    out = docs.withColumn("__words", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACES), ""))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[#*$%&|<>]+", ""))).cast("long"),
        "__lines": lines, "__h1": F.when(F.size("__words") >= WINDOW, F.transform("__words", lambda w: F.xxhash64(w))),
    })
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("__h2", F.expr(_pairs("__h1", 1))).withColumn("__h4", F.expr(_pairs("__h2", 2))).withColumn("__h8", F.expr(_pairs("__h4", 4)))
    # Only texts with an equal pair of windows go on: windows sorted by hash, the places of equal neighbours, their union's length.
    twice = F.size(F.array_distinct("__h8")) < F.size("__h8")
    out = out.withColumn("__sorted", F.when(twice, F.sort_array(F.transform("__h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = "zip_with(slice(__sorted, 1, size(__sorted) - 1), slice(__sorted, 2, size(__sorted) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))"
    out = out.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(F.expr(same)))))
    covered = f"aggregate(zip_with(slice(__at, 1, size(__at) - 1), slice(__at, 2, size(__at) - 1), (a, b) -> least({WINDOW}, b - a)), {WINDOW}L, (s, x) -> s + x)"
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__words", "__lines", "__h1", "__h2", "__h4", "__h8", "__sorted", "__at")


def _lines(docs: DataFrame) -> DataFrame:
    """__id, __hash, __host and each line that has a word, normalised (lower case, one space between words), as hash and word count."""
    exploded = docs.select("__id", "__hash", "__host", F.explode(F.split("__text", "\\n")).alias("__line"))
    plain = exploded.withColumn("__line", F.trim(F.regexp_replace(F.lower("__line"), _SPACES, " "))).where("__line != ''")
    return plain.select("__id", "__hash", "__host", F.xxhash64("__line").alias("line"), F.size(F.split("__line", " ")).alias("words"))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, the base counts, base_failed, left (part of the words that stays), kept, __hash.

    Lines are normalised and hashed; for each host the distinct documents with a line are counted, copies of one
    text being one document. Lines above the limits are removed, and a document with less than MIN_LEFT of its
    words left is rejected, as are those that fail the base rules.

    Null text: no words (fails). No words: nothing is removed. A null host is a host. Rows equal in id, text and
    host get equal results. Empty table: no rows. Other columns are ignored. A very long text is one row, its words and
    windows arrays of that row.

    Counts are aggregated before they are shuffled, so a line that all documents share is no hot key; the join
    back to lines broadcasts the boilerplate lines if they are few, and shuffles otherwise.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("__hash"), F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("null"))).alias("__host"))
    lines = _lines(rows)
    hosts = small(rows.select("__host", "__hash").distinct().groupBy(F.col("__host").alias("__h")).agg(F.count("*").alias("of")), "quality-hosts")
    common = lines.groupBy("__host", "line").agg(F.countDistinct("__hash").alias("n")).where(F.col("n") > MAX_DOCUMENTS)
    common = common.join(hosts, F.col("__host") == F.col("__h")).where(F.col("n") > F.least(MAX_SHARE * F.col("of"), F.lit(CEILING)))
    common = small(common.select(F.col("__host").alias("__ch"), F.col("line").alias("__cl")), "quality-lines")
    marked = lines.join(common, (F.col("__host") == F.col("__ch")) & (F.col("line") == F.col("__cl")), "left")
    removed = marked.groupBy("__id", "__hash", "__host").agg(F.sum("words").alias("all"), F.sum(F.when(F.col("__cl").isNotNull(), F.col("words"))).alias("gone"))
    removed = removed.where("gone > 0").select(F.col("__id").alias("__i"), F.col("__hash").alias("__t"), F.col("__host").alias("__o"), (1 - F.col("gone") / F.col("all")).alias("part"))
    base = measured(rows).drop("__text")
    joined = base.join(removed, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__t")) & (F.col("__host") == F.col("__o")), "left")
    left = F.coalesce(F.col("part"), F.lit(1.0))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(F.col("__id").alias(id_col), *counts, left.alias("left"), (~F.col("base_failed") & (left >= MIN_LEFT)).alias("kept"), "__hash", "__host")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names.

    Null, empty and short texts go, as they fail the base rules. A row is judged with its text and host, so copies
    of one text in a host share their fate; repeated rows stay repeated. Empty table: no rows.
    """
    bad = rate(docs, id_col, text_col, host_col).where("not kept").select(F.col(id_col).alias("__i"), F.col("__hash").alias("__t"), F.col("__host").alias("__o")).distinct()
    bad = small(bad, "quality-rejected")
    host = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("null")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), host.alias("host"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("__i")) & (F.col("hash") == F.col("__t")) & (F.col("host") == F.col("__o")), "left_anti").select("row.*")
