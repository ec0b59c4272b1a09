"""Mixing sources to target weights by systematic sampling (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import partitions, prefix_sums, saved, seeded_key, small, unit

SEED = "mixture-1"
#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of the input, and of no source more than CAP times its words.
SHARE, CAP = 1.5, 2.0
#: Expected copies are counted in units of 2**-24, so that prefix sums are exact.
ONE = 1 << 24


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, source: str, size: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source: source_size and target, in words.

    Sources share `share` times all words by weight; a target above `cap` times the source's words stops there
    and its excess is shared again by weight. That ends at target = min(cap * size, level * weight), so the level
    is read off the sources sorted by cap * size / weight.
    """
    per = rows.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("__n"))
    ordered = per.withColumn("__i", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumns({"__w": weight, "__cap": F.lit(cap) * F.col("source_size")})
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    full = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - full) / F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = ordered.withColumn("__level", level)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), "__i", "__level"))
    levels = levels.withColumn("__best", F.min(fits).over(Window.partitionBy()))
    target = F.coalesce(F.least(F.col("__cap"), F.col("__best.__level") * F.col("__w")), F.col("__cap"))
    return levels.select(F.col(source).alias("__s"), "source_size", "__n", target.alias("target"))


def mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **law) -> DataFrame:
    """Every row with its copies in the mix: columns `keep` (none of the others' names), size, source_size, target, copies, taken.

    Within each source the rows are sorted by size class (its two leading digits) and a seeded key; each row's
    expected copies, target / source_size, are summed up to it, one random offset for the source is added, and
    the row is taken once for each whole number that its own part crosses. So copies differ from the expected by
    less than one, and by size class the words taken stay near the target.

    Null text: size 0. Null source: a source of its own, last. Sources without words take nothing. Rows equal in
    id and text are interchangeable; reruns agree. Empty table: no rows. Other columns are ignored. A very long
    text is a row like others: of its size class hardly any other has it, and its copies differ from the expected
    by less than one.

    Prefix sums run over pieces of each source, whose number follows its rows; the targets need one row a source,
    and those few rows (tens of sources, not millions of hosts) are sorted in one task.
    """
    return copied(docs, seed, id_col, text_col, source_col, keep, **law).select("__row.*", "size", "source_size", "target", "copies", "taken")


def copied(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **law) -> DataFrame:
    """As mix(), with the columns `keep` in one struct, __row."""
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(F.struct(*keep).alias("__row"), F.col(source_col).alias("__src"), word_count(F.col(text_col)).alias("size"), seeded_key(seed, F.col(id_col), F.md5(text)).alias("__key"))
        .withColumn("__class", F.when(F.col("size") < 64, F.col("size")).otherwise(1000 + 100 * F.length(F.col("size").cast("string")) + F.substring(F.col("size").cast("string"), 1, 2).cast("long")))
        .withColumn("__g", F.when(F.col("__src").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("__src")))),
        "mix-rows",
    )
    per_piece = max(1, rows.count() // (4 * partitions(spark)))
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    targets = source_targets(rows, "__src", "size", **law)
    name = F.when(F.col("__s").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("__s")))
    offset = F.floor(unit(seeded_key(seed, F.lit("offset"), name)) * ONE)
    targets = small(targets.select(name.alias("__s"), "source_size", "target", expected.alias("__expected"), offset.alias("__offset")), "mix-targets")
    classes = small(rows.groupBy(F.col("__g").alias("__cg"), F.col("__class").alias("__cc")).agg(F.count("*").alias("__m")), "mix-classes")
    sub = F.floor(unit(F.col("__key")) * F.ceil(F.col("__m") / per_piece))
    keyed = rows.join(targets, F.col("__g") == F.col("__s")).join(classes, (F.col("__g") == F.col("__cg")) & (F.col("__class") == F.col("__cc")))
    keyed = keyed.withColumn("__piece", F.col("__class") * (1 << 32) + sub)
    summed = prefix_sums(keyed, "__g", "__piece", ["__key"], "__expected", "__sum")
    upto = F.col("__sum") + F.col("__offset")
    copies = F.shiftright(upto, 24) - F.shiftright(upto - F.col("__expected"), 24)
    return summed.select("__row", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **law) -> DataFrame:
    """The mix itself: each row of docs, with all its columns whatever their names, as often as it is taken.

    Null, empty and very long texts, null sources, repeated rows and empty tables are as in mix(). docs is read twice and
    should be a saved table: copies are counted without the texts and meet the rows by a hash of id, text and source. Of
    rows that are equal in these each gets the copies of one, whichever.
    """
    group = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    uid = F.xxhash64(F.col(id_col), F.col(text_col), group)
    taken = copied(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), uid.alias("__uid")), seed, "id", "text", "source", ["__uid"], **law)
    taken = saved(taken.select("__row.*", "copies"), "mix-copies")
    per = saved(taken.groupBy("__uid").agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies")), "mix-copies-of-rows")
    rows = docs.select(F.struct("*").alias("row"), uid.alias("own"))
    single = small(per.where("n = 1 and copies > 0").select("__uid", "copies"), "mix-single")
    out = rows.join(single, F.col("own") == F.col("__uid")).select("row", "copies")
    repeated = per.where("n > 1").select(F.col("__uid").alias("__again"))
    if not repeated.isEmpty():
        repeated = small(repeated, "mix-repeated")
        nth = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(key))
        each = rows.join(repeated, F.col("own") == F.col("__again")).select("row", "own", nth("own").alias("nth"))
        copies = taken.join(repeated, F.col("__uid") == F.col("__again")).select("__uid", "copies", nth("__uid").alias("__nth"))
        out = out.unionByName(each.join(copies, (F.col("own") == F.col("__uid")) & (F.col("nth") == F.col("__nth")) & (F.col("copies") > 0)).select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
