"""Sharding by proportional stratified interleaving (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import partitions, prefix_sums, saved, seeded_key, small, unit

SEED = "shards-1"


def interleave(docs: DataFrame, n_shards: int = 24, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deals every row to a shard so that each shard has the mixture of the whole.

    Within each source the rows are shuffled by a seeded key and ranked; a row's fractional rank is
    (rank - u) / rows of the source, u in [0, 1) being fixed for each source, so that sources of one row do not
    all meet in the middle. All rows sorted by fractional rank are cut into `n_shards` runs whose lengths differ
    by one at most (law `rows`).

    Returns id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null: this law fixes nothing for other shard counts).

    Null text: no bytes, CRC of nothing (0). Null source: a source of its own. Null ids and repeated rows are
    rows like others; rows equal in id and text are interchangeable. Rows of equal texts are dealt one by one, so a
    group of copies is spread over the shards as its sources are (law `rows` keeps no group together). Empty table:
    no rows. Fewer rows than shards: some shards stay empty. A very long text is one row. Other columns are ignored.

    Ranks come from prefix sums over hash ranges of each source, whose number follows its rows, so one source
    may hold any share of the table.
    """
    spark = docs.sparkSession
    pieces = 4 * partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    rows = saved(
        docs.select(
            F.col(id_col).alias("__id"), source.alias("__source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            seeded_key(seed, F.col(id_col), F.md5(text)).alias("__key"), F.lit(1).cast("long").alias("__one"),
        ),
        "shard-rows",
    )
    total = rows.count()
    per_piece = max(1, total // pieces)
    sources = small(
        rows.groupBy("__source").agg(F.count("*").alias("__n")).select(F.col("__source").alias("__s"), "__n", unit(seeded_key(seed, F.lit("source"), F.col("__source"))).alias("__u")),
        "shard-sources",
    )
    keyed = rows.join(sources, F.col("__source") == F.col("__s")).withColumn("__piece", F.floor(unit(F.col("__key")) * F.ceil(F.col("__n") / per_piece)))
    ranked = prefix_sums(keyed, "__source", "__piece", ["__key", "__id", "text_crc32"], "__one", "__rank")
    ranked = saved(
        ranked.select("__id", "size", "text_crc32", "__key", "__one", F.lit(0).alias("__all"), ((F.col("__rank") - F.col("__u")) / F.col("__n")).alias("__frac")), "shard-ranks"
    ).withColumn("__cell", F.floor(F.col("__frac") * pieces))
    placed = prefix_sums(ranked, "__all", "__cell", ["__frac", "__key", "__id", "text_crc32"], "__one", "__place")
    place, n = F.col("__place") - 1, F.lit(max(1, total))
    shard = F.expr(f"((__place - 1) * {n_shards}L) div {max(1, total)}L")
    return placed.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (place - F.ceil(shard * n / n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
