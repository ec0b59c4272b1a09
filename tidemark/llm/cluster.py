"""Helpers shared by the operators: tables in the shared folder, size-checked broadcasts, distributed prefix sums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.staging import shared_folder

#: A table of at most this many rows (two or three plain columns) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Hash keys are the first 60 bits of an MD5, so that any engine can recompute them.
KEY_BITS = 60
#: Bytes of the rows that go to a Python worker at once, unless the session sets a limit of its own: an executor holds a batch
#: several times, in the JVM and in the worker.
BATCH_BYTES = 1 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends here and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Saves df and marks it for broadcast if it has at most `limit` rows; larger, it is joined by a shuffle."""
    table = saved(df, name)
    return F.broadcast(table) if table.count() <= limit else table.hint("merge")


def in_python(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow() in batches of about BATCH_BYTES; a longer row is a batch of its own. The limit stays set in the session, as the table is made later.

    At a task's end the worker gives back what it holds unused, as later stages may leave it idle.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seeded_key(seed: str, *parts: Column) -> Column:
    """A long in [0, 2**60): the first 15 hex digits of an MD5 over the seed and the parts (nulls left out)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def unit(key: Column) -> Column:
    """A seeded key as a double in [0, 1)."""
    return key.cast("double") / F.lit(float(1 << KEY_BITS))


def prefix_sums(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the inclusive sum of `value` over the rows of `group`, sorted by (bucket, *order).

    `bucket` must be non-null and grow with the wanted order; it cuts a group of any size into pieces that are
    sorted apart, so no task holds a whole group. Only one total for each piece is summed across pieces.
    df is read twice and should be a saved table.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(group).orderBy(bucket)) - F.col("__t")
    offsets = small(totals.select(F.col(group).alias("__og"), F.col(bucket).alias("__ob"), before.alias("__before")), "offsets")
    within = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = df.join(offsets, (F.col(group) == F.col("__og")) & (F.col(bucket) == F.col("__ob")))
    return joined.withColumn(out, F.col("__before") + within).drop("__og", "__ob", "__before")


_kept: dict = {}


def kept(name: object, make):
    """In a worker: what make() gives, kept for later tasks until another operator's task begins; so a worker that many stages use holds one model at a time."""
    if name not in _kept:
        release()
        _kept[name] = make()
        give_back()  # what making it took
    return _kept[name]


def release() -> None:
    """In a worker: drops what an earlier operator kept, and memory that is held unused."""
    if _kept:
        _kept.clear()
        gc.collect()
    give_back()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim(), where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """In a worker: memory that Arrow and the C library hold unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)
