"""Tables that a later step reads more than once, written where all executors can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as spark.checkpoint.dir names it; where that is unset, /tmp/checkpoints in local mode, else the warehouse if it isn't on a machine's own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "/tmp/checkpoints"
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a machine's own disk.")
    return warehouse


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, so nothing is computed twice or lost with an executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
