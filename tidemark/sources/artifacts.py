"""Artifacts beside the tables: JSON, fingerprints, empty tables, events of all folds."""

from __future__ import annotations

import hashlib
import json
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_SCHEMA = "ts long, side string, rule_id string, entry double, level double, risk_dist double, outcome string, outcome_ts long, p_win double, R double, enter boolean"


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """Indented JSON in any file system that Spark reaches; missing numbers become NaN."""
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_report(spark: SparkSession, error: BaseException, root: str) -> str:
    """What a failed run leaves behind: error, traceback and the files below root with their sizes. Returns the report's path."""
    at, fs = _file(spark, root)
    files, walk = {}, fs.listFiles(at, True) if fs.exists(at) else None
    while walk is not None and walk.hasNext():
        status = walk.next()
        files[status.getPath().toString()] = status.getLen()
    path = f"{root}/crash_report.json"
    write_json(spark, {"error": repr(error), "traceback": traceback.format_exception(error), "files": files}, path)
    return path


def fingerprint(cfg: dict, tables: dict[str, DataFrame]) -> dict:
    """SHA-256 of the configuration, and for each table its rows and an order-free hash of them."""
    marks = {}
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("hash")).first()
        marks[name] = row.asDict()
    return {"config": hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest(), "tables": marks}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def no_trades(spark: SparkSession) -> DataFrame:
    """The trade table without rows."""
    return spark.createDataFrame([], TRADE_SCHEMA)


def events_of_folds(spark: SparkSession, root: str, table: str = "labels") -> DataFrame:
    """A table of all folds under root/SYMBOL/fold_N, with `fold`; unreadable files are passed over."""
    df = spark.read.option("ignoreCorruptFiles", True).parquet(f"{root}/*/fold_*/{table}.parquet")
    return df.withColumn("fold", F.regexp_extract(F.input_file_name(), r"/fold_(\d+)/", 1).cast("int"))
