"""Bars and ticks from files: column aliases, headerless exchange files, epoch units, months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import month_of, to_epoch_ms

# Names that input files use for each column, in order of preference.
ALIASES = {
    "ts": ("ts", "timestamp", "open_time", "time"),
    "open": ("open", "o", "open_price"),
    "high": ("high", "h", "high_price"),
    "low": ("low", "l", "low_price"),
    "close": ("close", "c", "close_price"),
}
TICK_ALIASES = {"ts": ("ts", "timestamp"), "price": ("price", "last_price")}
#: Names of the first columns of headerless exchange files.
EXCHANGE_COLUMNS = ("open_time", "open", "high", "low", "close")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def existing(spark: SparkSession, path: str) -> str | None:
    """The path, or the one that swaps .csv and .parquet; None if neither exists."""
    other = path[:-4] + ".parquet" if path.endswith(".csv") else path[:-8] + ".csv" if path.endswith(".parquet") else path
    return next((p for p in (path, other) if _exists(spark, p)), None)


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        first = spark.read.text(path).limit(1).collect()
        return first[0][0] if first else None
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return lines.readLine()
    finally:
        lines.close()


def _read(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The files' rows with their file as __file: one scan for all files of one kind and header."""
    kinds: dict[tuple, list[str]] = {}
    for path in paths:
        parquet = path.endswith(".parquet")
        line = None if parquet else _first_line(spark, path)
        names = (line or "").split(",")
        headless = names[0].strip().lstrip("-").replace(".", "", 1).isdigit()
        kinds.setdefault((parquet, headless, len(names) if headless else line), []).append(path)
    frames = []
    for (parquet, headless, _), of in kinds.items():
        df = spark.read.parquet(*of) if parquet else spark.read.csv(of, header=not headless)
        if headless:
            df = df.toDF(*[EXCHANGE_COLUMNS[i] if i < len(EXCHANGE_COLUMNS) else f"x{i}" for i in range(len(df.columns))])
        frames.append(df.withColumn("__file", F.input_file_name()))
    return frames


def _aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """The first column by each alias that exists, whatever its case; values that are no number are null."""
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {}
    for name, options in aliases.items():
        at = next((by_name[o] for o in options if o in by_name), None)
        if at is None:
            raise ValueError(f"no column for {name}: one of {', '.join(options)} is needed, there are {', '.join(df.columns)}")
        number = F.expr(f"try_cast(`{at}` AS DOUBLE)")
        found[name] = F.when(~F.isnan(number), number)
    return found


def _in_ms(df: DataFrame) -> DataFrame:
    """ts in epoch milliseconds, by the largest of its file (or of the folder that the file lies in)."""
    df = df.withColumn("__file", F.regexp_replace("__file", "/part-[^/]*$", ""))
    largest = df.groupBy(F.col("__file").alias("__of")).agg(F.max("ts").alias("__top"))
    joined = df.join(F.broadcast(largest), F.col("__file") == F.col("__of"))  # a row a file
    return joined.withColumn("ts", to_epoch_ms(F.col("ts"), F.col("__top"))).drop("__file", "__of", "__top")


def _bars(df: DataFrame, symbol: str) -> DataFrame:
    df = df.select("__file", *[c.alias(name) for name, c in _aliased(df, ALIASES).items()]).dropna()
    return _in_ms(df).select(F.lit(symbol).alias("symbol"), "ts", "open", "high", "low", "close")


def _ticks(df: DataFrame, symbol: str) -> DataFrame:
    seq = F.monotonically_increasing_id()
    df = df.select("__file", *[c.alias(name) for name, c in _aliased(df, TICK_ALIASES).items()], seq.alias("seq"))
    df = df.where(F.col("ts").isNotNull() & F.col("price").isNotNull() & (F.abs("price") != float("inf")))
    return _in_ms(df).select(F.lit(symbol).alias("symbol"), "ts", "seq", "price")


def read_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """symbol, ts (epoch ms), open, high, low, close; rows with a missing value are dropped."""
    return _bars(_read(spark, [path])[0], symbol)


def months_with_files(spark: SparkSession, pattern: str, symbol: str, months: list[str]) -> list[str]:
    """The files of the months that have one; {SYMBOL}, {YYYY} and {MM} are filled in."""
    found = (existing(spark, pattern.format(SYMBOL=symbol, YYYY=ym[:4], MM=ym[5:7])) for ym in months)
    return [p for p in found if p]


def read_bars_months(spark: SparkSession, pattern: str, symbol: str, months: list[str]) -> DataFrame:
    """Bars of all months with a file, with their month `ym`."""
    paths = months_with_files(spark, pattern, symbol, months)
    if not paths:
        raise FileNotFoundError(f"no bars of {symbol} for {', '.join(months)}")
    return reduce(DataFrame.unionByName, [_bars(df, symbol) for df in _read(spark, paths)]).withColumn("ym", month_of(F.col("ts")))


def read_ticks(spark: SparkSession, paths: str | list[str], symbol: str) -> DataFrame:
    """symbol, ts (epoch ms), seq (order within a file), price of one file or several; rows without a finite time or price are dropped."""
    return reduce(DataFrame.unionByName, [_ticks(df, symbol) for df in _read(spark, [paths] if isinstance(paths, str) else paths)])


def ticks_between(ticks: DataFrame, start: int, end: int) -> DataFrame:
    """Ticks with start <= ts <= end; a filter that reaches the scan."""
    return ticks.where(F.col("ts").between(start, end))


def bars_from_ticks(ticks: DataFrame, width_ms: int) -> DataFrame:
    """OHLC bars of fixed width; ticks of one time are ordered by seq. Aggregated before the shuffle."""
    at = F.struct("ts", "seq")
    start = (F.floor(F.col("ts") / width_ms) * width_ms).cast("long").alias("bar")
    bars = ticks.groupBy("symbol", start).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n_ticks")
    )
    return bars.withColumnRenamed("bar", "ts")


def folds(months: list[str], train: int, test: int, step: int) -> list[tuple[int, list[str], list[str]]]:
    """Walk-forward folds: (number, train months, test months)."""
    out, at = [], 0
    while at + train + test <= len(months):
        out.append((len(out), months[at : at + train], months[at + train : at + train + test]))
        at += step
    return out


def month_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    """ym of every month from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("ym"))
