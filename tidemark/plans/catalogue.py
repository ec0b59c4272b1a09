"""One query for each operator over the test tables, with the SQL that gives the same rows.

Ticks are `events` (symbol = event_type, seq = event_id, price = value); bars are hourly bars of them; daily bars come
from `orders`; labelled outcomes from `lineitem` (A wins, R loses, N times out). Doubles are rounded to 6 places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import windows as W
from tidemark.operators import candidates, evaluate, features, labeling, mining, quantiles, sequential
from tidemark.sources import series

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bars_from_ticks(ticks(spark, sf_dir), HOUR)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    t = o.select(F.lit("D").alias("symbol"), day.alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("price"))
    return series.bars_from_ticks(t, 24 * HOUR)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events with binned literals q, d, t, ln."""
    li = table(spark, sf_dir, "lineitem")
    out = li.select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("ym"), F.to_date("l_shipdate").alias("day"),
        F.when(F.col("l_returnflag") == "A", "win").when(F.col("l_returnflag") == "R", "loss").otherwise("timeout").alias("outcome"),
        F.floor(F.col("l_quantity").cast("double") / 10).cast("long").alias("q"), F.floor(F.col("l_discount").cast("double") * 50 + 0.001).cast("long").alias("d"),
        F.floor(F.col("l_tax").cast("double") * 50 + 0.001).cast("long").alias("t"), F.col("l_linenumber").cast("long").alias("ln"),
    )
    return mining.flagged(out)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p, y, ym: a score that follows from n_chars against the quality label."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = lab.join(d.select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", ((F.col("n_chars") % 97) / 96.0).alias("p"), F.col("quality").cast("int").alias("y"), (F.col("doc_id") % 6).cast("int").alias("m"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts, event_id AS seq, value AS price FROM events)"
BARS = f"""{TICKS},
bars AS (SELECT symbol, CAST(ts // {HOUR} * {HOUR} AS BIGINT) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, seq)) AS close, count(*) AS n_ticks FROM ticks GROUP BY 1, 2)"""
DAILY = f"""dticks AS (SELECT 'D' AS symbol, epoch_ms(o_orderdate::TIMESTAMP) AS ts, o_orderkey AS seq, o_totalprice::DOUBLE AS price FROM orders),
bars AS (SELECT symbol, CAST(ts // {24 * HOUR} * {24 * HOUR} AS BIGINT) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, seq)) AS close, count(*) AS n_ticks FROM dticks GROUP BY 1, 2)"""
OUT = """ev AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS ym, l_shipdate::DATE AS day,
  CAST(l_returnflag = 'A' AS INTEGER) AS is_win, CAST(l_returnflag = 'R' AS INTEGER) AS is_loss, CAST(l_returnflag NOT IN ('A', 'R') AS INTEGER) AS is_to,
  CAST(floor(l_quantity::DOUBLE / 10) AS BIGINT) AS q, CAST(floor(l_discount::DOUBLE * 50 + 0.001) AS BIGINT) AS d,
  CAST(floor(l_tax::DOUBLE * 50 + 0.001) AS BIGINT) AS t, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem)"""
SCORED = "sc AS (SELECT l.doc_id, (n_chars % 97) / 96.0::DOUBLE AS p, CAST(quality AS INTEGER) AS y, CAST(l.doc_id % 6 AS INTEGER) AS m FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
BY = "OVER (PARTITION BY symbol ORDER BY ts)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / {n}::DOUBLE)"
    spread = f"1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n})"
    low = f"CASE WHEN {n} > 0 THEN greatest(({p} + 3.8416 / (2 * {n}) - {spread}) / (1 + 3.8416 / {n}), 0.0) ELSE 0.0 END"
    high = f"CASE WHEN {n} > 0 THEN least(({p} + 3.8416 / (2 * {n}) + {spread}) / (1 + 3.8416 / {n}), 1.0) ELSE 0.0 END"
    return low, high


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# --- bars and time ------------------------------------------------------------------------------------------------
@query("ohlc_bars", f"WITH {BARS} SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, n_ticks FROM bars")
def ohlc_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query("tick_window", f"WITH {TICKS} SELECT symbol, ts, seq, {r('price', 'price')} FROM ticks WHERE ts BETWEEN 1704499200000 AND 1704585600000")
def tick_window(spark, sf_dir):
    return series.ticks_between(ticks(spark, sf_dir), 1704499200000, 1704585600000)


@query("epoch_coerce", f"WITH {DAILY} SELECT CAST(ts AS BIGINT) AS ts, ts AS from_s, ts AS from_us, ts AS from_ns FROM bars")
def epoch_coerce(spark, sf_dir):
    d = daily(spark, sf_dir).select("ts", (F.col("ts") / 1000).cast("long").alias("s"), (F.col("ts") * 1000).alias("us"), (F.col("ts") * 1_000_000).alias("ns"))
    top = d.agg(*[F.max(c).alias(f"top_{c}") for c in ("s", "us", "ns")])
    d = d.crossJoin(F.broadcast(top))
    return d.select("ts", *[stats.to_epoch_ms(F.col(c), F.col(f"top_{c}")).alias(f"from_{c}") for c in ("s", "us", "ns")])


@query("month_folds", f"""WITH {DAILY}, m AS (SELECT DISTINCT strftime(make_timestamp(ts * 1000), '%Y-%m') AS ym FROM bars),
n AS (SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS i, count(*) OVER () AS c FROM m), f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1000))
SELECT fold, ym, CASE WHEN i < fold + 6 THEN 'train' ELSE 'test' END AS role FROM f JOIN n ON i BETWEEN fold AND fold + 6 WHERE fold + 7 <= c""")
def month_folds(spark, sf_dir):
    span = daily(spark, sf_dir).select(stats.month_of(F.col("ts")).alias("ym")).agg(F.min("ym").alias("a"), F.max("ym").alias("b")).first()
    months = [x["ym"] for x in series.month_range(spark, span["a"], span["b"]).collect()]  # a row a month
    rows_ = [(k, ym, role) for k, train, test in series.folds(months, 6, 1, 1) for role, part in (("train", train), ("test", test)) for ym in part]
    return spark.createDataFrame(rows_, "fold int, ym string, role string")


# --- windows ------------------------------------------------------------------------------------------------------
@query("log_return", f"WITH {BARS} SELECT symbol, ts, {r(f'ln(close) - lag(ln(close)) {BY}', 'ret')} FROM bars")
def log_return(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "ts", W.log_return(F.col("close")).alias("ret"))


TR = f"greatest(high - low, abs(high - lag(close) {BY}), abs(low - lag(close) {BY}))"


@query("true_range", f"WITH {BARS} SELECT symbol, ts, {r(TR, 'tr')} FROM bars")
def true_range(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "ts", W.true_range().alias("tr"))


@query("ema_atr", f"""WITH RECURSIVE {BARS}, t AS (SELECT symbol, ts, {TR} AS tr, row_number() {BY} AS i FROM bars),
e AS (SELECT symbol, ts, i, tr AS ema FROM t WHERE i = 1 UNION ALL
      SELECT t.symbol, t.ts, t.i, e.ema + (t.tr - e.ema) * 2 / 15 FROM e JOIN t ON t.symbol = e.symbol AND t.i = e.i + 1)
SELECT symbol, ts, {r('ema', 'atr')} FROM e""")
def ema_atr(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", W.true_range().alias("tr"))
    return sequential.ema(b, "tr", 14, "atr").select("symbol", "ts", "atr")


@query("roll_tstat", f"""WITH {BARS}, x AS (SELECT symbol, ts, ln(close) - lag(ln(close)) {BY} AS ret FROM bars),
y AS (SELECT symbol, ts, count(ret) {rows(24)} AS c, avg(ret) {rows(24)} AS a, stddev_samp(ret) {rows(24)} AS s FROM x)
SELECT symbol, ts, {r('CASE WHEN c >= 24 AND s > 0 THEN a * sqrt(24) / s END', 't')} FROM y""")
def roll_tstat(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret", W.log_return(F.col("close")))
    return b.select("symbol", "ts", W.t_stat(F.col("ret"), 24).alias("t"))


@query("donchian", f"""WITH {BARS}, x AS (SELECT symbol, ts, count(*) {rows(20)} AS c, max(high) {rows(20)} AS h, min(low) {rows(20)} AS l FROM bars)
SELECT symbol, ts, {r('CASE WHEN c >= 20 THEN h END', 'dch')}, {r('CASE WHEN c >= 20 THEN l END', 'dcl')}, {r('CASE WHEN c >= 20 THEN h - l END', 'dcw')} FROM x""")
def donchian(spark, sf_dir):
    hi, lo = W.channel(20)
    return bars(spark, sf_dir).select("symbol", "ts", hi.alias("dch"), lo.alias("dcl"), (hi - lo).alias("dcw"))


@query("rolling_hi_lo", f"WITH {BARS} SELECT symbol, ts, {r(f'max(high) {rows(60)}', 'hi')}, {r(f'min(low) {rows(60)}', 'lo')} FROM bars")
def rolling_hi_lo(spark, sf_dir):
    hi, lo = W.channel(60, least=1)
    return bars(spark, sf_dir).select("symbol", "ts", hi.alias("hi"), lo.alias("lo"))


RET = f"x AS (SELECT *, coalesce(ln(close) - lag(ln(close)) {BY}, 0.0) AS ret0, ln(close) - lag(ln(close)) {BY} AS ret, {TR} AS tr FROM bars)"


@query("zero_cross", f"WITH {BARS}, {RET}, y AS (SELECT symbol, ts, CASE WHEN sign(ret0) * lag(sign(ret0)) {BY} < 0 THEN 1.0 ELSE 0.0 END AS c FROM x) SELECT symbol, ts, {r(f'avg(c) {rows(60)}', 'zcr')} FROM y")
def zero_cross(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret", W.log_return(F.col("close"))).withColumn("c", W.crossed(F.col("ret")))
    return b.select("symbol", "ts", F.avg("c").over(W.last(60)).alias("zcr"))


@query("sign_entropy", f"""WITH {BARS}, {RET}, y AS (SELECT symbol, ts, greatest(1e-6, least(1 - 1e-6, avg(CASE WHEN ret0 > 0 THEN 1.0 ELSE 0.0 END) {rows(60)})) AS p FROM x)
SELECT symbol, ts, {r('-(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2.0)', 'entropy')} FROM y""")
def sign_entropy(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret", W.log_return(F.col("close")))
    return b.select("symbol", "ts", W.sign_entropy(F.col("ret"), 60).alias("entropy"))


@query("dir_changes", f"WITH {BARS}, {RET}, y AS (SELECT symbol, ts, CASE WHEN sign(ret0) IS NOT DISTINCT FROM lag(sign(ret0)) {BY} THEN 0 ELSE 1 END AS c FROM x) SELECT symbol, ts, CAST(sum(c) {rows(60)} AS BIGINT) AS n FROM y")
def dir_changes(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret", W.log_return(F.col("close"))).withColumn("c", W.turned(F.col("ret")))
    return b.select("symbol", "ts", F.sum("c").over(W.last(60)).alias("n"))


@query("rolling_std", f"WITH {BARS}, {RET} SELECT symbol, ts, {r(f'CASE WHEN count(ret) {rows(60)} >= 10 THEN stddev_samp(ret) {rows(60)} END', 'rv')} FROM x")
def rolling_std(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret", W.log_return(F.col("close")))
    return b.select("symbol", "ts", W.full(F.stddev_samp("ret"), F.col("ret"), W.last(60), 10).alias("rv"))


@query("vol_of_vol", f"""WITH {BARS}, {RET}, y AS (SELECT symbol, ts, CASE WHEN count(tr) {rows(5)} >= 3 THEN avg(tr) {rows(5)} END AS m FROM x)
SELECT symbol, ts, {r(f'CASE WHEN count(m) {rows(12)} >= 6 THEN stddev_samp(m) {rows(12)} END', 'vv')} FROM y""")
def vol_of_vol(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("tr", W.true_range()).withColumn("m", W.full(F.avg("tr"), F.col("tr"), W.last(5), 3))
    return b.select("symbol", "ts", W.full(F.stddev_samp("m"), F.col("m"), W.last(12), 6).alias("vv"))


@query("rolling_sigma_fill", f"""WITH {BARS}, {RET}, y AS (SELECT symbol, ts, ret0, CASE WHEN count(*) {rows(60)} >= 20 THEN stddev_pop(ret0) {rows(60)} END AS s FROM x)
SELECT symbol, ts, {r('greatest(coalesce(s, min(s) OVER (PARTITION BY symbol), stddev_pop(ret0) OVER (PARTITION BY symbol), 0.0), 1e-12)', 'sigma')} FROM y""")
def rolling_sigma_fill(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("ret0", F.coalesce(W.log_return(F.col("close")), F.lit(0.0)))
    return W.sigma_filled(b, "ret0", 60, "sigma").select("symbol", "ts", "sigma")


UP = "CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END"


@query("run_length", f"""WITH {BARS}, y AS (SELECT symbol, ts, {UP} AS b FROM bars), z AS (SELECT *, CASE WHEN b IS NOT DISTINCT FROM lag(b) {BY} THEN 0 ELSE 1 END AS n FROM y),
i AS (SELECT *, sum(n) {BY} AS island FROM z) SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY ts) AS INTEGER) AS age FROM i""")
def run_length(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("b", F.signum(F.col("close") - F.col("open")).cast("int"))
    return W.run_lengths(b, "b", "age").select("symbol", "ts", "age")


@query("time_since", f"""WITH {BARS}, y AS (SELECT symbol, ts, n_ticks >= 5 AS f, row_number() {BY} AS i FROM bars)
SELECT symbol, ts, CAST(i - max(CASE WHEN f THEN i END) {BY} AS INTEGER) AS since FROM y""")
def time_since(spark, sf_dir):
    return W.rows_since(bars(spark, sf_dir), F.col("n_ticks") >= 5, "since").select("symbol", "ts", "since")


@query("occupancy", f"WITH {BARS} SELECT symbol, ts, {r(f'avg(CASE WHEN n_ticks >= 5 THEN 1.0 ELSE 0.0 END) {rows(24)}', 'occ')} FROM bars")
def occupancy(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "ts", W.occupancy(F.col("n_ticks") >= 5, 24).alias("occ"))


@query("bar_seconds", f"""WITH {BARS}, d AS (SELECT symbol, ts - lag(ts) {BY} AS d FROM bars), c AS (SELECT symbol, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1, 2)
SELECT symbol, CAST(arg_min(d, (-n, d)) // 1000 AS BIGINT) AS bar_seconds FROM c GROUP BY symbol""")
def bar_seconds(spark, sf_dir):
    d = bars(spark, sf_dir).withColumn("d", F.col("ts") - F.lag("ts").over(W.ordered())).where("d IS NOT NULL")
    return d.groupBy("symbol").agg(F.expr("mode(d, true)").alias("d")).select("symbol", F.expr("d div 1000").alias("bar_seconds"))


@query("time_units", f"""WITH {BARS}, d AS (SELECT symbol, ts - lag(ts) {BY} AS d FROM bars), m AS (SELECT symbol, median(d) AS ms, median(d / 1000) AS s, median(d * 1000000.0) AS ns FROM d WHERE d > 0 GROUP BY 1)
SELECT symbol, {', '.join(f"CASE WHEN {c} >= 1e10 THEN 'ns' WHEN {c} >= 1e4 THEN 'ms' ELSE 'sec' END AS unit_{c}" for c in ('ms', 's', 'ns'))} FROM m""")
def time_units(spark, sf_dir):
    d = bars(spark, sf_dir).withColumn("d", (F.col("ts") - F.lag("ts").over(W.ordered())).cast("double")).where("d > 0")
    steps = d.groupBy("symbol").agg(*[F.percentile(F.col("d") * by, F.lit(0.5)).alias(c) for c, by in (("ms", 1.0), ("s", 0.001), ("ns", 1e6))])
    return steps.select("symbol", *[stats.time_unit(F.col(c)).alias(f"unit_{c}") for c in ("ms", "s", "ns")])


# --- fitted features ----------------------------------------------------------------------------------------------
EDGES5 = "quantile_cont(close, [0.2, 0.4, 0.6, 0.8])"


@query("quantile_edges", f"WITH {DAILY}, e AS (SELECT {EDGES5} AS e FROM bars WHERE ts < 946684800000) SELECT CAST(i AS INTEGER) AS i, {r('e[i + 1]', 'edge')} FROM e, (SELECT unnest([0, 1, 2, 3]) AS i)")
def quantile_edges(spark, sf_dir):
    e = features.quantile_edges(daily(spark, sf_dir).where("ts < 946684800000"), ["close"], 5)
    return e.select(F.posexplode("edges_close").alias("i", "edge"))


@query("qbin_apply", f"WITH {DAILY}, e AS (SELECT {EDGES5} AS e FROM bars WHERE ts < 946684800000) SELECT symbol, ts, CAST(len(list_filter(e, lambda x: x <= close)) AS INTEGER) AS qbin FROM bars, e")
def qbin_apply(spark, sf_dir):
    d = daily(spark, sf_dir)
    return features.with_bins(d, features.quantile_edges(d.where("ts < 946684800000"), ["close"], 5), ["close"], 5).select("symbol", "ts", F.col("qbin_close").alias("qbin"))


@query("ecdf_rank", f"""WITH {DAILY}, t AS (SELECT close AS c FROM bars WHERE ts < 946684800000)
SELECT symbol, ts, {r('(SELECT count(*) FROM t WHERE c <= close) * 100.0 / (SELECT count(*) FROM t)', 'pct')} FROM bars""")
def ecdf_rank(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("train", F.col("ts") < 946684800000)
    return features.train_ranks(d, {"close": "pct"}, "train").select("symbol", "ts", "pct")


NL = f"""{BARS}, x AS (SELECT *, {TR} AS tr, ln(close) - lag(ln(close)) {BY} AS ret FROM bars),
y AS (SELECT *, {', '.join(f'CASE WHEN count(ret) {rows(h)} >= {h} AND stddev_samp(ret) {rows(h)} > 0 THEN round(avg(ret) {rows(h)} * sqrt({h}) / stddev_samp(ret) {rows(h)}, 9) END AS t_{h}' for h in (48, 24, 12))},
  CASE WHEN count(*) {rows(20)} >= 20 THEN max(high) {rows(20)} END AS dch, CASE WHEN count(*) {rows(20)} >= 20 THEN min(low) {rows(20)} END AS dcl,
  avg(tr) {rows(14)} AS atr FROM x)"""


def _plain(spark, sf_dir) -> DataFrame:
    """Bars with t-statistics (rounded, so that noise has no sign), channel and the mean true range as ATR."""
    hi, lo = W.channel(20)
    b = bars(spark, sf_dir).withColumns({"tr": W.true_range(), "true_range": W.true_range(), "ret_1m": W.log_return(F.col("close"))})
    b = b.withColumns({f"t_{h}": F.round(W.t_stat(F.col("ret_1m"), h), 9) for h in (48, 24, 12)} | {"dch": hi, "dcl": lo, "atr": F.avg("tr").over(W.last(14))})
    atr = F.when(F.col("atr") != 0, F.col("atr"))
    return b.withColumns({"body_dom": F.abs(F.col("close") - F.col("open")) / atr, "close_to_hi_atr": (F.col("dch") - F.col("close")) / atr, "close_to_lo_atr": (F.col("close") - F.col("dcl")) / atr, "accel_15_240": F.col("t_12") - F.col("t_48")})


@query("nl_trend_family", f"""WITH {NL} SELECT symbol, ts, {r('t_12 - 2 * t_24 + t_48', 'nl_convexity_15_60_240')}, CAST(coalesce(sign(t_12), 0) = coalesce(sign(t_24), 0) AS INTEGER) AS nl_trend_agree_15_60,
CAST(coalesce(sign(t_24), 0) = coalesce(sign(t_48), 0) AS INTEGER) AS nl_trend_agree_60_240, {r('coalesce(CASE WHEN t_24 <> 0 THEN abs(t_12) / abs(t_24) END, 0.0)', 'nl_trend_ratio_15_60')} FROM y""")
def nl_trend_family(spark, sf_dir):
    names = ["convexity_15_60_240", "trend_agree_15_60", "trend_agree_60_240", "trend_ratio_15_60"]
    return features.nonlinear_features(_plain(spark, sf_dir), names, horizons=(48, 24, 12)).select("symbol", "ts", *[f"nl_{n}" for n in names])


@query("location_family", f"""WITH {NL}, z AS (SELECT *, abs(close - open) / nullif(atr, 0) AS bd, (dch - close) / nullif(atr, 0) AS hi, (close - dcl) / nullif(atr, 0) AS lo FROM y)
SELECT symbol, ts, CAST(coalesce(hi <= 0.25, false) AS INTEGER) AS nl_pin_high, CAST(coalesce(lo <= 0.25, false) AS INTEGER) AS nl_pin_low, {r('bd * CAST(coalesce(hi <= 0.25, false) AS INTEGER)', 'nl_impulse_near_high')},
{r('bd * CAST(coalesce(lo <= 0.25, false) AS INTEGER)', 'nl_impulse_near_low')}, {r('coalesce(CASE WHEN hi + lo <> 0 THEN hi / (hi + lo) END, 0.0)', 'nl_pos_01')} FROM z""")
def location_family(spark, sf_dir):
    names = ["pin_high", "pin_low", "impulse_near_high", "impulse_near_low", "pos_01"]
    return features.nonlinear_features(_plain(spark, sf_dir), names, horizons=(48, 24, 12)).select("symbol", "ts", *[f"nl_{n}" for n in names])


@query("squeeze_family", f"""WITH {NL}, z AS (SELECT symbol, ts, dch - dcl AS dcw FROM y),
p AS (SELECT symbol, ts, dcw, CASE WHEN dcw IS NULL THEN 100.0 ELSE (SELECT count(*) FROM z b WHERE b.symbol = z.symbol AND b.dcw <= z.dcw) * 100.0 / (SELECT count(dcw) FROM z b WHERE b.symbol = z.symbol) END AS dcw_p FROM z)
SELECT symbol, ts, {r('100 - dcw_p', 'nl_squeeze_score')}, {r(f'dcw_p - lag(dcw_p, 15) {BY}', 'nl_release_slope_15')} FROM p""")
def squeeze_family(spark, sf_dir):
    b = _plain(spark, sf_dir).withColumns({"dcw": F.col("dch") - F.col("dcl"), "train": F.lit(True)})
    b = features.train_ranks(b, {"dcw": "dcw_p"}, "train")
    return features.nonlinear_features(b, ["squeeze_score", "release_slope_15"], horizons=(48, 24, 12)).select("symbol", "ts", "nl_squeeze_score", "nl_release_slope_15")


@query("age_family", f"""WITH {DAILY}, e AS (SELECT {EDGES5} AS e FROM bars WHERE ts < 946684800000), b AS (SELECT symbol, ts, len(list_filter(e, lambda x: x <= close)) AS q FROM bars, e),
c AS (SELECT *, CASE WHEN q IS NOT DISTINCT FROM lag(q) {BY} THEN 0 ELSE 1 END AS n, row_number() {BY} AS i FROM b), d AS (SELECT *, sum(n) {BY} AS island FROM c)
SELECT symbol, ts, CAST(q AS INTEGER) AS qbin_close, CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY ts) AS INTEGER) AS agebin_close,
CAST(i - max(CASE WHEN q = 0 THEN i END) {BY} AS INTEGER) AS since_lowbin_close, CAST(i - max(CASE WHEN q = 4 THEN i END) {BY} AS INTEGER) AS since_highbin_close,
{r(f'avg(CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END) {rows(60)}::FLOAT', 'occ_lowbin_close_W60')}, {r(f'avg(CASE WHEN q = 4 THEN 1.0 ELSE 0.0 END) {rows(60)}::FLOAT', 'occ_highbin_close_W60')} FROM d""")
def age_family(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("train", F.col("ts") < 946684800000)
    out = features.age_features(d, ["close"], "train", windows=(60,))
    return out.select("symbol", "ts", "qbin_close", "agebin_close", "since_lowbin_close", "since_highbin_close", F.col("occ_lowbin_close_W60").cast("double"), F.col("occ_highbin_close_W60").cast("double"))


# --- candidates ---------------------------------------------------------------------------------------------------
@query("cusum_events", f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, ts, coalesce(ln(close) - lag(ln(close)) {BY}, 0.0) AS ret, row_number() {BY} AS i FROM bars),
s0 AS (SELECT symbol, ts, i, greatest(0.0, ret) AS up, least(0.0, ret) AS dn FROM x WHERE i = 1),
s AS (SELECT symbol, ts, i, up > 1.5 OR dn < -1.5 AS hit, CASE WHEN up > 1.5 OR dn < -1.5 THEN 0.0 ELSE up END AS up, CASE WHEN up > 1.5 OR dn < -1.5 THEN 0.0 ELSE dn END AS dn,
        CASE WHEN up > 1.5 OR dn < -1.5 THEN i ELSE -1000 END AS last, up > 1.5 OR dn < -1.5 AS event FROM s0
      UNION ALL
      SELECT symbol, ts, i, u > 1.5 OR d < -1.5, CASE WHEN u > 1.5 OR d < -1.5 THEN 0.0 ELSE u END, CASE WHEN u > 1.5 OR d < -1.5 THEN 0.0 ELSE d END,
        CASE WHEN (u > 1.5 OR d < -1.5) AND i - last >= 3 THEN i ELSE last END, (u > 1.5 OR d < -1.5) AND i - last >= 3
      FROM (SELECT x.symbol, x.ts, x.i, greatest(0.0, s.up + x.ret) AS u, least(0.0, s.dn + x.ret) AS d, s.last FROM s JOIN x ON x.symbol = s.symbol AND x.i = s.i + 1))
SELECT symbol, ts, CAST(event AS INTEGER) AS event FROM s""")
def cusum_events(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", F.coalesce(W.log_return(F.col("close")), F.lit(0.0)).alias("ret"), F.lit(1.5).alias("h"))
    return sequential.cusum(b, "ret", "h", min_gap=3).select("symbol", "ts", "event")


@query("stride_sample", f"WITH {BARS}, y AS (SELECT symbol, ts, row_number() {BY} - 1 AS i FROM bars) SELECT symbol, ts FROM y WHERE i % 10 = 0")
def stride_sample(spark, sf_dir):
    return candidates.every_kth(bars(spark, sf_dir), 10).select("symbol", "ts")


GATE = candidates.Gate(0.1, 2.0, 0.1, -3.0, 90.0, 95.0, (0.1, 0.0, 0.0), 2, t=("t_48", "t_24", "t_12"))
GATED = f"""{NL}, g0 AS (SELECT *, abs(close - open) / nullif(atr, 0) AS bd, (dch - close) / nullif(atr, 0) AS hi, (close - dcl) / nullif(atr, 0) AS lo, t_12 - t_48 AS accel, 100.0 * (row_number() {BY} % 100) / 100.0 AS pct FROM y),
g AS (SELECT *, side, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM g0, (VALUES ('long'), ('short')) s(side)),
m AS (SELECT symbol, ts, side, coalesce(bd >= 0.1, false) AS body, coalesce(CASE WHEN side = 'long' THEN hi ELSE lo END <= 2.0, false) AS near, coalesce(abs(t_48) >= 0.1, false) AS trend, coalesce(sign(t_48) = sg, false) AS sign, coalesce(accel >= -3.0, false) AS accel,
  pct <= 90 AS atr, pct <= 95 AS dcw, (coalesce(CAST(sg * t_48 >= 0.1 AS INTEGER), 0) + coalesce(CAST(sg * t_24 >= 0 AS INTEGER), 0) + coalesce(CAST(sg * t_12 >= 0 AS INTEGER), 0)) >= 2 AS quorum FROM g)"""


def _gated(spark, sf_dir) -> DataFrame:
    pct = 100.0 * (F.row_number().over(W.ordered()) % 100) / 100.0
    return _plain(spark, sf_dir).withColumns({"atr_p": pct, "dcw_p": pct})


@query("gate_mask", f"WITH {GATED} SELECT symbol, ts, side FROM m WHERE body AND near AND trend AND sign AND accel AND atr AND dcw AND quorum")
def gate_mask(spark, sf_dir):
    g = _gated(spark, sf_dir)
    parts = [g.where(GATE.mask(s)).select("symbol", "ts", F.lit(s).alias("side")) for s in ("long", "short")]
    return reduce(DataFrame.unionByName, parts)


@query("candidates_gated", f"""WITH {GATED} SELECT m.symbol, m.ts, m.side, {r('g.close', 'entry')}, {r('g.close - g.sg * 0.5 * g.atr', 'level')}, {r('abs(0.5 * g.atr)', 'risk_dist')}, 0.5::DOUBLE AS eta
FROM m JOIN g ON m.symbol = g.symbol AND m.ts = g.ts AND m.side = g.side WHERE body AND near AND trend AND sign AND m.accel AND m.atr AND dcw AND quorum AND abs(0.5 * g.atr) >= 0.2 * g.atr""")
def candidates_gated(spark, sf_dir):
    return candidates.gated(_gated(spark, sf_dir), GATE, eta=0.3, eta_cap=(0.5, 2.0), min_risk=0.2).select("symbol", "ts", "side", "entry", "level", "risk_dist", "eta")


@query("gate_diagnostics", f"""WITH {GATED} SELECT side, count(*) AS rows, {', '.join(f'count(*) FILTER ({c}) AS n_{c}' for c in ('body', 'near', 'trend', 'sign', 'accel', 'atr', 'dcw', 'quorum'))},
count(*) FILTER (body AND near AND trend AND sign AND accel AND atr AND dcw AND quorum) AS n_all FROM m GROUP BY side""")
def gate_diagnostics(spark, sf_dir):
    g = _gated(spark, sf_dir)
    return reduce(DataFrame.unionByName, [GATE.diagnostics(g, s).withColumn("side", F.lit(s)) for s in ("long", "short")])


ETAS = [(0, 20, 5.0), (20, 60, 10.0), (50, 80, 12.0)]


@query("eta_lookup", f"WITH {BARS}, y AS (SELECT symbol, ts, (row_number() {BY} % 100)::DOUBLE AS p FROM bars) SELECT symbol, ts, CASE WHEN p >= 50 AND p < 80 THEN 12.0 WHEN p >= 20 AND p < 60 THEN 10.0 WHEN p >= 0 AND p < 20 THEN 5.0 ELSE 20.0 END + 0.0::DOUBLE AS eta FROM y")
def eta_lookup(spark, sf_dir):
    p = (F.row_number().over(W.ordered()) % 100).cast("double")
    return bars(spark, sf_dir).withColumn("p", p).select("symbol", "ts", stats.lookup(F.col("p"), ETAS, 20.0).alias("eta"))


CANDS = f"""{BARS}, x AS (SELECT *, {TR} AS tr, row_number() {BY} - 1 AS bar_idx FROM bars), a AS (SELECT *, avg(tr) {rows(14)} AS atr FROM x),
c AS (SELECT symbol, ts, side, close AS entry, close - CASE WHEN side = 'long' THEN 1 ELSE -1 END * 0.5 * atr AS level, abs(0.5 * atr) AS risk_dist, atr, bar_idx FROM a, (VALUES ('long'), ('short')) s(side)
      WHERE 0.5 * atr >= 0.001 * atr)"""


def _cands(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("tr", W.true_range()).withColumns({"atr": F.avg("tr").over(W.last(14)), "bar_idx": F.row_number().over(W.ordered()) - 1})
    return candidates.both_sides(b, eta=0.5).select("symbol", "ts", "side", "entry", "level", "risk_dist", "atr", "eta", "bar_idx")


@query("candidates_both_sides", f"WITH {CANDS} SELECT symbol, ts, side, {r('entry', 'entry')}, {r('level', 'level')}, {r('risk_dist', 'risk_dist')}, CAST(bar_idx AS INTEGER) AS bar_idx FROM c")
def candidates_both_sides(spark, sf_dir):
    return _cands(spark, sf_dir).select("symbol", "ts", "side", "entry", "level", "risk_dist", "bar_idx")


@query("dedupe_best_window", f"""WITH RECURSIVE {BARS}, k AS (SELECT symbol, ts, (ts // {HOUR}) * 7 % 5 AS eta, (ts // {HOUR}) * 11 % 100 AS atr_p FROM bars),
best AS (SELECT a.symbol, a.ts AS start, arg_min(b.ts, (b.eta, -b.atr_p, b.ts)) AS ts FROM k a JOIN k b ON a.symbol = b.symbol AND b.ts >= a.ts AND b.ts < a.ts + {6 * HOUR} GROUP BY a.symbol, a.ts),
nxt AS (SELECT best.symbol, start, best.ts, min(k.ts) AS next FROM best LEFT JOIN k ON k.symbol = best.symbol AND k.ts >= greatest(best.ts, start) + {6 * HOUR} GROUP BY ALL),
g AS (SELECT symbol, start, ts, next FROM nxt WHERE start = (SELECT min(ts) FROM k WHERE k.symbol = nxt.symbol) UNION ALL
      SELECT nxt.symbol, nxt.start, nxt.ts, nxt.next FROM g JOIN nxt ON nxt.symbol = g.symbol AND nxt.start = g.next)
SELECT symbol, ts FROM g""")
def dedupe_best_window(spark, sf_dir):
    h = F.expr(f"ts div {HOUR}")
    b = bars(spark, sf_dir).select("symbol", "ts", (h * 7 % 5).cast("double").alias("eta"), (h * 11 % 100).cast("double").alias("atr_p"))
    return sequential.best_in_window(b, 6 * HOUR, ("symbol",)).select("symbol", "ts")


@query("spaced_candidates", f"""WITH RECURSIVE {BARS}, n AS (SELECT a.symbol, a.ts, min(b.ts) AS next FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts >= a.ts + {6 * HOUR} GROUP BY 1, 2),
g AS (SELECT symbol, ts, next FROM n WHERE ts = (SELECT min(ts) FROM bars WHERE bars.symbol = n.symbol) UNION ALL SELECT n.symbol, n.ts, n.next FROM g JOIN n ON n.symbol = g.symbol AND n.ts = g.next) SELECT symbol, ts FROM g""")
def spaced_candidates(spark, sf_dir):
    return sequential.spaced(bars(spark, sf_dir), 6 * HOUR, ("symbol",)).select("symbol", "ts")


# --- labels -------------------------------------------------------------------------------------------------------
def _labels_sql(frm: str, hours: int, mult: float, skip: bool) -> str:
    return f"""{CANDS}, w AS (SELECT *, round(entry, 8) AS e, CASE WHEN greatest(round(risk_dist, 8), 0.05 * round(atr, 8)) > 0 THEN greatest(round(risk_dist, 8), 0.05 * round(atr, 8)) ELSE 1e-6 END AS rr, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM c),
j AS (SELECT w.symbol, w.ts, w.side, any_value(w.e) AS entry, any_value(w.rr) AS risk_dist, count(t.ts) AS n, min(CASE WHEN sg * (t.price - (e + sg * {mult} * rr)) >= 0 THEN (t.ts, t.seq) END) AS tp, min(CASE WHEN sg * (t.price - (e - sg * rr)) <= 0 THEN (t.ts, t.seq) END) AS sl
      FROM w LEFT JOIN {frm} t ON t.symbol = w.symbol AND t.ts BETWEEN w.ts + 1 AND w.ts + {hours * HOUR} GROUP BY 1, 2, 3),
lab AS (SELECT symbol, ts, side, entry, risk_dist, CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp <= sl) THEN 'win' WHEN sl IS NOT NULL THEN 'loss' ELSE 'timeout' END AS outcome,
  CAST(CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp <= sl) THEN tp[1] WHEN sl IS NOT NULL THEN sl[1] ELSE ts + {hours * HOUR} END AS BIGINT) AS outcome_ts, n = 0 AND {str(skip).lower()} AS preempted FROM j)"""


def _labelled(spark, sf_dir, hours: int = 48, mult: float = 3.0) -> DataFrame:
    return labeling.first_touch(_cands(spark, sf_dir), ticks(spark, sf_dir), r_mult=mult, hours=hours)


@query("first_touch_labels", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT symbol, ts, side, outcome, outcome_ts, preempted FROM lab")
def first_touch_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("symbol", "ts", "side", "outcome", "outcome_ts", "preempted")


@query("first_touch_no_ticks", f"WITH {_labels_sql('ticks', 1, 3.0, True)} SELECT symbol, ts, side, outcome, outcome_ts, preempted FROM lab")
def first_touch_no_ticks(spark, sf_dir):
    return labeling.first_touch(_cands(spark, sf_dir), ticks(spark, sf_dir), r_mult=3.0, hours=1, keep_untouched=False).select("symbol", "ts", "side", "outcome", "outcome_ts", "preempted")


@query("outcome_counts", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT symbol, side, outcome, count(*) AS n FROM lab GROUP BY ALL")
def outcome_counts(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("symbol", "side", "outcome").agg(F.count("*").alias("n"))


@query("trade_costs", f"""WITH {_labels_sql('ticks', 48, 3.0, False)}, g AS (SELECT *, CASE outcome WHEN 'win' THEN 3.0 WHEN 'loss' THEN -1.0 ELSE 0.0 END AS R_gross,
 entry / risk_dist * 0.0006 + entry / risk_dist * 0.0001 * greatest((outcome_ts - ts) / 3600000.0, 0) AS R_costs FROM lab WHERE outcome <> 'timeout')
SELECT symbol, ts, side, {r('R_gross', 'R_gross')}, {r('R_costs', 'R_costs')}, {r('R_gross - R_costs', 'R')} FROM g""")
def trade_costs(spark, sf_dir):
    done = _labelled(spark, sf_dir).where("outcome <> 'timeout'")
    return labeling.costs(labeling.r_multiple(done, 3.0)).select("symbol", "ts", "side", "R_gross", "R_costs", "R")


@query("trade_costs_roundtrip", f"""WITH {_labels_sql('ticks', 48, 3.0, False)}, g AS (SELECT *, CASE outcome WHEN 'win' THEN 3.0 WHEN 'loss' THEN -1.0 ELSE 0.0 END AS R_gross,
 entry / risk_dist * 0.0008 + entry / risk_dist * 0.0001 * greatest((outcome_ts - ts) / 3600000.0, 0) AS R_costs FROM lab WHERE outcome <> 'timeout')
SELECT symbol, ts, side, {r('R_costs', 'R_costs')}, {r('R_gross - R_costs', 'R')} FROM g""")
def trade_costs_roundtrip(spark, sf_dir):
    done = _labelled(spark, sf_dir).where("outcome <> 'timeout'")
    return labeling.costs(labeling.r_multiple(done, 3.0), roundtrip_bps=8.0).select("symbol", "ts", "side", "R_costs", "R")


@query("decided_metrics", f"""WITH {_labels_sql('ticks', 48, 3.0, False)}, g AS (SELECT count(*) AS n, count(*) FILTER (side = 'long') AS entries, count(*) FILTER (side = 'long' AND outcome = 'win') AS wins, count(*) FILTER (side = 'long' AND outcome = 'loss') AS losses, count(*) FILTER (side = 'long' AND outcome = 'timeout') AS timeouts FROM lab)
SELECT n, entries, wins, losses, timeouts, {r('entries / n::DOUBLE', 'coverage')}, {r('coalesce(wins / nullif(wins + losses, 0)::DOUBLE, 0.0)', 'ppv')}, {r(wilson_sql('wins', '(wins + losses)')[0], 'ppv_lcb')}, {r('wins * 3.0 - losses', 'net_R')}, {r('coalesce((wins * 3.0 - losses) / nullif(wins + losses, 0), 0.0)', 'avg_R')} FROM g""")
def decided_metrics(spark, sf_dir):
    return evaluate.decided(_labelled(spark, sf_dir).withColumn("enter", F.col("side") == "long"), 3.0)


@query("busy_until_schedule", f"""WITH RECURSIVE {_labels_sql('ticks', 48, 3.0, False)}, o AS (SELECT symbol, ts, side, outcome_ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, side) AS i FROM lab),
s AS (SELECT symbol, ts, side, i, true AS kept, outcome_ts AS free FROM o WHERE i = 1 UNION ALL
      SELECT o.symbol, o.ts, o.side, o.i, o.ts >= s.free, CASE WHEN o.ts >= s.free THEN o.outcome_ts ELSE s.free END FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1)
SELECT symbol, ts, side FROM s WHERE kept""")
def busy_until_schedule(spark, sf_dir):
    return sequential.one_at_a_time(_labelled(spark, sf_dir), 48 * HOUR).select("symbol", "ts", "side")


STOPS = f"""{CANDS}, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS ix FROM ticks),
w AS (SELECT symbol, ts, side, round(entry, 8) AS e, round(level, 8) AS lev, round(atr, 8) AS atr, CASE WHEN greatest(round(risk_dist, 8), 0.001 * round(atr, 8)) > 0 THEN greatest(round(risk_dist, 8), 0.001 * round(atr, 8)) ELSE 1e-6 END AS rr, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM c),
j AS MATERIALIZED (SELECT w.*, t.ts AS t, t.ix, sg * (t.price - (e + sg * rr)) >= 0 AS at_r1, sg * (t.price - (e + sg * 3.0 * rr)) >= 0 AS at_tp, CASE WHEN side = 'long' THEN t.price < lev - 0.05 * atr ELSE t.price > lev + 0.05 * atr END AS beyond
      FROM w JOIN numbered t ON t.symbol = w.symbol AND t.ts BETWEEN w.ts + 1 AND w.ts + {24 * HOUR}),
f AS (SELECT symbol, ts, side, min(CASE WHEN at_r1 THEN (ix, t) END) AS r1, min(CASE WHEN at_tp THEN (ix, t) END) AS tp FROM j GROUP BY 1, 2, 3),
runs AS (SELECT symbol, ts, side, min((ix, t)) AS v FROM (SELECT *, ix - row_number() OVER (PARTITION BY symbol, ts, side ORDER BY ix) AS run FROM j WHERE beyond) GROUP BY symbol, ts, side, run HAVING count(*) >= 2 AND max(t) - min(t) >= 600000),
v AS (SELECT symbol, ts, side, min(v) AS v FROM runs GROUP BY 1, 2, 3),
g AS (SELECT w.symbol, w.ts, w.side, r1, tp, v, v IS NOT NULL AND (tp IS NULL OR v[1] < tp[1]) AS lost FROM w LEFT JOIN f ON w.symbol = f.symbol AND w.ts = f.ts AND w.side = f.side LEFT JOIN v ON w.symbol = v.symbol AND w.ts = v.ts AND w.side = v.side),
h AS (SELECT *, NOT lost AND coalesce(r1[2] <= ts + {4 * HOUR}, false) AS lit FROM g),
stops AS (SELECT symbol, ts, side, CASE WHEN lost THEN 'loss' WHEN lit AND tp IS NOT NULL THEN 'win' ELSE 'timeout' END AS outcome, CAST(CASE WHEN lost THEN v[2] WHEN lit AND tp IS NOT NULL THEN tp[2] ELSE ts + {24 * HOUR} END AS BIGINT) AS outcome_ts,
  CAST(CASE WHEN lit THEN r1[2] END AS BIGINT) AS r1_ts, CAST(CASE WHEN lit THEN tp[2] END AS BIGINT) AS tp_ts FROM h)"""


def _stops(spark, sf_dir) -> DataFrame:
    return labeling.stop_band(_cands(spark, sf_dir), ticks(spark, sf_dir), 3.0, 24, 4, consec_ticks=2, dwell_ms=600_000)


@query("stop_band_labels", f"WITH {STOPS} SELECT symbol, ts, side, outcome, outcome_ts, r1_ts, tp_ts FROM stops")
def stop_band_labels(spark, sf_dir):
    return _stops(spark, sf_dir).select("symbol", "ts", "side", "outcome", "outcome_ts", "r1_ts", "tp_ts")


@query("preempted_while_busy", f"""WITH RECURSIVE {STOPS}, o AS MATERIALIZED (SELECT *, greatest(ts + {4 * HOUR}, CASE WHEN outcome = 'win' THEN tp_ts END) AS busy, row_number() OVER (PARTITION BY symbol ORDER BY ts, side) AS i FROM stops),
s AS (SELECT o.*, false AS preempted, busy AS free FROM o WHERE i = 1 UNION ALL
      SELECT o.*, o.ts < s.free, CASE WHEN o.ts < s.free THEN s.free ELSE o.busy END FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1)
SELECT symbol, ts, side, CASE WHEN preempted THEN 'timeout' ELSE outcome END AS outcome, CAST(CASE WHEN preempted THEN ts ELSE outcome_ts END AS BIGINT) AS outcome_ts, preempted FROM s""")
def preempted_while_busy(spark, sf_dir):
    return labeling.preempted_while_busy(_stops(spark, sf_dir), quick_hours=4).select("symbol", "ts", "side", "outcome", "outcome_ts", "preempted")


@query("weighted_interval", f"""WITH RECURSIVE {_labels_sql('ticks', 48, 3.0, False)}, o AS MATERIALIZED (SELECT symbol, ts, side, outcome_ts, (1 + (ts // {HOUR}) % 5)::DOUBLE AS w, row_number() OVER (PARTITION BY symbol ORDER BY outcome_ts, ts, side) AS i FROM lab),
p AS MATERIALIZED (SELECT a.symbol, a.i, a.w, (SELECT count(*) FROM o b WHERE b.symbol = a.symbol AND b.i < a.i AND b.outcome_ts <= a.ts) AS prior FROM o a),
d AS (SELECT symbol, 0::BIGINT AS i, [0.0::DOUBLE] AS dp FROM (SELECT DISTINCT symbol FROM o) UNION ALL
      SELECT p.symbol, p.i, list_append(d.dp, greatest(d.dp[p.i], p.w + d.dp[p.prior + 1])) FROM d JOIN p ON p.symbol = d.symbol AND p.i = d.i + 1),
e AS MATERIALIZED (SELECT symbol, max(i) AS i, arg_max(dp, i) AS dp FROM d GROUP BY symbol),
t AS MATERIALIZED (SELECT p.symbol, p.i, p.prior, p.w + e.dp[p.prior + 1] > e.dp[p.i] AS taken FROM p JOIN e ON p.symbol = e.symbol),
b AS (SELECT symbol, i FROM e UNION ALL SELECT t.symbol, CASE WHEN taken THEN prior ELSE t.i - 1 END FROM b JOIN t ON t.symbol = b.symbol AND t.i = b.i)
SELECT o.symbol, o.ts, o.side, {r('o.w', 'w')} FROM b JOIN t ON t.symbol = b.symbol AND t.i = b.i AND taken JOIN o ON o.symbol = t.symbol AND o.i = t.i""")
def weighted_interval(spark, sf_dir):
    ev = _labelled(spark, sf_dir).withColumn("w", (1 + F.expr(f"ts div {HOUR}") % 5).cast("double"))
    return sequential.best_schedule(ev, "w").select("symbol", "ts", "side", "w")


@query("capped_schedule", f"""WITH RECURSIVE {_labels_sql('ticks', 48, 3.0, False)}, o AS MATERIALIZED (SELECT symbol, ts, side, outcome_ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, side) AS i FROM lab),
s AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS ts, '' AS side, false AS kept, CAST([] AS STRUCT(e BIGINT, s VARCHAR)[]) AS held FROM (SELECT DISTINCT symbol FROM o) UNION ALL
      SELECT symbol, i, ts, side, kept, CASE WHEN kept THEN list_append(still, {{'e': outcome_ts, 's': side}}) ELSE still END FROM (
        SELECT *, len(still) < 3 AND len(list_filter(still, lambda x: x.s = side)) < 2 AS kept FROM (
          SELECT o.symbol, o.i, o.ts, o.side, o.outcome_ts, list_filter(s.held, lambda x: x.e > o.ts) AS still FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1)))
SELECT symbol, ts, side FROM s WHERE kept""")
def capped_schedule(spark, sf_dir):
    return sequential.capped(_labelled(spark, sf_dir), 3, 2).select("symbol", "ts", "side")


@query("least_gap", f"""WITH RECURSIVE {BARS}, n AS (SELECT a.symbol, a.ts, min(b.ts) AS next FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts >= a.ts + {6 * HOUR} GROUP BY 1, 2),
g AS (SELECT symbol, ts, next FROM n WHERE ts = (SELECT min(ts) FROM bars WHERE bars.symbol = n.symbol) UNION ALL SELECT n.symbol, n.ts, n.next FROM g JOIN n ON n.symbol = g.symbol AND n.ts = g.next)
SELECT symbol, CAST(min(next - ts) AS BIGINT) AS min_gap FROM g GROUP BY symbol""")
def least_gap(spark, sf_dir):
    return evaluate.least_gap(sequential.spaced(bars(spark, sf_dir), 6 * HOUR, ("symbol",)), ["symbol"])


# --- mining -------------------------------------------------------------------------------------------------------
LITS = ("q", "d", "t", "ln")
MINED = "base AS (SELECT sum(is_win) / sum(is_win + is_loss)::DOUBLE AS base_p, sum(is_win + is_loss) / count(*)::DOUBLE AS base_resolve FROM ev)"


def _rules_sql(keys: str, source: str) -> str:
    lo, hi = wilson_sql("wins", "support_n")
    return f"""{OUT}, {MINED}, lits AS ({source}), mo AS (SELECT {keys}, ym, sum(is_win) AS wins, sum(is_loss) AS losses, sum(is_to) AS timeouts FROM lits GROUP BY ALL),
ru AS (SELECT {keys}, sum(wins) AS wins, sum(losses) AS losses, sum(timeouts) AS timeouts, sum(wins + losses) AS support_n, count(*) AS unique_months, count(*) FILTER (coalesce(wins / nullif(wins + losses, 0)::DOUBLE > base_p, false)) AS months_with_lift, any_value(base_p) AS base_p, any_value(base_resolve) AS base_resolve FROM mo, base GROUP BY ALL),
rules AS (SELECT *, wins / support_n::DOUBLE AS precision, {lo} AS precision_lcb, {hi} AS precision_ucb, (wins + losses) / (wins + losses + timeouts)::DOUBLE AS resolve_frac, timeouts / (wins + losses + timeouts)::DOUBLE AS timeout_rate FROM ru
  WHERE support_n >= 24 AND wins >= 4 AND unique_months >= 4 AND (wins + losses) / support_n::DOUBLE >= 0.25 AND timeouts / support_n::DOUBLE <= 2.0)"""


ONE = " UNION ALL ".join(f"SELECT '{c}' AS lit, {c} AS val, ym, is_win, is_loss, is_to FROM ev" for c in LITS)
TWO = " UNION ALL ".join(f"SELECT '{a}' AS lit1, {a} AS val1, '{b}' AS lit2, {b} AS val2, ym, is_win, is_loss, is_to FROM ev" for a in sorted(LITS) for b in sorted(LITS) if a < b)
RULE_COLUMNS = "CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(timeouts AS BIGINT) AS timeouts, CAST(support_n AS BIGINT) AS support_n, unique_months, months_with_lift"
RULE_RATES = ", ".join(r(c, c) for c in ("precision", "precision_lcb", "precision_ucb", "resolve_frac", "timeout_rate"))
_RULE = ["wins", "losses", "timeouts", "support_n", "unique_months", "months_with_lift", "precision", "precision_lcb", "precision_ucb", "resolve_frac", "timeout_rate"]


def _single(spark, sf_dir) -> DataFrame:
    return mining.mine_single(outcomes(spark, sf_dir), list(LITS), max_timeout=2.0)


@query("mine_rules_1d", f"WITH {_rules_sql('lit, val', ONE)} SELECT lit || '==' || val AS rule_id, {RULE_COLUMNS}, {RULE_RATES} FROM rules")
def mine_rules_1d(spark, sf_dir):
    return _single(spark, sf_dir).select("rule_id", *_RULE)


@query("mine_rules_2d", f"WITH {_rules_sql('lit1, val1, lit2, val2', TWO)} SELECT lit1 || '==' || val1 || ' & ' || lit2 || '==' || val2 AS rule_id, {RULE_COLUMNS}, {RULE_RATES} FROM rules")
def mine_rules_2d(spark, sf_dir):
    return mining.mine_pairs(outcomes(spark, sf_dir), list(LITS), max_timeout=2.0).select("rule_id", *_RULE)


@query("monotone_bins", f"""WITH {OUT}, l AS ({ONE}), g AS (SELECT lit, val, avg(is_win::DOUBLE) AS p FROM l GROUP BY 1, 2), d AS (SELECT lit, p - lag(p) OVER (PARTITION BY lit ORDER BY val) AS d FROM g)
SELECT lit, coalesce(bool_and(d >= -0.001), true) AS rises, coalesce(bool_and(d <= 0.001), true) AS falls, coalesce(bool_and(d >= -0.001), true) OR coalesce(bool_and(d <= 0.001), true) AS monotone FROM d GROUP BY lit""")
def monotone_bins(spark, sf_dir):
    ev = outcomes(spark, sf_dir)
    return reduce(DataFrame.unionByName, [evaluate.monotone(ev, c, "is_win", 0.001).withColumn("lit", F.lit(c)) for c in LITS])


@query("promote_top_k", f"WITH {_rules_sql('lit, val', ONE)} SELECT lit || '==' || val AS rule_id, {r('precision_lcb', 'precision_lcb')} FROM rules WHERE precision_lcb >= 0.4 ORDER BY precision_lcb DESC, support_n DESC, lit || '==' || val LIMIT 5")
def promote_top_k(spark, sf_dir):
    return mining.promoted(_single(spark, sf_dir).withColumn("base_p", F.lit(0.4)).withColumn("base_resolve", F.lit(0.0)), top_k=5, max_timeout=2.0).select("rule_id", "precision_lcb")


@query("losers_top_k", f"WITH {_rules_sql('lit, val', ONE)} SELECT lit || '==' || val AS rule_id, {r('precision_ucb', 'precision_ucb')} FROM rules WHERE resolve_frac >= 0.4 AND unique_months >= 2 AND precision_ucb <= 0.55 ORDER BY precision_ucb, support_n DESC, lit || '==' || val LIMIT 5")
def losers_top_k(spark, sf_dir):
    return mining.losers(_single(spark, sf_dir), top_k=5, max_ucb=0.55).select("rule_id", "precision_ucb")


@query("bh_fdr", f"""WITH {_rules_sql('lit, val', ONE)}, p AS (SELECT lit || '==' || val AS rule_id, 1 - least(1.0, precision_lcb + 0.48) AS pval FROM rules),
k AS (SELECT *, row_number() OVER (ORDER BY pval, rule_id) AS k, count(*) OVER () AS m FROM p)
SELECT rule_id, {r('pval', 'pval')}, {r('least(1.0, min(pval * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'qval')}, CAST(k <= coalesce((SELECT max(k) FROM k WHERE pval <= k * 0.1 / m), 0) AS INTEGER) AS rejected FROM k""")
def bh_fdr(spark, sf_dir):
    out = mining.false_discovery(_single(spark, sf_dir), 1 - F.least(F.lit(1.0), F.col("precision_lcb") + 0.48), 0.1)
    return out.select("rule_id", "pval", "qval", "rejected")


@query("binomial_fdr", f"""WITH {_rules_sql('lit, val', ONE)}, p AS (SELECT lit || '==' || val AS rule_id, CAST(wins AS BIGINT) AS k, CAST(support_n AS BIGINT) AS n, base_p FROM rules),
q AS (SELECT rule_id, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(base_p) + (n - i) * ln(1 - base_p))) AS pval FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM p) GROUP BY rule_id),
k AS (SELECT *, row_number() OVER (ORDER BY pval, rule_id) AS k, count(*) OVER () AS m FROM q)
SELECT rule_id, {r('pval', 'pval')}, CAST(k <= coalesce((SELECT max(k) FROM k WHERE pval <= k * 0.1 / m), 0) AS INTEGER) AS rejected FROM k""")
def binomial_fdr(spark, sf_dir):
    p = stats.binomial_tail(F.col("wins"), F.col("support_n"), F.col("base_p"))
    return mining.false_discovery(_single(spark, sf_dir), p, 0.1).select("rule_id", "pval", "rejected")


@query("wilson_bounds", f"WITH {OUT}, g AS (SELECT ym, sum(is_win) AS k, count(*) AS n FROM ev GROUP BY ym) SELECT ym, {r(wilson_sql('k', 'n')[0], 'lcb')}, {r(wilson_sql('k', 'n')[1], 'ucb')} FROM g")
def wilson_bounds(spark, sf_dir):
    g = outcomes(spark, sf_dir).groupBy("ym").agg(F.sum("is_win").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("ym", lo.alias("lcb"), hi.alias("ucb"))


@query("rule_match_first", f"WITH {OUT}, m AS (SELECT CASE WHEN q >= 4 AND d = 2 THEN 'r1' WHEN t < 2 AND ln <= 2 THEN 'r2' WHEN q > 1 THEN 'r3' END AS rule_id, is_win FROM ev) SELECT rule_id, count(*) AS n, CAST(sum(is_win) AS BIGINT) AS wins FROM m GROUP BY rule_id")
def rule_match_first(spark, sf_dir):
    rules = [("r1", [("q", ">=", 4), ("d", "==", 2)]), ("r2", [("t", "<", 2), ("ln", "<=", 2)]), ("r3", [("q", ">", 1)])]
    m = outcomes(spark, sf_dir).select(mining.first_match(rules).alias("rule_id"), "is_win")
    return m.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("is_win").alias("wins"))


@query("loser_mask", f"WITH {OUT} SELECT ym, count(*) FILTER ((q = 0 AND d = 1) OR ln = 7) AS masked FROM ev GROUP BY ym")
def loser_mask(spark, sf_dir):
    ev = outcomes(spark, sf_dir)
    return ev.groupBy("ym").agg(F.count_if(mining.any_literal([[("q", 0), ("d", 1)], [("ln", 7)], [("gone", 1)]], ev.columns)).alias("masked"))


# --- joins --------------------------------------------------------------------------------------------------------
@query("label_join_full_key", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT c.symbol, c.ts, c.side, outcome FROM c LEFT JOIN (SELECT * FROM lab WHERE side = 'long') l ON c.symbol = l.symbol AND c.ts = l.ts AND c.side = l.side")
def label_join_full_key(spark, sf_dir):
    ev = _labelled(spark, sf_dir).where("side = 'long'").select("symbol", "ts", "side", "outcome")
    return _cands(spark, sf_dir).select("symbol", "ts", "side").join(ev, ["symbol", "ts", "side"], "left")


@query("label_join_five_keys", f"""WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT c.symbol, c.ts, c.side, outcome
FROM c LEFT JOIN lab l ON c.symbol = l.symbol AND c.ts = l.ts AND c.side = l.side AND round(c.entry, 8) = l.entry AND round(c.risk_dist, 8) = l.risk_dist""")
def label_join_five_keys(spark, sf_dir):
    keys = ["symbol", "ts", "side", "entry", "level", "risk_dist"]
    return _cands(spark, sf_dir).select(*keys).join(_labelled(spark, sf_dir).select(*keys, "outcome"), keys, "left").select("symbol", "ts", "side", "outcome")


@query("label_join_ts_fanout", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT c.symbol, c.ts, c.side, l.side AS label_side, outcome FROM c JOIN lab l ON c.symbol = l.symbol AND c.ts = l.ts")
def label_join_ts_fanout(spark, sf_dir):
    ev = _labelled(spark, sf_dir).select("symbol", "ts", F.col("side").alias("label_side"), "outcome")
    return _cands(spark, sf_dir).select("symbol", "ts", "side").join(ev, ["symbol", "ts"])


@query("train_semi_join", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT symbol, ts, side, outcome FROM lab WHERE EXISTS (SELECT 1 FROM c WHERE c.symbol = lab.symbol AND c.ts = lab.ts AND c.side = lab.side AND bar_idx < 300)")
def train_semi_join(spark, sf_dir):
    train = _cands(spark, sf_dir).where("bar_idx < 300").select("symbol", "ts", "side")
    return _labelled(spark, sf_dir).select("symbol", "ts", "side", "outcome").join(train, ["symbol", "ts", "side"], "left_semi")


@query("attach_month", f"WITH {_labels_sql('ticks', 48, 3.0, False)} SELECT strftime(make_timestamp(ts * 1000), '%Y-%m') AS ym, count(*) AS n FROM lab GROUP BY 1")
def attach_month(spark, sf_dir):
    months = _cands(spark, sf_dir).select("symbol", "ts", stats.month_of(F.col("ts")).alias("ym")).dropDuplicates(["symbol", "ts"])
    return _labelled(spark, sf_dir).join(months, ["symbol", "ts"], "left").groupBy("ym").agg(F.count("*").alias("n"))


@query("parity_signal", f"WITH {BARS}, a AS (SELECT symbol, ts, close > open AS f FROM bars WHERE n_ticks > 1), b AS (SELECT symbol, ts, close >= open AS f FROM bars WHERE n_ticks > 2) SELECT count(*) AS rows, count(*) FILTER (coalesce(a.f, false) <> coalesce(b.f, false)) AS mismatches FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def parity_signal(spark, sf_dir):
    b = bars(spark, sf_dir)
    return evaluate.same_signals(b.where("n_ticks > 1").withColumn("f", F.expr("close > open")), b.where("n_ticks > 2").withColumn("f", F.expr("close >= open")), "f", ["symbol", "ts"])


@query("parity_trade", f"WITH {BARS}, a AS (SELECT symbol, ts, CASE WHEN close > open THEN 'tp' ELSE 'sl' END AS e, close AS rr FROM bars WHERE n_ticks > 1), b AS (SELECT symbol, ts, CASE WHEN close >= open THEN 'tp' ELSE 'sl' END AS e, open AS rr FROM bars WHERE n_ticks > 2) SELECT count(*) FILTER (a.e IS DISTINCT FROM b.e) AS exit_mismatches, count(*) FILTER (abs(a.rr - b.rr) > 1.005) AS r_mismatches FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def parity_trade(spark, sf_dir):
    b = bars(spark, sf_dir)
    side = lambda df, test, rr: df.withColumns({"exit_type": F.when(F.expr(test), "tp").otherwise("sl"), "R": F.col(rr)})
    return evaluate.same_trades(side(b.where("n_ticks > 1"), "close > open", "close"), side(b.where("n_ticks > 2"), "close >= open", "open"), ["symbol", "ts"], 1.005)


@query("set_diff", f"WITH {BARS}, a AS (SELECT symbol, ts FROM bars WHERE close > open), b AS (SELECT symbol, ts FROM bars WHERE n_ticks > 2) SELECT *, 'a' AS only_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'b' AS only_in FROM (FROM b EXCEPT FROM a)")
def set_diff(spark, sf_dir):
    b = bars(spark, sf_dir)
    return evaluate.set_difference(b.where("close > open"), b.where("n_ticks > 2"), ["symbol", "ts"])


# --- reports and metrics ------------------------------------------------------------------------------------------
@query("event_summary_by_month", f"""WITH {OUT} SELECT ym, count(*) AS n, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(is_loss) AS BIGINT) AS losses, CAST(sum(is_to) AS BIGINT) AS timeouts, round(sum(is_win + is_loss) / count(*)::DOUBLE, 3) AS resolved_rate,
round(sum(is_to) / count(*)::DOUBLE, 3) AS timeout_rate, round(sum(is_win) / nullif(sum(is_win + is_loss), 0)::DOUBLE, 3) AS ppv FROM ev GROUP BY ym""")
def event_summary_by_month(spark, sf_dir):
    return evaluate.by_month(outcomes(spark, sf_dir))


ROLL = "OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("daily_rolling_tripwire", f"""WITH {OUT}, g AS (SELECT day, sum(is_win) AS w, sum(is_loss) AS l, sum(is_to) AS t FROM ev GROUP BY day), k AS (SELECT day, w, l, t, sum(w) {ROLL} AS rw, sum(l) {ROLL} AS rl, sum(t) {ROLL} AS rt FROM g),
b AS (SELECT *, {wilson_sql('rw', '(rw + rl)')[0]} AS lcb, rt / (rw + rl + rt)::DOUBLE AS timeout_rate FROM k)
SELECT CAST(day AS VARCHAR) AS day, CAST(rw AS BIGINT) AS rw, CAST(rl AS BIGINT) AS rl, CAST(rt AS BIGINT) AS rt, {r('lcb', 'lcb')}, {r('timeout_rate', 'timeout_rate')}, CAST(lcb < 0.5 AS INTEGER) AS breach_lcb, CAST(timeout_rate > 0.6 AS INTEGER) AS breach_timeout FROM b""")
def daily_rolling_tripwire(spark, sf_dir):
    out = evaluate.tripwires(outcomes(spark, sf_dir), "day")
    return out.select(F.col("day").cast("string"), "rw", "rl", "rt", "lcb", "timeout_rate", "breach_lcb", "breach_timeout")


@query("average_precision", f"WITH {SCORED}, g AS (SELECT p, sum(y) AS tp, count(*) AS n FROM sc GROUP BY p), c AS (SELECT tp, sum(tp) OVER (ORDER BY p DESC) AS ctp, sum(n) OVER (ORDER BY p DESC) AS cn FROM g) SELECT {r('sum(tp * ctp / cn::DOUBLE) / sum(tp)', 'average_precision')} FROM c")
def average_precision(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir), "p", "y")


@query("brier", f"WITH {SCORED} SELECT {r('avg((p - y) * (p - y))', 'brier')} FROM sc")
def brier(spark, sf_dir):
    return evaluate.brier(scored(spark, sf_dir), "p", "y")


@query("ece", f"""WITH {SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM sc),
b AS (SELECT len(list_filter(range(1, 10), lambda k: k * n // 10 <= i)) AS bin, p, y FROM o), g AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin) SELECT {r('sum(n * gap) / sum(n)', 'ece')} FROM g""")
def ece(spark, sf_dir):
    return evaluate.calibration_error(scored(spark, sf_dir), "p", "y", 10, "doc_id")


@query("reliability", f"WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r('avg(p)', 'mean_p')}, {r('avg(y)', 'rate')} FROM sc GROUP BY 1")
def reliability(spark, sf_dir):
    return evaluate.reliability(scored(spark, sf_dir), "p", "y")


@query("js_drift", f"""WITH {SCORED}, c AS (SELECT m, CAST(floor(p * 4.999) AS INTEGER) AS b FROM sc), g AS (SELECT m, b, count(*) AS n FROM c GROUP BY ALL), gr AS (SELECT * FROM (SELECT DISTINCT m FROM g), (SELECT DISTINCT b FROM g)),
q AS (SELECT m, b, coalesce(n, 0) / sum(n) OVER (PARTITION BY m)::DOUBLE AS q FROM gr LEFT JOIN g USING (m, b)), j AS (SELECT x.m, y.m AS m2, sum(CASE WHEN x.q > 0 THEN x.q * ln(x.q / ((x.q + y.q) / 2)) ELSE 0 END + CASE WHEN y.q > 0 THEN y.q * ln(y.q / ((x.q + y.q) / 2)) ELSE 0 END) / 2 AS d FROM q x JOIN q y ON x.b = y.b AND x.m < y.m GROUP BY ALL)
SELECT {r('max(sqrt(greatest(d, 0)))', 'max_js')} FROM j""")
def js_drift(spark, sf_dir):
    return evaluate.month_drift(scored(spark, sf_dir).withColumn("b", F.floor(F.col("p") * 4.999).cast("int")), "m", "b")


@query("tau_search", f"""WITH {SCORED}, t AS (SELECT DISTINCT unnest(quantile_cont(p, [x / 200.0 FOR x IN range(201)])) AS tau FROM sc), k AS (SELECT tau, sum(y) AS k, count(*) AS n, count(*) / (SELECT count(*) FROM sc)::DOUBLE AS cov FROM t JOIN sc ON p >= tau GROUP BY tau),
w AS (SELECT tau, k / n::DOUBLE AS ppv, {wilson_sql('k', 'n')[0]} AS lcb, cov FROM k)
SELECT {r('tau', 'tau')}, {r('ppv', 'ppv')}, {r('lcb', 'ppv_lcb')}, {r('cov', 'cov')} FROM w WHERE lcb >= 0.7 OR (cov >= 0.02 AND lcb > 0) ORDER BY CASE WHEN lcb >= 0.7 THEN 0 ELSE 1 END, CASE WHEN lcb >= 0.7 THEN 0 ELSE -lcb END, tau DESC LIMIT 1""")
def tau_search(spark, sf_dir):
    return evaluate.threshold(scored(spark, sf_dir), "p", "y", 0.7, 0.02)


@query("correlation", f"WITH {SCORED} SELECT {r('abs(corr(p, y))', 'mi_score')} FROM sc")
def correlation(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.coalesce(F.abs(F.corr("p", "y")), F.lit(0.0)).alias("mi_score"))


@query("patterns_single", f"WITH {OUT}, l AS ({ONE}), g AS (SELECT lit, val, count(*) AS n, sum(is_win) AS k FROM l WHERE is_win + is_loss = 1 GROUP BY 1, 2), b AS (SELECT avg(is_win) AS p FROM ev WHERE is_win + is_loss = 1) SELECT lit, val, n, CAST(k AS BIGINT) AS k, {r(wilson_sql('k', 'n')[0], 'lcb')}, {r('ln(greatest(1e-6, least(1 - 1e-6, k / n::DOUBLE)) / (1 - greatest(1e-6, least(1 - 1e-6, k / n::DOUBLE)))) - ln(p / (1 - p))', 'delta_logit')} FROM g, b WHERE n >= 20")
def patterns_single(spark, sf_dir):
    done = outcomes(spark, sf_dir).where("is_win + is_loss = 1")
    base = done.agg(F.avg("is_win").alias("p"))
    g = mining.literals(done, list(LITS)).groupBy("lit", "val").agg(F.count("*").alias("n"), F.sum("is_win").alias("k")).where("n >= 20").crossJoin(F.broadcast(base))
    return g.select("lit", "val", "n", "k", stats.wilson(F.col("k"), F.col("n"))[0].alias("lcb"), (stats.logit(F.col("k") / F.col("n")) - stats.logit(F.col("p"))).alias("delta_logit"))


@query("patterns_numeric", f"WITH {OUT.replace('l_linenumber,', 'l_linenumber, l_extendedprice::DOUBLE AS x,', 1)}, dn AS (SELECT * FROM ev WHERE is_win + is_loss = 1), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [k / 9.0 FOR k IN range(10)]))) AS e FROM dn), b AS (SELECT greatest(1, len(list_filter(e, lambda v: v < x))) - 1 AS bin, is_win FROM dn, e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(is_win) AS BIGINT) AS k FROM b GROUP BY bin")
def patterns_numeric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_extendedprice").cast("double").alias("x"), (F.col("l_returnflag") == "A").cast("int").alias("is_win"))
    e = quantiles.exact_quantiles(li, ["x"], [k / 9.0 for k in range(10)]).select(F.array_sort(F.array_distinct("q_x")).alias("e"))
    b = li.crossJoin(F.broadcast(e)).select((F.greatest(F.lit(1), F.size(F.filter("e", lambda v: v < F.col("x")))) - 1).alias("bin"), "is_win")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.sum("is_win").alias("k"))


def _pattern_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of the 30 best single literals with their counts among resolved events; 20 rows at least."""
    done = outcomes(spark, sf_dir).where("is_win + is_loss = 1")
    singles = mining.literals(done, list(LITS)).groupBy("lit", "val").agg(F.count("*").alias("n"), F.sum("is_win").alias("k")).where("n >= 20")
    best = singles.withColumn("lcb", F.round(stats.wilson(F.col("k"), F.col("n"))[0], 9)).orderBy(F.desc("lcb"), F.desc("n"), "lit", "val").limit(30)
    fit = best.groupBy().agg(F.collect_set(F.struct("lit", "val")).alias("fit"))  # 30 at most
    held = F.filter(F.array(*[F.struct(F.lit(c).alias("lit"), F.col(c).alias("val")) for c in sorted(LITS)]), lambda p: F.array_contains("fit", p))
    rows_ = done.crossJoin(F.broadcast(fit)).select("is_win", held.alias("l")).select("is_win", F.expr("explode(flatten(transform(l, (a, i) -> transform(slice(l, i + 2, size(l)), b -> struct(a, b)))))").alias("p"))
    g = rows_.groupBy(F.col("p.a.lit").alias("lit1"), F.col("p.a.val").alias("val1"), F.col("p.b.lit").alias("lit2"), F.col("p.b.val").alias("val2"))
    return g.agg(F.count("*").alias("n"), F.sum("is_win").alias("k")).where("n >= 20")


PAIRS = f"""{OUT}, dn AS (SELECT * FROM ev WHERE is_win + is_loss = 1), one AS ({ONE.replace('FROM ev', 'FROM dn')}), s AS (SELECT lit, val, count(*) AS n, sum(is_win) AS k FROM one GROUP BY 1, 2 HAVING count(*) >= 20),
best AS (SELECT lit, val FROM s ORDER BY round({wilson_sql('k', 'n')[0]}, 9) DESC, n DESC, lit, val LIMIT 30), two AS ({TWO.replace('FROM ev', 'FROM dn')}),
pairs AS (SELECT lit1, val1, lit2, val2, count(*) AS n, CAST(sum(is_win) AS BIGINT) AS k FROM two WHERE (lit1, val1) IN (SELECT (lit, val) FROM best) AND (lit2, val2) IN (SELECT (lit, val) FROM best) GROUP BY ALL HAVING count(*) >= 20)"""


@query("patterns_pairs", f"WITH {PAIRS} SELECT lit1, val1, lit2, val2, n, k, {r(wilson_sql('k', 'n')[0], 'lcb')} FROM pairs")
def patterns_pairs(spark, sf_dir):
    return _pattern_pairs(spark, sf_dir).withColumn("lcb", stats.wilson(F.col("k"), F.col("n"))[0])


@query("patterns_union", f"WITH {PAIRS} SELECT 'single' AS source, lit || '==' || val AS pattern, n, CAST(k AS BIGINT) AS k FROM s UNION ALL SELECT 'pair', lit1 || '==' || val1 || ' & ' || lit2 || '==' || val2, n, k FROM pairs")
def patterns_union(spark, sf_dir):
    done = outcomes(spark, sf_dir).where("is_win + is_loss = 1")
    singles = mining.literals(done, list(LITS)).groupBy("lit", "val").agg(F.count("*").alias("n"), F.sum("is_win").alias("k")).where("n >= 20")
    a = singles.select(F.lit("single").alias("source"), mining.rule_id(("lit", "val")).alias("pattern"), "n", "k")
    b = _pattern_pairs(spark, sf_dir).select(F.lit("pair").alias("source"), mining.rule_id(("lit1", "val1"), ("lit2", "val2")).alias("pattern"), "n", "k")
    return a.unionByName(b)
