"""Price panels over the driver's tables: each exists as a DataFrame and as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import pair_series, static_hedge
from ..session import panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of a brand (ticker) and part type (instrument)."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollars"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"), F.col("p_type").alias("id"))
    return line.join(part, line.l_partkey == part.p_partkey)


def _panel(spark: SparkSession, sf_dir: str, name: str, make, *tables: str) -> DataFrame:
    """Panels are written once and read by all queries over the same files."""
    return panel(spark, name, [f"{sf_dir}/{t}.parquet" for t in tables or ("lineitem", "part")], make)


def bars(spark: SparkSession, sf_dir: str, unit: str = "week", by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """by, d, px, volume, dollar_volume."""

    def make() -> DataFrame:
        d = F.to_date(F.date_trunc(unit, "l_shipdate")).alias("d")
        cents = F.sum(F.round(F.col("dollars") * 10000).cast("long"))  # whole numbers add up alike in any order
        sums = trades(spark, sf_dir).groupBy(*by, d).agg(cents.alias("cents"), F.sum("l_quantity").alias("volume"))
        return sums.select(*by, "d", (F.floor(F.col("cents") / (F.col("volume") * 10000) * 1e6 + 0.5) / 1e6).alias("px"), "volume", (F.col("cents") / 10000).alias("dollar_volume"))

    return _panel(spark, sf_dir, f"bars-{unit}-{'-'.join(by)}", make)


def bars_sql(unit: str = "week", by: str = "p_brand AS ticker", name: str = "bars") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (cents), floor(cents / (volume * 10000) * 1e6 + 0.5) / 1e6 AS px, cents / 10000 AS dollar_volume FROM (
  SELECT {by}, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS cents, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))"""


BARS = bars_sql()
DAILY = bars_sql("day")
RETURNS = BARS + ", r AS (SELECT *, round(ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY d)), 9) AS r FROM bars)"
PAIRS = BARS + ", pairs AS (SELECT a.ticker AS t1, b.ticker AS t2, a.d, a.px AS P1, b.px AS P2 FROM bars a JOIN bars b ON a.d = b.d AND a.ticker < b.ticker)"
RESID = PAIRS + """, hedge AS (SELECT t1, t2, round(regr_intercept(P1, P2), 4) AS alpha, round(regr_slope(P1, P2), 8) AS beta FROM pairs GROUP BY ALL),
resid AS (SELECT pairs.*, alpha, beta, round(P1 - alpha - beta * P2, 5) AS resid FROM pairs JOIN hedge USING (t1, t2))"""
Z = RESID + """, zs AS (SELECT *, round(CASE WHEN n >= 26 AND sd > 0 THEN (resid - m) / sd END, 5) AS z FROM (
  SELECT *, avg(resid) OVER w AS m, stddev_pop(resid) OVER w AS sd, count(resid) OVER w AS n FROM resid
  WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS 25 PRECEDING)))"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.expr import logret
    from pyspark.sql import Window

    return bars(spark, sf_dir).withColumn("r", F.round(logret("px", Window.partitionBy("ticker").orderBy("d")), 9))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_series(bars(spark, sf_dir).select("ticker", "d", "px"))


def resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        p = pairs(spark, sf_dir)
        h = static_hedge(p).select("t1", "t2", F.round("alpha", 4).alias("alpha"), F.round("beta", 8).alias("beta"))
        return p.join(h, ["t1", "t2"]).withColumn("resid", F.round(F.col("P1") - F.col("alpha") - F.col("beta") * F.col("P2"), 5))

    return _panel(spark, sf_dir, "resid", make)


def zs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.signals import rolling_z
    from pyspark.sql import Window

    def make() -> DataFrame:
        return resid(spark, sf_dir).withColumn("z", F.round(rolling_z("resid", Window.partitionBy("t1", "t2").orderBy("d"), 26), 5))

    return _panel(spark, sf_dir, "zs", make)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as minute prints: ticker, ts, close, volume; `ingest` tells which of a minute came last."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("close"), F.lit(1).alias("volume"), F.struct("ts", "event_id").alias("ingest"))


TICKS = "ticks AS (SELECT event_type AS ticker, CAST(ts AS TIMESTAMP) AS ts, round(value, 6) AS close, 1 AS volume, event_id FROM events WHERE value > 0)"
#: Every minute of a session, from 09:30 to the close, of every ticker that has a print in it.
GRID = TICKS + """, m AS (SELECT ticker, CAST(ts AS DATE) AS session, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m, arg_max(close, row(ts, event_id)) AS print, 1 AS volume
  FROM ticks WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960 GROUP BY ALL),
mm AS (SELECT ticker, session, CAST(unnest(range(570, 960)) AS INTEGER) AS m FROM (SELECT DISTINCT ticker, session FROM m)),
grid AS (SELECT ticker, session, m - 570 AS minute, last_value(print IGNORE NULLS) OVER (PARTITION BY ticker, session ORDER BY m ROWS UNBOUNDED PRECEDING) AS close,
  coalesce(volume, 0) AS volume, CAST(coalesce(volume, 0) > 0 AS INTEGER) AS traded, print FROM mm LEFT JOIN m USING (ticker, session, m))"""
