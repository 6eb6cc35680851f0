"""Bars derived from the lineitem table, in Spark and in SQL.

A symbol is a return flag and line status (six series) or a part brand (25). The
day's lines are ordered by a single 64-bit key, so open and close are primitive
``min_by``/``max_by`` buffers and the aggregation stays hash based.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.clean import fill_calendar

LINE_KEY = "(l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 1009 + l_suppkey) % 1048576"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order line: symbol, date, price, volume, sequence."""
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.expr(LINE_KEY).alias("seq"),
        "l_linestatus",
        "l_partkey",
    )


def to_bars(lines_df: DataFrame) -> DataFrame:
    return lines_df.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return to_bars(lines(spark, sf))


def brand_bars(spark: SparkSession, sf: str) -> DataFrame:
    """A wider panel: one series per part brand."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = lines(spark, sf).join(part, "l_partkey").withColumn("symbol", F.col("p_brand"))
    return to_bars(rows)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bars on the business calendar with short gaps filled."""
    return fill_calendar(bars(spark, sf))


VALUES = ("open", "high", "low", "close", "volume")

LINES = f"""lines AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_quantity AS volume,
         {LINE_KEY} AS seq, l_linestatus, l_partkey
  FROM lineitem)"""

BARS = f"""{LINES},
bars AS (
  SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(volume) AS volume
  FROM lines GROUP BY symbol, date)"""

_LAST3 = ", ".join(f"last_value({c} IGNORE NULLS) OVER f AS {c}" for c in VALUES)

GRID = f"""{BARS},
wk AS (SELECT * FROM bars WHERE isodow(date) <= 5),
days AS (
  SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM wk GROUP BY symbol),
grid AS (
  SELECT d.symbol, d.date, w.open, w.high, w.low, w.close, w.volume
  FROM days d LEFT JOIN wk w ON d.symbol = w.symbol AND d.date = w.date
  WHERE isodow(d.date) <= 5)"""

PANEL = f"""{GRID},
filled AS (
  SELECT symbol, date, {_LAST3} FROM grid
  WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
panel AS MATERIALIZED (SELECT * FROM filled WHERE close IS NOT NULL)"""
