"""Filter, gap-fill, repair and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import clean as cl
from marketframe.operators import indicators as ind
from marketframe.operators import metrics as mt
from marketframe.operators import split as sp
from marketframe.functions.windows import series

from . import check
from .bars import BARS, GRID, LINES, PANEL, VALUES, bars, lines, panel
from .indicators import SERIES, over

OHLCV_SPEC = "symbol date:d " + " ".join(f"{c}:8" for c in VALUES)


@check("C1_weekdays", OHLCV_SPEC, f"WITH {BARS}, result AS (SELECT * FROM bars WHERE isodow(date) <= 5)")
def weekdays(spark, sf):
    return cl.weekdays_only(bars(spark, sf))


@check(
    "C2_first_per_day",
    "symbol date:d price:8 volume:6 _dropped:i",
    f"WITH {LINES}, result AS (SELECT symbol, date, arg_min(price, seq) AS price, "
    "arg_min(volume, seq) AS volume, count(*) - 1 AS _dropped FROM lines GROUP BY symbol, date)",
)
def first_per_day(spark, sf):
    rows = lines(spark, sf).select("symbol", "date", "price", "volume", "seq")
    return cl.first_per_day(rows, ["seq"])


@check("C3_business_days", OHLCV_SPEC, f"WITH {GRID}, result AS (SELECT * FROM grid)")
def business_days(spark, sf):
    return cl.business_days(cl.weekdays_only(bars(spark, sf)))


@check("C4_fill_forward_3", OHLCV_SPEC, f"WITH {PANEL}, result AS (SELECT * FROM filled)")
def fill_forward(spark, sf):
    return cl.fill_forward(cl.business_days(cl.weekdays_only(bars(spark, sf))), limit=3)


@check("C5_drop_missing_close", OHLCV_SPEC, f"WITH {PANEL}, result AS (SELECT * FROM panel)")
def drop_missing(spark, sf):
    return panel(spark, sf)


def repaired_sql() -> str:
    """SQL of the bad-tick repair, one chain of CTEs over all columns."""
    xs = ", ".join(f"CASE WHEN {c} > 0 THEN {c} END AS x_{c}" for c in VALUES)
    frame = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    devs = ", ".join(f"ln(x_{c} / median(x_{c}) OVER {frame}) AS d_{c}" for c in VALUES)
    quarts = ", ".join(
        f"quantile_cont(d_{c}, 0.25) AS q1_{c}, quantile_cont(d_{c}, 0.75) AS q3_{c}" for c in VALUES
    )
    keep = ", ".join(
        f"CASE WHEN d_{c} >= q1_{c} - greatest(3 * (q3_{c} - q1_{c}), {2.0 if c == 'volume' else 0.5}) "
        f"AND d_{c} <= q3_{c} + greatest(3 * (q3_{c} - q1_{c}), {2.0 if c == 'volume' else 0.5}) "
        f"THEN {c} END AS {c}"
        for c in VALUES
    )
    down = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}"
        for c in VALUES
    )
    up = ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
        for c in VALUES
    )
    return f"""{PANEL},
xs AS (SELECT *, {xs} FROM panel),
devs AS (SELECT *, {devs} FROM xs),
fences AS (SELECT symbol, {quarts} FROM devs GROUP BY symbol),
kept AS (SELECT d.symbol, d.date, {keep} FROM devs d JOIN fences f ON d.symbol = f.symbol),
down AS (SELECT symbol, date, {down} FROM kept),
repaired AS MATERIALIZED (SELECT symbol, date, {up} FROM down)"""


REPAIRED = repaired_sql()


@check("C6_repair_bad_ticks", OHLCV_SPEC, f"WITH {REPAIRED}, result AS (SELECT * FROM repaired)")
def repair(spark, sf):
    return cl.repair_bad_ticks(panel(spark, sf))


RETURNS = (
    f"close / nullif(lag(close) OVER {SERIES}, 0) - 1 AS Return, "
    f"ln(close / nullif(lag(close) OVER {SERIES}, 0)) AS Log_Return"
)
CLEANED = f"{REPAIRED}, cleaned AS MATERIALIZED (SELECT *, {RETURNS} FROM repaired)"


@check(
    "C7_clean",
    OHLCV_SPEC + " Return:6 Log_Return:6",
    f"WITH {CLEANED}, result AS (SELECT * FROM cleaned)",
)
def clean(spark, sf):
    return cl.clean(bars(spark, sf))


@check(
    "R1_returns",
    "symbol date:d Return:6 Log_Return:6",
    f"WITH {PANEL}, result AS (SELECT symbol, date, {RETURNS} FROM panel)",
)
def returns(spark, sf):
    return cl.add_returns(panel(spark, sf))


@check(
    "Q1_expectations",
    "symbol n_rows:i n_duplicate_dates:i n_weekend_rows:i n_null_close:i first_date:d last_date:d covers_years:i",
    f"""WITH {LINES}, result AS (
  SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS n_duplicate_dates,
         count(*) FILTER (isodow(date) > 5) AS n_weekend_rows,
         count(*) FILTER (price IS NULL) AS n_null_close,
         min(date) AS first_date, max(date) AS last_date,
         year(min(date)) <= 1999 AND year(max(date)) >= 2001 AS covers_years
  FROM lines GROUP BY symbol)""",
)
def expectations(spark, sf):
    rows = lines(spark, sf).select("symbol", "date", F.col("price").alias("close"))
    return cl.data_expectations(rows, 1999, 2001)


@check(
    "Q2_drop_incomplete",
    "symbol date:d close:8 edge:6",
    f"""WITH {PANEL}, result AS (
  SELECT symbol, date, close, ln(close / nullif(lag(close, 21) OVER {SERIES}, 0)) AS edge FROM panel
  QUALIFY edge IS NOT NULL AND close <= 5000)""",
)
def incomplete(spark, sf):
    big = F.when(F.col("close") > 5000, float("inf")).otherwise(F.col("close"))
    edge = F.ln(F.col("close") / F.lag("close", 21).over(series()))
    rows = panel(spark, sf).select("symbol", "date", big.alias("close"), edge.alias("edge"))
    return cl.drop_incomplete(cl.nonfinite_to_null(rows))


@check(
    "flagship",
    "symbol split rows:i mean_bandwidth:4 mean_roc:4 MAE:4 RMSE:4 Directional_Accuracy:4",
    f"""WITH {PANEL},
f AS (
  SELECT symbol, date, close, lag(close) OVER {SERIES} AS naive, lag(close, 2) OVER {SERIES} AS before,
         4 * stddev_samp(close) OVER {over(20)} AS width,
         (close / lag(close, 5) OVER {SERIES} - 1) * 100 AS roc,
         row_number() OVER {SERIES} - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n
  FROM panel),
s AS (
  SELECT *, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train'
                 WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM f),
result AS (
  SELECT symbol, split, count(*) AS rows, avg(width) AS mean_bandwidth, avg(roc) AS mean_roc,
         avg(abs(close - naive)) AS MAE, sqrt(avg((close - naive) * (close - naive))) AS RMSE,
         avg(CASE WHEN sign(close - before) = sign(naive - before) THEN 1.0
                  WHEN before IS NOT NULL THEN 0.0 END) * 100 AS Directional_Accuracy
  FROM s GROUP BY symbol, split)""",
)
def flagship(spark, sf):
    """Clean, indicators, split and the naive baseline's error, one shuffle by symbol."""
    df = ind.add_roc(ind.add_bollinger(panel(spark, sf)), (5,))
    df = df.withColumns(
        {
            "predicted": F.lag("close").over(series()),
            "previous": F.lag("close", 2).over(series()),
            "actual": F.col("close"),
        }
    )
    df = mt.directions(sp.temporal_split(df))
    return df.groupBy("symbol", "split").agg(
        F.count("*").alias("rows"),
        F.avg("BB_Width").alias("mean_bandwidth"),
        F.avg("ROC_5").alias("mean_roc"),
        mt.mae().alias("MAE"),
        mt.rmse().alias("RMSE"),
        (F.avg("hit") * 100).alias("Directional_Accuracy"),
    )
