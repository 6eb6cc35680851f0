"""Lag, rolling, calendar, scale-free, target and window queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marketframe.config import DEFAULTS
from marketframe.functions.windows import with_sql
from marketframe.operators import clean as cl
from marketframe.operators import features as ft
from marketframe.operators import indicators as ind

from . import check
from .bars import PANEL, panel
from .cleaning import RETURNS
from .indicators import (
    BOLLINGER,
    CANDLES,
    EMA,
    EWM,
    LOGRET,
    MACD,
    PRICE_SMA,
    ROC,
    RSI_SQL,
    SERIES,
    SMA,
    VWAP,
    _hi,
    _k,
    _lo,
    over,
    per_row,
    spec,
)

LAGS, WINDOWS = DEFAULTS.lags, DEFAULTS.windows

LAG_COLS = {f"Close_lag_{k}": f"lag(close, {k}) OVER {SERIES}" for k in LAGS}


@check("F1_lags", spec(LAG_COLS, 8), per_row(LAG_COLS))
def lags(spark, sf):
    return ft.add_lags(panel(spark, sf))


ROLLING = {}
for _n in WINDOWS:
    ROLLING[f"Close_roll_mean_{_n}"] = f"avg(close) OVER {over(_n)}"
    ROLLING[f"Close_roll_std_{_n}"] = f"stddev_samp(close) OVER {over(_n)}"
    ROLLING[f"Close_roll_min_{_n}"] = f"min(close) OVER {over(_n)}"
    ROLLING[f"Close_roll_max_{_n}"] = f"max(close) OVER {over(_n)}"


def rolling_spec() -> str:
    return "symbol date:d " + " ".join(
        f"{c}:{8 if '_min_' in c or '_max_' in c else 6}" for c in ROLLING
    )


@check("F2_rolling_stats", rolling_spec(), per_row(ROLLING))
def rolling(spark, sf):
    return ft.add_rolling_stats(panel(spark, sf))


_last = "last_day(date)"
BUSINESS_END = f"date = {_last} - CAST(greatest(isodow({_last}) - 5, 0) AS INTEGER)"
_first = "CAST(date_trunc('month', date) AS DATE)"
BUSINESS_START = (
    f"date = {_first} + CAST(CASE WHEN isodow({_first}) > 5 THEN 8 - isodow({_first}) ELSE 0 END AS INTEGER)"
)


def calendar_sql(mode: str) -> dict[str, str]:
    end = BUSINESS_END if mode == "business" else f"date = {_last}"
    start = BUSINESS_START if mode == "business" else f"date = {_first}"
    return {
        "DayOfWeek": "isodow(date) - 1",
        "Month": "month(date)",
        "Quarter": "quarter(date)",
        "IsMonthEnd": f"CAST({end} AS INTEGER)",
        "IsMonthStart": f"CAST({start} AS INTEGER)",
        "IsQtrEnd": f"CAST(({end}) AND month(date) % 3 = 0 AS INTEGER)",
        "WeekOfYear": "weekofyear(date)",
        "DayOfYear": "dayofyear(date)",
        "DayOfWeek_sin": f"sin({2 * math.pi}::DOUBLE * (isodow(date) - 1) / 5)",
        "DayOfWeek_cos": f"cos({2 * math.pi}::DOUBLE * (isodow(date) - 1) / 5)",
        "Month_sin": f"sin({2 * math.pi}::DOUBLE * month(date) / 12)",
        "Month_cos": f"cos({2 * math.pi}::DOUBLE * month(date) / 12)",
    }


CALENDAR = calendar_sql("business")
FIELDS = ("DayOfWeek", "Month", "Quarter", "WeekOfYear", "DayOfYear")
FLAGS = ("IsMonthEnd", "IsMonthStart", "IsQtrEnd")
CYCLES = ("DayOfWeek_sin", "DayOfWeek_cos", "Month_sin", "Month_cos")


@check(
    "F3_calendar_fields",
    "symbol date:d " + " ".join(f"{c}:i" for c in FIELDS),
    per_row({c: CALENDAR[c] for c in FIELDS}),
)
def calendar_fields(spark, sf):
    return ft.add_calendar(panel(spark, sf))


for _mode in ("business", "calendar"):

    @check(
        f"F4_month_flags_{_mode}",
        "symbol date:d " + " ".join(f"{c}:i" for c in FLAGS),
        per_row({c: calendar_sql(_mode)[c] for c in FLAGS}),
    )
    def month_flags(spark, sf, mode=_mode):
        return with_sql(panel(spark, sf), ft.month_flags("date", mode))


@check("F5_cycles", spec(CYCLES), per_row({c: CALENDAR[c] for c in CYCLES}))
def cycles(spark, sf):
    return ft.add_calendar(panel(spark, sf))


CUMULATIVE = {f"LogRet_{k}d": f"ln(close / nullif(lag(close, {k}) OVER {SERIES}, 0))" for k in LAGS}


@check("F6_cumulative_returns", spec(CUMULATIVE), per_row(CUMULATIVE))
def cumulative(spark, sf):
    return ft.add_cumulative_returns(panel(spark, sf))


LAGGED = {
    f"Log_Return_lag_{k}": f"ln(lag(close, {k}) OVER {SERIES} / nullif(lag(close, {k + 1}) OVER {SERIES}, 0))"
    for k in (1, 2, 3, 5)
}


@check("F7_lagged_returns", spec(LAGGED), per_row(LAGGED))
def lagged(spark, sf):
    return ft.add_lagged_returns(cl.add_returns(panel(spark, sf)))


ZSCORES = {}
for _n in WINDOWS:
    _two = f"count(*) OVER {over(_n)} >= 2"
    ZSCORES[f"Close_zscore_{_n}"] = (
        f"(close - avg(close) OVER {over(_n)}) / nullif(stddev_samp(close) OVER {over(_n)}, 0)"
    )
    ZSCORES[f"Close_to_max_{_n}"] = f"CASE WHEN {_two} THEN close / nullif(max(close) OVER {over(_n)}, 0) - 1 END"
    ZSCORES[f"Close_to_min_{_n}"] = f"CASE WHEN {_two} THEN close / nullif(min(close) OVER {over(_n)}, 0) - 1 END"


@check("F8_zscores", spec(ZSCORES), per_row(ZSCORES))
def zscores(spark, sf):
    return ft.add_zscores(panel(spark, sf))


NORMALISED = {
    "MACD_norm": "MACD / close",
    "MACD_Signal_norm": "MACD_Signal / close",
    "MACD_Hist_norm": "MACD_Hist / close",
    "BB_Width_norm": "BB_Width / nullif(BB_Mid, 0)",
    "HL_range_pct": "(high - low) / close",
    "CO_pct": "(close - open) / nullif(open, 0)",
    "Shadow_Upper_pct": "(high - greatest(close, open)) / close",
    "Shadow_Lower_pct": "(least(close, open) - low) / close",
    "OBV_trend": "(OBV - OBV_EMA) / nullif(Volume_SMA_20, 0)",
}

# All features of the full set in one SQL chain: plain frames, recurrences, then
# the columns that need a second step.
PLAIN = {
    "Return": f"close / nullif(lag(close) OVER {SERIES}, 0) - 1",
    "Log_Return": f"ln(close / nullif(lag(close) OVER {SERIES}, 0))",
    **SMA,
    **PRICE_SMA,
    **BOLLINGER,
    "Stoch_K": _k,
    "Williams_R": f"-100 * ({_hi} - close) / nullif({_hi} - {_lo}, 0)",
    **ROC,
    "VWAP": VWAP,
    "Volume_SMA_20": f"avg(volume) OVER {over(20)}",
    "Volume_ratio": f"volume / nullif(avg(volume) OVER {over(20)}, 0)",
    **CANDLES,
    **LAG_COLS,
    **ROLLING,
    **CALENDAR,
    **CUMULATIVE,
    **LAGGED,
    **ZSCORES,
}
RECURSIVE = {
    **{k: f"ewm.{v}" for k, v in EMA.items()},
    **MACD,
    "RSI": RSI_SQL.replace("rn >", "ewm.rn >"),
    "ATR": "ewm.atr",
    "ATR_ratio": "ewm.atr / nullif(p.close, 0)",
    "OBV": "n.obv",
    "OBV_EMA": "ewm.obv_ema",
}
SECOND = {
    "Stoch_D": f"avg(Stoch_K) OVER {over(3)}",
    "HV_21": f"stddev_samp(Log_Return) OVER {over(21)} * sqrt(252)",
    "HV_63": f"stddev_samp(Log_Return) OVER {over(63)} * sqrt(252)",
    **NORMALISED,
}
ALL_FEATURES = [*PLAIN, *RECURSIVE, *SECOND]
INTEGERS = (*FIELDS, *FLAGS)


def _cols(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


FEATURES = f"""{EWM},
plain AS (SELECT *, {_cols(PLAIN)} FROM panel),
joined AS (
  SELECT p.*, {_cols(RECURSIVE)} FROM plain p
  JOIN ewm USING (symbol, date) JOIN numbered n ON n.symbol = p.symbol AND n.date = p.date),
wide AS (SELECT *, {_cols(SECOND)} FROM joined)"""
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ALL_FEATURES)
FEATURE_SET = f"{FEATURES}, featured AS (SELECT * FROM wide WHERE {COMPLETE})"
PRICES = {"close", *CANDLES, *LAG_COLS, *[c for c in ROLLING if "_min_" in c or "_max_" in c]}
FEATURE_SPEC = "symbol date:d " + " ".join(
    f"{c}:i" if c in INTEGERS else f"{c}:{8 if c in PRICES else 6}" for c in ["close", *ALL_FEATURES]
)


@check(
    "F9_normalised",
    spec(NORMALISED),
    f"{FEATURES}, result AS (SELECT * FROM wide)",
)
def normalised(spark, sf):
    df = ind.add_volume_group(ind.add_bollinger(ind.add_macd(panel(spark, sf))))
    return ft.add_normalised(df)


# The model inputs in their order.
MODEL_INPUTS = """
Return Log_Return Price_SMA_5_ratio Price_SMA_10_ratio Price_SMA_20_ratio Price_SMA_50_ratio
Price_SMA_200_ratio RSI BB_PctB ATR_ratio Stoch_K Stoch_D Williams_R ROC_5 ROC_10 ROC_21 HV_21
HV_63 Volume_ratio DayOfWeek IsMonthEnd IsMonthStart IsQtrEnd DayOfWeek_sin DayOfWeek_cos
Month_sin Month_cos LogRet_1d LogRet_2d LogRet_3d LogRet_5d LogRet_10d LogRet_21d
Log_Return_lag_1 Log_Return_lag_2 Log_Return_lag_3 Log_Return_lag_5 Close_zscore_5
Close_to_max_5 Close_to_min_5 Close_zscore_10 Close_to_max_10 Close_to_min_10 Close_zscore_20
Close_to_max_20 Close_to_min_20 Close_zscore_50 Close_to_max_50 Close_to_min_50
Close_zscore_200 Close_to_max_200 Close_to_min_200 MACD_norm MACD_Signal_norm MACD_Hist_norm
BB_Width_norm HL_range_pct CO_pct Shadow_Upper_pct Shadow_Lower_pct OBV_trend
""".split()


@check(
    "F10_model_columns",
    "position:i name rows:i",
    f"{FEATURE_SET}, names(position, name) AS (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(MODEL_INPUTS))
    + "), result AS (SELECT position, name, (SELECT count(*) FROM featured) AS rows FROM names)",
)
def model_columns(spark, sf):
    """The model-input names, read off the schema, with their position and the
    number of complete rows behind them."""
    frame = ft.make_model_frame(panel(spark, sf))
    names = ft.model_feature_columns(frame)
    found = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return frame.agg(F.count("*").alias("rows")).select(found.alias("f"), "rows").select("f.*", "rows")


def feature_set(spark, sf):
    return ft.build_feature_set(panel(spark, sf))


check("F12_feature_set", FEATURE_SPEC, f"{FEATURE_SET}, result AS (SELECT * FROM featured)")(feature_set)


@check(
    "F13_model_frame",
    FEATURE_SPEC,
    f"{FEATURE_SET}, result AS (SELECT * FROM featured)",
)
def model_frame(spark, sf):
    return ft.make_model_frame(panel(spark, sf).withColumn("source", F.lit("lines")))


TARGET_SQL = f"ln(lead(close) OVER {SERIES} / close)"


@check("F14_target", spec(["Target_LogRet"]), per_row({"Target_LogRet": TARGET_SQL}))
def target(spark, sf):
    return ft.add_target(panel(spark, sf))


@check(
    "F15_next_prices",
    spec(["predicted"]),
    f"WITH {LOGRET}, shifted AS (SELECT symbol, lead(date) OVER {SERIES} AS date, close * exp(lr / 10) AS predicted "
    "FROM lr), result AS (SELECT * FROM shifted WHERE date IS NOT NULL)",
)
def next_prices(spark, sf):
    df = cl.add_returns(panel(spark, sf)).withColumn("r", F.col("Log_Return") / 10)
    return ft.next_prices(df)


# Windows of 60 rows, each told by its ends, its sums and a sum weighted by position.
WINDOW_SPEC = "symbol date:d oldest:8 newest:8 close_sum:5 volume_sum:3 weighted:4"


def window_digest(df):
    """The digest of column ``window``, rows of (close, volume)."""
    total = lambda value: F.aggregate("window", F.lit(0.0), value)
    placed = F.transform("window", lambda x, i: x[0] * (i + 1))
    return df.withColumns({
        "oldest": F.col("window")[0][0],
        "newest": F.col("window")[59][0],
        "close_sum": total(lambda s, x: s + x[0]),
        "volume_sum": total(lambda s, x: s + x[1]),
        "weighted": F.aggregate(placed, F.lit(0.0), lambda s, x: s + x),
    })


DIGEST = (
    "c[1] AS oldest, c[60] AS newest, list_sum(c) AS close_sum, list_sum(v) AS volume_sum, "
    "list_sum(list_transform(c, lambda x, i: x * i)) AS weighted"
)


@check(
    "F16_lookback_windows",
    f"{WINDOW_SPEC} y:6",
    f"""WITH {PANEL},
w AS (SELECT symbol, date, 100 * {TARGET_SQL} AS y,
             list(close) OVER {over(60)} AS c, list(volume) OVER {over(60)} AS v FROM panel),
result AS (SELECT symbol, date, y, {DIGEST} FROM w WHERE len(c) = 60)""",
)
def lookback(spark, sf):
    return window_digest(ft.lookback_windows(ft.add_target(panel(spark, sf)), ["close", "volume"], 60))


@check(
    "F17_sequences",
    f"{WINDOW_SPEC} y1:8 y2:8",
    f"""WITH {PANEL},
w AS (SELECT symbol, date, close AS y1, lead(close) OVER {SERIES} AS y2,
             list(close) OVER f AS c, list(volume) OVER f AS v
      FROM panel WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
result AS (SELECT symbol, date, y1, y2, {DIGEST} FROM w WHERE len(c) = 60 AND y2 IS NOT NULL)""",
)
def sequences(spark, sf):
    w = window_digest(ft.supervised_sequences(panel(spark, sf), ["close", "volume"], 60, 2))
    return w.withColumns({"y1": F.col("y")[0], "y2": F.col("y")[1]})


@check(
    "F18_clip",
    spec(["Log_Return", "Return"]),
    f"WITH {PANEL}, r AS (SELECT symbol, date, {RETURNS} FROM panel), "
    "result AS (SELECT symbol, date, CASE WHEN Log_Return IS NULL THEN 0 ELSE greatest(least(Log_Return, 1), -1) END "
    "AS Log_Return, CASE WHEN Return IS NULL THEN 0 ELSE greatest(least(Return, 1), -1) END AS Return FROM r)",
)
def clip(spark, sf):
    return ft.clip_features(cl.add_returns(panel(spark, sf)), ["Log_Return", "Return"], 1.0)
