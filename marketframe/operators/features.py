"""Lag, rolling, calendar and scale-free features, targets and lookback windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    DATE,
    DEFAULTS,
    MODEL_FEATURE_PREFIXES,
    OHLCV,
    RETURN_SCALE,
    SYMBOL,
    TARGET,
    Settings,
)
from ..functions.windows import (
    bar,
    log_ratio,
    num,
    ratio,
    series,
    sql_log_ratio,
    sql_ratio,
    trailing,
    with_sql,
)
from .clean import add_returns, complete, drop_incomplete
from .indicators import add_indicators



def add_lags(df: DataFrame, col: str = "close", lags=DEFAULTS.lags, prefix: str = "Close") -> DataFrame:
    return df.withColumns({f"{prefix}_lag_{k}": F.lag(col, k).over(series()) for k in lags})


def add_rolling_stats(
    df: DataFrame, col: str = "close", windows=DEFAULTS.windows, prefix: str = "Close"
) -> DataFrame:
    out = {}
    for n in windows:
        t = trailing(n)
        out[f"{prefix}_roll_mean_{n}"] = F.avg(col).over(t)
        out[f"{prefix}_roll_std_{n}"] = F.stddev_samp(col).over(t)
        out[f"{prefix}_roll_min_{n}"] = F.min(col).over(t)
        out[f"{prefix}_roll_max_{n}"] = F.max(col).over(t)
    return df.withColumns(out)


def month_flags(d: str = DATE, mode: str = "business") -> dict[str, str]:
    """Month-end, month-start and quarter-end flags of a date expression.

    ``business`` counts the last/first weekday of the month, as a complete
    business-day index does; ``calendar`` counts the calendar day itself, as an
    index without a regular frequency does.
    """
    last, first = f"last_day({d})", f"trunc({d}, 'month')"
    if mode == "business":
        end = f"{d} = date_sub({last}, greatest(weekday({last}) - 4, 0))"
        start = f"{d} = date_add({first}, IF(weekday({first}) > 4, 7 - weekday({first}), 0))"
    elif mode == "calendar":
        end, start = f"{d} = {last}", f"{d} = {first}"
    else:
        raise ValueError(f"unknown month flag mode {mode!r}")
    return {
        "IsMonthEnd": f"CAST({end} AS INT)",
        "IsMonthStart": f"CAST({start} AS INT)",
        "IsQtrEnd": f"CAST({end} AND month({d}) % 3 = 0 AS INT)",
    }


def calendar_columns(mode: str = "business") -> dict[str, str]:
    d, turn = DATE, num(2 * math.pi)
    return {
        "DayOfWeek": f"weekday({d})",
        "Month": f"month({d})",
        "Quarter": f"quarter({d})",
        **month_flags(d, mode),
        "WeekOfYear": f"weekofyear({d})",
        "DayOfYear": f"dayofyear({d})",
        "DayOfWeek_sin": f"sin({turn} * weekday({d}) / 5)",
        "DayOfWeek_cos": f"cos({turn} * weekday({d}) / 5)",
        "Month_sin": f"sin({turn} * month({d}) / 12)",
        "Month_cos": f"cos({turn} * month({d}) / 12)",
    }


def add_calendar(df: DataFrame, mode: str = "business") -> DataFrame:
    return with_sql(df, calendar_columns(mode))


def add_cumulative_returns(df: DataFrame, lags=DEFAULTS.lags) -> DataFrame:
    return df.withColumns(
        {f"LogRet_{k}d": log_ratio(bar.close, F.lag("close", k).over(series())) for k in lags}
    )


def add_lagged_returns(df: DataFrame, lags=(1, 2, 3, 5)) -> DataFrame:
    return df.withColumns(
        {f"Log_Return_lag_{k}": F.lag("Log_Return", k).over(series()) for k in lags}
    )


def add_zscores(df: DataFrame, windows=DEFAULTS.windows) -> DataFrame:
    """Rolling z-score and distance to the rolling extremes; two rows at least."""
    out = {}
    for n in windows:
        t = trailing(n)
        seen = F.count("close").over(t) >= 2
        out[f"Close_zscore_{n}"] = ratio(
            bar.close - F.avg("close").over(t), F.stddev_samp("close").over(t)
        )
        out[f"Close_to_max_{n}"] = F.when(seen, ratio(bar.close, F.max("close").over(t)) - 1)
        out[f"Close_to_min_{n}"] = F.when(seen, ratio(bar.close, F.min("close").over(t)) - 1)
    return df.withColumns(out)


def normalised_columns(available: set[str]) -> dict[str, str]:
    """Price-level-free forms of MACD, bands, candles and OBV."""
    out: dict[str, str] = {}
    if "MACD" in available:
        for c in ("MACD", "MACD_Signal", "MACD_Hist"):
            out[f"{c}_norm"] = sql_ratio(c, "close")
    if "BB_Width" in available:
        out["BB_Width_norm"] = sql_ratio("BB_Width", "BB_Mid")
    if {"high", "low", "open"} <= available:
        out["HL_range_pct"] = sql_ratio("high - low", "close")
        out["CO_pct"] = sql_ratio("close - open", "open")
        out["Shadow_Upper_pct"] = sql_ratio("high - greatest(close, open)", "close")
        out["Shadow_Lower_pct"] = sql_ratio("least(close, open) - low", "close")
    if {"OBV", "OBV_EMA", "Volume_SMA_20"} <= available:
        out["OBV_trend"] = sql_ratio("OBV - OBV_EMA", "Volume_SMA_20")
    return out


def add_normalised(df: DataFrame) -> DataFrame:
    return with_sql(df, normalised_columns(set(df.columns)))


# Features that need a volume: null for a series that never trades.
VOLUME_FEATURES = ("OBV", "VWAP", "Volume_SMA_20", "Volume_ratio", "OBV_EMA", "OBV_trend")


def add_features(
    df: DataFrame, cfg: Settings = DEFAULTS, month_mode: str = "business", traded: bool = False
) -> DataFrame:
    """Every feature, rows with gaps included (see :func:`build_feature_set`).

    ``traded`` keeps the flag ``_traded`` of series that have a volume."""
    df = add_indicators(df, cfg, scratch=True)
    have = set(df.columns)
    plain = {f"Close_lag_{k}": f"_lag_{k}" for k in cfg.lags}
    for n in cfg.windows:
        plain |= {f"Close_roll_{s}_{n}": f"_{s}_{n}" for s in ("mean", "std", "min", "max")}
    free: dict[str, str] = {}
    if "Log_Return" not in have:
        free["Log_Return"] = "_lr"
    if "Return" not in have:
        free["Return"] = sql_ratio("close", "_lag_1") + " - 1"
    free |= {f"LogRet_{k}d": sql_log_ratio("close", f"_lag_{k}") for k in cfg.lags}
    free |= {f"Log_Return_lag_{k}": sql_log_ratio(f"_lag_{k}", f"_lag_{k + 1}") for k in (1, 2, 3, 5)}
    for n in cfg.windows:
        free[f"Close_zscore_{n}"] = sql_ratio(f"close - _mean_{n}", f"_std_{n}")
        for side in ("max", "min"):
            distance = sql_ratio("close", f"_{side}_{n}") + " - 1"
            free[f"Close_to_{side}_{n}"] = f"IF(_n >= 1, {distance}, NULL)"
    free |= normalised_columns(have)
    kept = [f"`{c}`" for c in df.columns if not c.startswith("_") or (traded and c == "_traded")]
    out = plain | calendar_columns(month_mode) | free
    return df.selectExpr(*kept, *[f"{e} AS {c}" for c, e in out.items()])


def build_feature_set(
    df: DataFrame, cfg: Settings = DEFAULTS, month_mode: str = "business"
) -> DataFrame:
    """All features; rows with a missing or non-finite value are dropped.

    The volume group counts only for series that trade: it stays null for others, and
    is left out of the result where the bars have no volume column at all.
    """
    frame = add_features(df, cfg, month_mode, traded=True)
    volume = [c for c in VOLUME_FEATURES if c in frame.columns]
    frame = drop_incomplete(frame, [c for c in frame.columns if c not in (*volume, "_traded")])
    if "volume" not in df.columns:
        return frame.drop("_traded", *volume)
    return frame.filter(f"NOT coalesce(_traded, false) OR ({complete(frame, volume)})").drop("_traded")


def make_model_frame(
    ohlcv: DataFrame, cfg: Settings = DEFAULTS, month_mode: str = "business"
) -> DataFrame:
    """Feature set rebuilt from the bars alone."""
    keep = [c for c in OHLCV if c in ohlcv.columns]
    base = add_returns(ohlcv.select(SYMBOL, DATE, *keep))
    return build_feature_set(base, cfg, month_mode)


def model_feature_columns(df: DataFrame) -> list[str]:
    """Names of the scale-free model inputs, in column order."""
    numeric = {"double", "float", "integer", "long", "short", "byte"}
    return [
        f.name
        for f in df.schema
        if f.name.startswith(MODEL_FEATURE_PREFIXES) and f.dataType.typeName() in numeric
    ]


def add_target(df: DataFrame) -> DataFrame:
    """Next-row log return; null on the last row of a series."""
    return df.withColumn(TARGET, log_ratio(F.lead("close").over(series()), bar.close))


def next_prices(df: DataFrame, logret: str = "r") -> DataFrame:
    """Predicted log returns as prices dated at the day being predicted."""
    out = df.select(
        SYMBOL,
        F.lead(DATE).over(series()).alias(DATE),
        (bar.close * F.exp(F.col(logret))).alias("predicted"),
    )
    return out.filter(F.col(DATE).isNotNull())


def clip_features(df: DataFrame, cols: list[str], bound: float = 10.0) -> DataFrame:
    """Clip to +-bound, missing to zero."""

    def clipped(c: str) -> Column:
        x = F.nanvl(F.col(c), F.lit(None).cast("double"))
        return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))

    return df.withColumns({c: clipped(c) for c in cols})


def lookback_windows(
    df: DataFrame, cols: list[str], lookback: int = DEFAULTS.lookback, target: str | None = TARGET
) -> DataFrame:
    """Windows of ``lookback`` rows that end at the row itself; target in percent."""
    w = trailing(lookback)
    x = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w)
    out = df.withColumns({"window": x})
    if target:
        out = out.withColumn("y", F.col(target) * RETURN_SCALE)
    keep = [SYMBOL, DATE, "window"] + (["y"] if target else [])
    return out.filter(F.size("window") == lookback).select(*keep)


def supervised_sequences(
    df: DataFrame, cols: list[str], lookback: int, horizon: int = 1, *keys: str
) -> DataFrame:
    """Windows of the ``lookback`` rows before a row, with the next ``horizon``
    values of the first column (the row's own value first)."""
    w = series(*keys)
    first = F.col(cols[0]).cast("double")
    out = df.withColumns(
        {
            "window": F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(
                w.rowsBetween(-lookback, -1)
            ),
            "y": F.collect_list(first).over(w.rowsBetween(0, horizon - 1)),
        }
    )
    return out.filter((F.size("window") == lookback) & (F.size("y") == horizon)).select(
        SYMBOL, *keys, DATE, "window", "y"
    )
