"""Trend, momentum, volatility and volume indicators.

Each indicator is also available alone. :func:`add_indicators` computes all of
them level by level, one projection per dependency level, so that windows of
equal spec are planned as one operator over one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..config import DEFAULTS, TRADING_DAYS, Settings
from ..functions.ewm import BLOCK_ORDER, Decay, add_blocks, decayed_sums
from ..functions.windows import (
    drop_scratch,
    num,
    sql_lag,
    sql_log_ratio,
    sql_over,
    sql_ratio,
    with_sql,
)

ANNUAL = num(math.sqrt(TRADING_DAYS))
CANDLES = {
    "High_Low_range": "high - low",
    "Close_Open_diff": "close - open",
    "Shadow_Upper": "high - greatest(close, open)",
    "Shadow_Lower": "least(close, open) - low",
}
TYPICAL_VALUE = "(high + low + close) / 3D * volume"
TRADED = "sum(volume) OVER (PARTITION BY symbol) > 0"


def default_ohlv(df: DataFrame) -> DataFrame:
    """Add a missing open, high or low as the close and a missing volume as zero."""
    fill = {c: "close" for c in ("open", "high", "low") if c not in df.columns}
    if "volume" not in df.columns:
        fill["volume"] = "0D"
    return with_sql(df, fill) if fill else df


# Expressions shared by the stand-alone and the fused form.


def _rsi_specs(delta: str, period: int) -> list[Decay]:
    """Decayed sums of gains and losses; both null where there is no previous row."""
    d = 1.0 - 1.0 / period
    gain = f"CASE WHEN {delta} > 0 THEN {delta} WHEN {delta} IS NOT NULL THEN 0D END"
    loss = f"CASE WHEN {delta} < 0 THEN -{delta} WHEN {delta} IS NOT NULL THEN 0D END"
    return [Decay("_gain", gain, d, seeded=False), Decay("_loss", loss, d, seeded=False)]


def _rsi(period: int) -> str:
    # Gain and loss are means under the same weights, whose totals cancel in the
    # ratio. Row _n holds _n moves.
    return f"IF(_n >= {period}, 100D - 100D / (1D + {sql_ratio('_gain', '_loss')}), NULL)"


def _bollinger(mid: str, std: str, k: float) -> dict[str, str]:
    upper, lower = f"({mid} + {num(k)} * {std})", f"({mid} - {num(k)} * {std})"
    width = f"({upper} - {lower})"
    return {
        "BB_Upper": upper,
        "BB_Mid": mid,
        "BB_Lower": lower,
        "BB_Width": width,
        "BB_PctB": sql_ratio(f"close - {lower}", width),
    }


def _true_range(prev: str) -> str:
    return f"greatest(high - low, abs(high - {prev}), abs(low - {prev}))"


def _stochastic_k(lo: str, hi: str) -> str:
    return f"100D * {sql_ratio(f'close - {lo}', f'{hi} - {lo}')}"


def _williams(lo: str, hi: str) -> str:
    return f"-100D * {sql_ratio(f'{hi} - close', f'{hi} - {lo}')}"


def _roc(lagged: str) -> str:
    return f"({sql_ratio('close', lagged)} - 1D) * 100D"


def _signed_volume(prev: str) -> str:
    return f"coalesce(signum(close - {prev}), 0D) * volume"


# Stand-alone indicators.


def add_sma(df: DataFrame, windows=DEFAULTS.windows) -> DataFrame:
    return with_sql(df, {f"SMA_{n}": sql_over("avg(close)", n) for n in windows})


def add_ema(df: DataFrame, spans=DEFAULTS.windows) -> DataFrame:
    specs = [Decay.ema(f"EMA_{s}", "close", s) for s in spans]
    return drop_scratch(decayed_sums(add_blocks(df), specs))


def add_price_sma_ratio(df: DataFrame, windows=DEFAULTS.windows) -> DataFrame:
    return with_sql(
        df, {f"Price_SMA_{n}_ratio": sql_ratio("close", sql_over("avg(close)", n)) for n in windows}
    )


def add_macd(df: DataFrame, fast=12, slow=26, signal=9) -> DataFrame:
    df = decayed_sums(
        add_blocks(df), [Decay.ema("_fast", "close", fast), Decay.ema("_slow", "close", slow)]
    )
    df = with_sql(df, {"MACD": "_fast - _slow"})
    df = decayed_sums(df, [Decay.ema("MACD_Signal", "MACD", signal)])
    return drop_scratch(with_sql(df, {"MACD_Hist": "MACD - MACD_Signal"}))


def add_rsi(df: DataFrame, period: int = DEFAULTS.rsi_period) -> DataFrame:
    df = add_blocks(with_sql(df, {"_delta": f"close - {sql_lag('close')}"}))
    df = decayed_sums(df, _rsi_specs("_delta", period))
    return drop_scratch(with_sql(df, {"RSI": _rsi(period)}))


def add_bollinger(df: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    df = with_sql(
        df,
        {"_mid": sql_over("avg(close)", window), "_std": sql_over("stddev_samp(close)", window)},
    )
    return drop_scratch(with_sql(df, _bollinger("_mid", "_std", n_std)))


def add_atr(df: DataFrame, period: int = DEFAULTS.atr_period) -> DataFrame:
    df = with_sql(with_sql(df, {"_prev": sql_lag("close")}), {"_tr": _true_range("_prev")})
    df = decayed_sums(add_blocks(df), [Decay.ema("ATR", "_tr", period)])
    return drop_scratch(with_sql(df, {"ATR_ratio": sql_ratio("ATR", "close")}))


def add_stochastic(df: DataFrame, k_period: int = 14, d_period: int = 3) -> DataFrame:
    lo, hi = sql_over("min(low)", k_period), sql_over("max(high)", k_period)
    df = with_sql(df, {"_lo": lo, "_hi": hi})
    df = with_sql(df, {"Stoch_K": _stochastic_k("_lo", "_hi")})
    return drop_scratch(with_sql(df, {"Stoch_D": sql_over("avg(Stoch_K)", d_period)}))


def add_williams_r(df: DataFrame, period: int = 14) -> DataFrame:
    df = with_sql(df, {"_lo": sql_over("min(low)", period), "_hi": sql_over("max(high)", period)})
    return drop_scratch(with_sql(df, {"Williams_R": _williams("_lo", "_hi")}))


def add_roc(df: DataFrame, periods=(5, 10, 21)) -> DataFrame:
    return with_sql(df, {f"ROC_{n}": _roc(sql_lag("close", n)) for n in periods})


def add_historical_vol(df: DataFrame, windows=(21, 63)) -> DataFrame:
    df = with_sql(df, {"_lr": sql_log_ratio("close", sql_lag("close"))})
    return drop_scratch(
        with_sql(df, {f"HV_{n}": f"{sql_over('stddev_samp(_lr)', n)} * {ANNUAL}" for n in windows})
    )


def add_obv(df: DataFrame) -> DataFrame:
    df = with_sql(df, {"_signed": _signed_volume(sql_lag("close"))})
    return drop_scratch(with_sql(df, {"OBV": sql_over("sum(_signed)")}))


def add_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted price since the start of the series."""
    pv, v = sql_over(f"sum({TYPICAL_VALUE})"), sql_over("sum(volume)")
    return with_sql(df, {"VWAP": sql_ratio(pv, v)})


def add_volume_group(df: DataFrame) -> DataFrame:
    """OBV, VWAP, volume average and ratio, OBV EMA; null for a series that
    never traded."""
    df = with_sql(
        add_vwap(add_obv(df)),
        {"Volume_SMA_20": sql_over("avg(volume)", 20), "_traded": TRADED},
    )
    df = decayed_sums(add_blocks(df), [Decay.ema("OBV_EMA", "OBV", 20)])
    df = with_sql(df, {"Volume_ratio": sql_ratio("volume", "Volume_SMA_20")})
    group = ("OBV", "VWAP", "Volume_SMA_20", "Volume_ratio", "OBV_EMA")
    return drop_scratch(with_sql(df, {c: f"IF(_traded, {c}, NULL)" for c in group}))


def add_candles(df: DataFrame) -> DataFrame:
    return with_sql(df, CANDLES)


# All of them together.


def needed_lags(cfg: Settings) -> list[int]:
    """Close lags that the indicators and the scale-free features use."""
    return sorted({*cfg.lags, 1, 2, 3, 4, 5, 6, 10, 21})


def add_indicators(df: DataFrame, cfg: Settings = DEFAULTS, scratch: bool = False) -> DataFrame:
    """All 43 indicators. With ``scratch`` the shared helper columns (close lags,
    rolling statistics, row position) are kept for the next feature step."""
    df = default_ohlv(df)
    bb_n, bb_std = cfg.bollinger

    # Level 1: frames over the raw bars.
    level1 = {"_n": sql_over("row_number()") + " - 1"}
    level1 |= {f"_lag_{k}": sql_lag("close", k) for k in needed_lags(cfg)}
    for n in sorted({*cfg.windows, bb_n}):
        level1[f"_mean_{n}"] = sql_over("avg(close)", n)
        level1[f"_std_{n}"] = sql_over("stddev_samp(close)", n)
        level1[f"_min_{n}"] = sql_over("min(close)", n)
        level1[f"_max_{n}"] = sql_over("max(close)", n)
    level1["_lo14"] = sql_over("min(low)", 14)
    level1["_hi14"] = sql_over("max(high)", 14)
    level1["_pv"] = sql_over(f"sum({TYPICAL_VALUE})")
    level1["_v"] = sql_over("sum(volume)")
    level1["_v20"] = sql_over("avg(volume)", 20)
    level1["_traded"] = TRADED
    df = add_blocks(with_sql(df, level1))

    # Level 2: row expressions on level 1.
    df = with_sql(
        df,
        {
            "_delta": "close - _lag_1",
            "_lr": sql_log_ratio("close", "_lag_1"),
            "_tr": _true_range("_lag_1"),
            "Stoch_K": _stochastic_k("_lo14", "_hi14"),
            "_signed": _signed_volume("_lag_1"),
        },
    )

    # Level 3: frames over level 2, then every exponential sum of a raw column.
    df = with_sql(
        df,
        {
            "HV_21": f"{sql_over('stddev_samp(_lr)', 21, BLOCK_ORDER)} * {ANNUAL}",
            "HV_63": f"{sql_over('stddev_samp(_lr)', 63, BLOCK_ORDER)} * {ANNUAL}",
            "_obv": sql_over("sum(_signed)", None, BLOCK_ORDER),
            "Stoch_D": sql_over("avg(Stoch_K)", 3, BLOCK_ORDER),
        },
    )
    fast, slow, signal = cfg.macd
    df = decayed_sums(
        df,
        [Decay.ema(f"EMA_{s}", "close", s) for s in cfg.windows]
        + [
            Decay.ema("_fast", "close", fast),
            Decay.ema("_slow", "close", slow),
            Decay.ema("ATR", "_tr", cfg.atr_period),
        ]
        + _rsi_specs("_delta", cfg.rsi_period),
    )

    # Level 4: exponential sums of derived columns.
    df = decayed_sums(
        with_sql(df, {"MACD": "_fast - _slow"}),
        [Decay.ema("MACD_Signal", "MACD", signal), Decay.ema("_obv_ema", "_obv", 20)],
    )

    out: dict[str, str] = {}
    for n in cfg.windows:
        out[f"SMA_{n}"] = f"_mean_{n}"
        out[f"EMA_{n}"] = f"EMA_{n}"
        out[f"Price_SMA_{n}_ratio"] = sql_ratio("close", f"_mean_{n}")
    out["MACD"], out["MACD_Signal"] = "MACD", "MACD_Signal"
    out["MACD_Hist"] = "MACD - MACD_Signal"
    out["RSI"] = _rsi(cfg.rsi_period)
    out |= _bollinger(f"_mean_{bb_n}", f"_std_{bb_n}", bb_std)
    out["ATR"] = "ATR"
    out["ATR_ratio"] = sql_ratio("ATR", "close")
    out["Stoch_K"], out["Stoch_D"] = "Stoch_K", "Stoch_D"
    out["Williams_R"] = _williams("_lo14", "_hi14")
    out |= {f"ROC_{n}": _roc(f"_lag_{n}") for n in (5, 10, 21)}
    out["HV_21"], out["HV_63"] = "HV_21", "HV_63"
    volume = {
        "OBV": "_obv",
        "VWAP": sql_ratio("_pv", "_v"),
        "Volume_SMA_20": "_v20",
        "Volume_ratio": sql_ratio("volume", "_v20"),
        "OBV_EMA": "_obv_ema",
    }
    out |= {c: f"IF(_traded, {e}, NULL)" for c, e in volume.items()}
    out |= CANDLES

    kept = [f"`{c}`" for c in df.columns if c not in out and (scratch or not c.startswith("_"))]
    return df.selectExpr(*kept, *[f"{e} AS {name}" for name, e in out.items()])
