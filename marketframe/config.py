"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

SYMBOL = "symbol"
DATE = "date"
OHLCV = ("open", "high", "low", "close", "volume")
TARGET = "Target_LogRet"
RETURN_SCALE = 100.0
TRADING_DAYS = 252

# These must equal the engine being matched for results to agree.
COLUMN_ALIASES = {
    "date": "date",
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "volume": "volume",
}
SOURCE_PRIORITY = (
    "Yahoo Finance",
    "Investing.com (via proxy)",
    "Barchart (via proxy)",
    "MarketWatch",
    "NASDAQ",
)
MODEL_FEATURE_PREFIXES = (
    "Return", "Log_Return", "LogRet_", "Price_SMA_", "Close_zscore_",
    "Close_to_max_", "Close_to_min_", "MACD_norm", "MACD_Signal_norm",
    "MACD_Hist_norm", "RSI", "BB_PctB", "BB_Width_norm", "ATR_ratio",
    "Stoch_", "Williams_R", "ROC_", "HV_", "Volume_ratio", "OBV_trend",
    "HL_range_pct", "CO_pct", "Shadow_Upper_pct", "Shadow_Lower_pct",
    "DayOfWeek", "Month_sin", "Month_cos", "IsMonthEnd", "IsMonthStart",
    "IsQtrEnd",
)
ENSEMBLE_WEIGHTS = {"arima": 0.15, "prophet": 0.20, "lstm": 0.35, "xgboost": 0.30}
FORECAST_MODELS = ("arima", "prophet", "lstm", "xgboost", "ensemble")


@dataclass(frozen=True)
class Settings:
    """Windows, ratios and model settings, with the matched engine's defaults."""

    lags: tuple[int, ...] = (1, 2, 3, 5, 10, 21)
    windows: tuple[int, ...] = (5, 10, 20, 50, 200)
    rsi_period: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    atr_period: int = 14
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    forecast_days: int = 30
    ar_last_rows: int = 500
    ar_max_p: int = 3
    ar_max_d: int = 1
    ar_max_q: int = 3
    changepoint_prior: float = 0.05
    seasonality_prior: float = 10.0
    holidays_prior: float = 10.0
    cv_initial_days: int = 730
    cv_period_days: int = 180
    cv_horizon_days: int = 90
    lookback: int = 60
    search_trials: int = 50
    search_folds: int = 5
    history_rows: int = 400
    weights: dict[str, float] = field(default_factory=lambda: dict(ENSEMBLE_WEIGHTS))


DEFAULTS = Settings()
