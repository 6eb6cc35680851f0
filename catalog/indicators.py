"""Indicator queries on the filled panel."""

from __future__ import annotations

from marketframe.operators import indicators as ind
from marketframe.config import DEFAULTS

from . import check
from .bars import PANEL, panel

WINDOWS = DEFAULTS.windows


def over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SERIES = "(PARTITION BY symbol ORDER BY date)"
RUN = "(PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


def per_row(exprs: dict[str, str]) -> str:
    """A WITH clause whose ``result`` adds expressions to the panel."""
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"WITH {PANEL}, result AS (SELECT symbol, date, {cols} FROM panel)"


# Every recurrence in one recursive pass, row by row.
NUMBERED = f"""{PANEL},
step0 AS (
  SELECT *, row_number() OVER {SERIES} AS rn, lag(close) OVER {SERIES} AS pc FROM panel),
step1 AS (
  SELECT *, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain,
         CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss,
         greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
         sum(CASE WHEN pc IS NULL THEN 0 ELSE sign(close - pc) * volume END) OVER {RUN} AS obv
  FROM (SELECT * FROM step0)),
numbered AS MATERIALIZED (SELECT symbol, date, rn, close, gain, loss, tr, obv FROM step1)"""


def _ema(prev: str, x: str, span: int) -> str:
    return f"({prev} + (2.0::DOUBLE / {span + 1}) * ({x} - {prev}))"


_e12, _e26 = _ema("e.e12", "n.close", 12), _ema("e.e26", "n.close", 26)
_first = ", ".join(f"close AS e{s}" for s in WINDOWS + (12, 26))
_next = ", ".join(f"{_ema(f'e.e{s}', 'n.close', s)} AS e{s}" for s in WINDOWS + (12, 26))

EWM = f"""WITH RECURSIVE {NUMBERED},
ewm AS (
  SELECT symbol, date, rn, {_first}, 0.0::DOUBLE AS sig, tr AS atr,
         0.0::DOUBLE AS sg, 0.0::DOUBLE AS sl, CAST(obv AS DOUBLE) AS obv_ema
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.date, n.rn, {_next}, {_ema('e.sig', f'({_e12} - {_e26})', 9)} AS sig,
         {_ema('e.atr', 'n.tr', 14)} AS atr,
         e.sg * (13.0::DOUBLE / 14) + n.gain AS sg, e.sl * (13.0::DOUBLE / 14) + n.loss AS sl,
         {_ema('e.obv_ema', 'n.obv', 20)} AS obv_ema
  FROM ewm e JOIN numbered n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""

RSI_SQL = "CASE WHEN rn > 14 THEN 100 - 100 / (1 + sg / nullif(sl, 0)) END"


def recursive(exprs: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return (
        f"{EWM}, result AS (SELECT symbol, date, {cols} "
        f"FROM ewm JOIN panel USING (symbol, date) JOIN numbered USING (symbol, date, rn))"
    )


def spec(names, digits: int = 6) -> str:
    return "symbol date:d " + " ".join(f"{n}:{digits}" for n in names)


SMA = {f"SMA_{n}": f"avg(close) OVER {over(n)}" for n in WINDOWS}


@check("I1_sma", spec(SMA), per_row(SMA))
def sma(spark, sf):
    return ind.add_sma(panel(spark, sf))


EMA = {f"EMA_{n}": f"e{n}" for n in WINDOWS}


@check("I2_ema", spec(EMA), recursive(EMA))
def ema(spark, sf):
    return ind.add_ema(panel(spark, sf))


PRICE_SMA = {f"Price_SMA_{n}_ratio": f"close / nullif(avg(close) OVER {over(n)}, 0)" for n in WINDOWS}


@check("I3_price_sma_ratio", spec(PRICE_SMA), per_row(PRICE_SMA))
def price_sma(spark, sf):
    return ind.add_price_sma_ratio(panel(spark, sf))


MACD = {"MACD": "e12 - e26", "MACD_Signal": "sig", "MACD_Hist": "e12 - e26 - sig"}


@check("I4_macd", spec(MACD), recursive(MACD))
def macd(spark, sf):
    return ind.add_macd(panel(spark, sf))


@check("I5_rsi", spec(["RSI"]), recursive({"RSI": RSI_SQL}))
def rsi(spark, sf):
    return ind.add_rsi(panel(spark, sf))


_m, _s = f"avg(close) OVER {over(20)}", f"stddev_samp(close) OVER {over(20)}"
BOLLINGER = {
    "BB_Upper": f"{_m} + 2 * {_s}",
    "BB_Mid": _m,
    "BB_Lower": f"{_m} - 2 * {_s}",
    "BB_Width": f"({_m} + 2 * {_s}) - ({_m} - 2 * {_s})",
    "BB_PctB": f"(close - ({_m} - 2 * {_s})) / nullif(({_m} + 2 * {_s}) - ({_m} - 2 * {_s}), 0)",
}


@check("I6_bollinger", spec(BOLLINGER), per_row(BOLLINGER))
def bollinger(spark, sf):
    return ind.add_bollinger(panel(spark, sf))


ATR = {"ATR": "atr", "ATR_ratio": "atr / nullif(panel.close, 0)"}


@check("I7_atr", spec(ATR), recursive(ATR))
def atr(spark, sf):
    return ind.add_atr(panel(spark, sf))


_lo, _hi = f"min(low) OVER {over(14)}", f"max(high) OVER {over(14)}"
_k = f"100 * (close - {_lo}) / nullif({_hi} - {_lo}, 0)"


@check(
    "I8_stochastic",
    spec(["Stoch_K", "Stoch_D"]),
    f"WITH {PANEL}, k AS (SELECT symbol, date, {_k} AS Stoch_K FROM panel), "
    f"result AS (SELECT *, avg(Stoch_K) OVER {over(3)} AS Stoch_D FROM k)",
)
def stochastic(spark, sf):
    return ind.add_stochastic(panel(spark, sf))


@check(
    "I9_williams_r",
    spec(["Williams_R"]),
    per_row({"Williams_R": f"-100 * ({_hi} - close) / nullif({_hi} - {_lo}, 0)"}),
)
def williams(spark, sf):
    return ind.add_williams_r(panel(spark, sf))


ROC = {f"ROC_{n}": f"(close / nullif(lag(close, {n}) OVER {SERIES}, 0) - 1) * 100" for n in (5, 10, 21)}


@check("I10_roc", spec(ROC), per_row(ROC))
def roc(spark, sf):
    return ind.add_roc(panel(spark, sf))


_hv = ", ".join(f"stddev_samp(lr) OVER {over(n)} * sqrt(252) AS HV_{n}" for n in (21, 63))
LOGRET = f"{PANEL}, lr AS (SELECT *, ln(close / lag(close) OVER {SERIES}) AS lr FROM panel)"


@check(
    "I11_historical_vol",
    spec(["HV_21", "HV_63"]),
    f"WITH {LOGRET}, result AS (SELECT symbol, date, {_hv} FROM lr)",
)
def historical_vol(spark, sf):
    return ind.add_historical_vol(panel(spark, sf))


@check("I12_obv", spec(["OBV"]), f"WITH {NUMBERED}, result AS (SELECT symbol, date, obv AS OBV FROM numbered)")
def obv(spark, sf):
    return ind.add_obv(panel(spark, sf))


VWAP = f"sum((high + low + close) / 3 * volume) OVER {RUN} / nullif(sum(volume) OVER {RUN}, 0)"


@check("I13_vwap", spec(["VWAP"]), per_row({"VWAP": VWAP}))
def vwap(spark, sf):
    return ind.add_vwap(panel(spark, sf))


VOLUME = {
    "Volume_SMA_20": f"avg(volume) OVER {over(20)}",
    "Volume_ratio": f"volume / nullif(avg(volume) OVER {over(20)}, 0)",
    "OBV_EMA": "obv_ema",
}


@check("I14_volume_group", spec(VOLUME), recursive(VOLUME))
def volume_group(spark, sf):
    return ind.add_volume_group(panel(spark, sf))


CANDLES = {
    "High_Low_range": "high - low",
    "Close_Open_diff": "close - open",
    "Shadow_Upper": "high - greatest(close, open)",
    "Shadow_Lower": "least(close, open) - low",
}


@check("I15_candles", spec(CANDLES, 8), per_row(CANDLES))
def candles(spark, sf):
    return ind.add_candles(panel(spark, sf))


@check(
    "I16_default_ohlv",
    spec(["open", "high", "low", "volume", "Close_Open_diff"], 8),
    f"WITH {PANEL}, result AS (SELECT symbol, date, close AS open, close AS high, close AS low, "
    "0.0 AS volume, 0.0 AS Close_Open_diff FROM panel)",
)
def defaults(spark, sf):
    return ind.add_candles(ind.default_ohlv(panel(spark, sf).select("symbol", "date", "close")))
