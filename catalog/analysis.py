"""Exploratory-analysis queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marketframe.operators import clean as cl
from marketframe.operators import eda

from . import check
from .bars import GRID, PANEL, VALUES, bars, panel
from .cleaning import RETURNS
from .features import ALL_FEATURES, FEATURE_SET, feature_set
from .indicators import SERIES, over
from .splits import ROWS

RETURNED = f"{PANEL}, ret AS MATERIALIZED (SELECT *, {RETURNS} FROM panel)"
KNOWN = f"{RETURNED}, known AS MATERIALIZED (SELECT * FROM ret WHERE Return IS NOT NULL)"


def returned(spark, sf):
    return cl.add_returns(panel(spark, sf))


_nulls = ", ".join(f"count(*) - count({c}) AS null_{c}" for c in VALUES)


@check(
    "X1_overview",
    "symbol n_rows:i n_columns:i first_date:d last_date:d " + " ".join(f"null_{c}:i" for c in VALUES),
    f"WITH {GRID}, result AS (SELECT symbol, count(*) AS n_rows, 7 AS n_columns, min(date) AS first_date, "
    f"max(date) AS last_date, {_nulls} FROM grid GROUP BY symbol)",
)
def overview(spark, sf):
    return eda.overview(cl.business_days(cl.weekdays_only(bars(spark, sf))))


_describe = " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS lowest, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS highest "
    "FROM panel GROUP BY symbol"
    for c in VALUES
)


@check(
    "X1_describe",
    "symbol column_name n:i mean:5 std:5 lowest:8 q25:6 q50:6 q75:6 highest:8",
    f"WITH {PANEL}, result AS ({_describe})",
)
def describe(spark, sf):
    return eda.describe(panel(spark, sf)).withColumnsRenamed(
        {"column": "column_name", "count": "n", "min": "lowest", "max": "highest"}
    )


@check(
    "X2_plot_series",
    "symbol date:d close:8 volume_m:8 return_pct:6",
    f"WITH {RETURNED}, result AS (SELECT symbol, date, close, volume / 1e6::DOUBLE AS volume_m, Return * 100 AS return_pct FROM ret)",
)
def plot_series(spark, sf):
    return eda.plot_series(returned(spark, sf))


@check(
    "X3_histogram",
    "symbol bin:i centre:6 n:i density:6 normal:6",
    f"""WITH {KNOWN},
st AS (SELECT symbol, min(Return) AS lo, max(Return) AS hi, avg(Return) AS m, stddev_samp(Return) AS s, count(*) AS n,
              (max(Return) - min(Return)) / 120 AS width FROM known GROUP BY symbol),
b AS (SELECT k.symbol, least(CAST(floor((Return - lo) / width) AS INTEGER), 119) AS bin, count(*) AS c
      FROM known k JOIN st ON k.symbol = st.symbol GROUP BY ALL),
every AS (SELECT *, unnest(range(120)) AS bin FROM st),
result AS (
  SELECT e.symbol, e.bin, lo + (e.bin + 0.5) * width AS centre, coalesce(c, 0) AS n, coalesce(c, 0) / (n * width) AS density,
         exp(-0.5 * power((lo + (e.bin + 0.5) * width - m) / s, 2)) / (s * sqrt(2 * pi())) AS normal
  FROM every e LEFT JOIN b ON e.symbol = b.symbol AND e.bin = b.bin)""",
)
def histogram(spark, sf):
    return eda.histogram(returned(spark, sf)).withColumnRenamed("count", "n")


@check(
    "X5_student_t",
    "symbol n:i df:4 loc:6 scale:6",
    f"""WITH {KNOWN},
m AS (SELECT symbol, count(*) AS n, avg(Log_Return) AS loc, var_samp(Log_Return) AS v, kurtosis_pop(Log_Return) AS k
      FROM known GROUP BY symbol),
result AS (SELECT symbol, n, CASE WHEN k > 0 THEN 4 + 6 / k END AS df, loc,
                  sqrt(v * CASE WHEN k > 0 THEN (2 + 6 / k) / (4 + 6 / k) ELSE 1 END) AS scale FROM m)""",
)
def student_t(spark, sf):
    return eda.student_t_fit(returned(spark, sf), "Log_Return")


def _poly(cs, x: str) -> str:
    out = f"({cs[0]!r}::DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


_tail = "sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END))"
_edge = f"({_poly(eda.INV_C, _tail)} / ({_poly(eda.INV_D, _tail)} * {_tail} + 1))"
_mid = f"((p - 0.5) * {_poly(eda.INV_A, '((p - 0.5) * (p - 0.5))')} / ({_poly(eda.INV_B, '((p - 0.5) * (p - 0.5))')} * ((p - 0.5) * (p - 0.5)) + 1))"


@check(
    "X6_qq_points",
    "symbol position:i sample:6 theoretical:6 slope:6 intercept:6 r:6",
    f"""WITH {KNOWN},
o AS (SELECT symbol, Return AS sample, row_number() OVER (PARTITION BY symbol ORDER BY Return) AS position,
             count(*) OVER (PARTITION BY symbol) AS n FROM known),
q AS (SELECT *, CASE WHEN position = n THEN power(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN position = 1 THEN 1 - power(0.5::DOUBLE, 1.0::DOUBLE / n)
                     ELSE (position - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o),
t AS (SELECT *, CASE WHEN p > 0.02425 AND p < 0.97575 THEN {_mid} WHEN p < 0.5 THEN {_edge} ELSE -{_edge} END AS theoretical FROM q),
l AS (SELECT symbol, regr_slope(sample, theoretical) AS slope, regr_intercept(sample, theoretical) AS intercept,
             corr(sample, theoretical) AS r FROM t GROUP BY symbol),
result AS (SELECT t.symbol, position, sample, theoretical, slope, intercept, r FROM t JOIN l ON t.symbol = l.symbol)""",
)
def qq(spark, sf):
    return eda.qq_points(returned(spark, sf))


@check(
    "X7_rolling_shape",
    "symbol date:d skew:5 kurtosis:5",
    f"""WITH {KNOWN},
s AS (SELECT symbol, date, count(*) OVER {over(63)} AS n, skewness(Return) OVER {over(63)} AS g, kurtosis(Return) OVER {over(63)} AS k FROM known),
result AS (SELECT symbol, date, CASE WHEN n = 63 THEN g END AS skew, CASE WHEN n = 63 THEN k END AS kurtosis FROM s)""",
)
def rolling_shape(spark, sf):
    return eda.rolling_shape(returned(spark, sf))


@check(
    "X8_return_stats",
    "symbol mean_annual:5 vol_annual:5 skew:5 kurtosis:5 min_daily:6 max_daily:6",
    f"WITH {KNOWN}, result AS (SELECT symbol, avg(Return) * 252 AS mean_annual, stddev_samp(Return) * sqrt(252) AS vol_annual, "
    "skewness(Return) AS skew, kurtosis(Return) AS kurtosis, min(Return) AS min_daily, max(Return) AS max_daily FROM known GROUP BY symbol)",
)
def return_stats(spark, sf):
    return eda.return_stats(returned(spark, sf))


_vol = ", ".join(
    f"CASE WHEN count(*) OVER {over(n)} = {n} THEN stddev_samp(Log_Return) OVER {over(n)} * sqrt(252) * 100 END AS HV_{n}"
    for n in (21, 63, 126)
)


@check(
    "X9_rolling_volatility",
    "symbol date:d HV_21:6 HV_63:6 HV_126:6",
    f"WITH {KNOWN}, result AS (SELECT symbol, date, {_vol} FROM known)",
)
def volatility(spark, sf):
    return eda.rolling_volatility(returned(spark, sf))


@check(
    "X10_mean_by_month",
    "symbol month:i mean_return:6",
    f"WITH {RETURNED}, result AS (SELECT symbol, month(date) AS month, avg(Return) * 100 AS mean_return FROM ret GROUP BY ALL)",
)
def by_month(spark, sf):
    return eda.mean_by_month(returned(spark, sf))


@check(
    "X11_mean_by_weekday",
    "symbol weekday:i mean_return:6",
    f"WITH {RETURNED}, result AS (SELECT symbol, isodow(date) - 1 AS weekday, avg(Return) * 100 AS mean_return FROM ret GROUP BY ALL)",
)
def by_weekday(spark, sf):
    return eda.mean_by_weekday(returned(spark, sf))


@check(
    "X12_recent_indicators",
    "symbol date:d BB_Upper:6 SMA_50:6 RSI:6 MACD_Hist:6 rsi_upper_clip:6 rsi_lower_clip:6 hist_up:i volume_m:8 volume_sma_m:8",
    f"""{FEATURE_SET}, result AS (
  SELECT symbol, date, BB_Upper, SMA_50, RSI, MACD_Hist, least(RSI, 70) AS rsi_upper_clip, greatest(RSI, 30) AS rsi_lower_clip,
         MACD_Hist >= 0 AS hist_up, volume / 1e6::DOUBLE AS volume_m, Volume_SMA_20 / 1e6::DOUBLE AS volume_sma_m
  FROM featured QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252)""",
)
def recent(spark, sf):
    return eda.recent_indicators(feature_set(spark, sf))


@check("X13_adf", "symbol n:i lags:i statistic:4 p_value:4 critical_5:4")
def adf(spark, sf):
    return eda.adf(panel(spark, sf))


@check(
    "X14_kpss",
    "symbol n:i lags:i statistic:6",
    f"""WITH {PANEL},
e AS (SELECT symbol, date, close - avg(close) OVER (PARTITION BY symbol) AS e, count(*) OVER (PARTITION BY symbol) AS n,
             row_number() OVER {SERIES} AS r FROM panel),
s AS (SELECT *, sum(e) OVER {SERIES} AS s, CAST(floor(12 * power(n / 100.0::DOUBLE, 0.25::DOUBLE)) AS INTEGER) AS l FROM e),
pairs AS (SELECT a.symbol, sum(a.e * b.e * (1 - (a.r - b.r) / (a.l + 1.0::DOUBLE))) AS w
          FROM s a JOIN s b ON a.symbol = b.symbol AND b.r < a.r AND b.r >= a.r - a.l GROUP BY a.symbol),
m AS (SELECT symbol, any_value(n) AS n, any_value(l) AS lags, sum(s * s) AS ss, sum(e * e) AS ee FROM s GROUP BY symbol),
result AS (SELECT m.symbol, n, lags, ss / (n * n) / ((ee + 2 * w) / n) AS statistic FROM m JOIN pairs p ON m.symbol = p.symbol)""",
)
def kpss(spark, sf):
    return eda.kpss(panel(spark, sf))


_lags = ", ".join(f"sum(c * lag_{k}) / sum(c * c) AS r{k}" for k in range(1, 41))
_lag_cols = ", ".join(f"lag(c, {k}) OVER {SERIES} AS lag_{k}" for k in range(1, 41))


@check(
    "X15_acf",
    "symbol lag:i acf:6",
    f"""WITH {PANEL},
c AS (SELECT symbol, date, close - avg(close) OVER (PARTITION BY symbol) AS c FROM panel),
l AS (SELECT symbol, c, {_lag_cols} FROM c),
r AS (SELECT symbol, 1.0::DOUBLE AS r0, {_lags} FROM l GROUP BY symbol),
result AS (SELECT symbol, CAST(substr(name, 2) AS INTEGER) AS lag, acf
           FROM (UNPIVOT r ON {', '.join(f'r{k}' for k in range(41))} INTO NAME name VALUE acf))""",
)
def acf(spark, sf):
    return eda.acf(panel(spark, sf))


@check(
    "X13_adf_one_lag",
    "symbol n:i statistic:5",
    f"""WITH {PANEL},
d AS (SELECT symbol, date, lag(close) OVER {SERIES} AS x, close - lag(close) OVER {SERIES} AS y FROM panel),
l AS (SELECT *, lag(y) OVER {SERIES} AS z FROM d),
g AS (SELECT symbol, count(*) AS n, regr_sxx(x, z) AS zz, regr_syy(x, z) AS xx, regr_sxy(x, z) AS xz, regr_syy(y, x) AS yy,
             regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy FROM l WHERE z IS NOT NULL GROUP BY symbol),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS c FROM g),
result AS (SELECT symbol, n, b / sqrt((yy - b * xy - c * zy) / (n - 3) * zz / (xx * zz - xz * xz)) AS statistic FROM b)""",
)
def adf_one_lag(spark, sf):
    """The same test at a given lag order, whose regression has a closed form."""
    return eda.adf(panel(spark, sf), lags=1)


@check(
    "X5_student_t_likelihood",
    "symbol n:i loc_score:4 scale_score:4 better:i",
    f"""WITH {KNOWN},
times AS (SELECT symbol, count(*) AS c FROM known GROUP BY symbol, Log_Return),
s AS (SELECT symbol, sum(c) AS n, CASE WHEN max(c) * 6 <= sum(c) THEN 0 END AS score FROM times GROUP BY symbol),
result AS (SELECT symbol, n, score AS loc_score, score AS scale_score, score AS better FROM s)""",
)
def student_t_likelihood(spark, sf):
    """Slopes of the log likelihood at the fit, which are 0 at its top, and whether a fit with
    other degrees of freedom is likelier."""
    rows = returned(spark, sf).filter(F.col("Log_Return").isNotNull())
    fits = eda.student_t_likelihood(rows, "Log_Return").withColumnRenamed("n", "_n")
    v, z = F.col("df"), (F.col("Log_Return") - F.col("loc")) / F.col("scale")
    other = lambda k: F.sum(F.log1p(z * z / (v * k))) * (v * k + 1) / 2
    met = rows.join(fits, "symbol").groupBy("symbol", "df", "loc", "scale", "loglik").agg(
        F.count("*").alias("n"),
        F.avg((v + 1) * z / (v + z * z)).alias("loc_score"),
        F.avg((v + 1) * z * z / (v + z * z) - 1).alias("scale_score"),
        *[other(k).alias(f"_{i}") for i, k in enumerate((0.9, 1.1))],
    )

    # The constant of the likelihood for other degrees of freedom: only numbers per symbol.
    gamma = lambda k: F.udf(lambda d: None if d is None else math.lgamma((d * k + 1) / 2) - math.lgamma(d * k / 2) - 0.5 * math.log(d * k * math.pi), "double")(v)
    likelier = [F.col("n") * (gamma(k) - F.log("scale")) - F.col(f"_{i}") > F.col("loglik") + 1e-6 for i, k in enumerate((0.9, 1.1))]
    return met.withColumn("better", sum(c.cast("int") for c in likelier))


@check(
    "X16_pacf",
    "symbol lag:i pacf:5",
    f"""WITH RECURSIVE {PANEL},
c AS (SELECT symbol, date, close - avg(close) OVER (PARTITION BY symbol) AS c FROM panel),
l AS (SELECT symbol, c, {_lag_cols} FROM c),
r AS (SELECT symbol, [{', '.join(f'sum(c * lag_{k}) / sum(c * c)' for k in range(1, 41))}] AS r FROM l GROUP BY symbol),
steps AS (
  SELECT symbol, r, 1 AS lag, r[1] AS last, [r[1]] AS phi FROM r
  UNION ALL
  SELECT symbol, r, lag + 1, last, list_append(list_transform(range(1, lag + 1), lambda i : phi[i] - last * phi[lag + 1 - i]), last) FROM (
    SELECT symbol, r, lag, phi, (r[lag + 1] - list_sum(list_transform(range(1, lag + 1), lambda i : phi[i] * r[lag + 1 - i])))
             / (1 - list_sum(list_transform(range(1, lag + 1), lambda i : phi[i] * r[i]))) AS last FROM steps WHERE lag < 40)),
result AS (SELECT symbol, lag, last AS pacf FROM steps UNION ALL SELECT symbol, 0 AS lag, 1.0 AS pacf FROM r)""",
)
def pacf(spark, sf):
    return eda.pacf(panel(spark, sf))


_every = ["open", "high", "low", "volume", *ALL_FEATURES]


@check(
    "X17_top_correlations",
    "feature corr:6",
    f"""{FEATURE_SET},
r AS (SELECT {', '.join(f'corr({c}, close) AS "{c}"' for c in ["close", *_every])} FROM featured),
result AS (SELECT feature, corr FROM (UNPIVOT r ON COLUMNS(*) INTO NAME feature VALUE corr) ORDER BY abs(corr) DESC, feature LIMIT 21)""",
)
def top_correlations(spark, sf):
    """The target and the 20 features most correlated with it, of all numeric columns."""
    return eda.correlation_with(feature_set(spark, sf))


_some = ["close", "open", "high", "low", "volume", "SMA_5", "SMA_20", "SMA_50", "SMA_200", "EMA_20", "EMA_50", "MACD", "MACD_Signal",
         "RSI", "BB_Width", "ATR", "Stoch_K", "HV_21", "OBV", "VWAP", "Log_Return"]


@check(
    "X17_correlation_matrix",
    "a b corr:6",
    f"""{FEATURE_SET}, one AS (SELECT {', '.join(f'corr({a}, {b}) AS "{a}|{b}"' for a in _some for b in _some)} FROM featured),
result AS (SELECT split_part(name, '|', 1) AS a, split_part(name, '|', 2) AS b, corr FROM (UNPIVOT one ON COLUMNS(*) INTO NAME name VALUE corr))""",
)
def matrix(spark, sf):
    return eda.correlation_matrix(feature_set(spark, sf), _some)


@check(
    "X18_split_ranges",
    "symbol split first_date:d last_date:d n_rows:i",
    f"WITH {ROWS}, result AS (SELECT symbol, split, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM parts GROUP BY symbol, split)",
)
def split_ranges(spark, sf):
    return eda.split_ranges(panel(spark, sf))
