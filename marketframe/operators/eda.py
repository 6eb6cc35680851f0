"""Exploratory statistics: the numbers behind each chart, per symbol."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, OHLCV, SYMBOL, TRADING_DAYS
from ..functions.windows import (
    numeric_columns,
    normal_pdf,
    nz,
    running,
    sample_kurtosis,
    sample_skew,
    series,
    sql_lag,
    trailing,
    whole,
    with_sql,
)
from .split import temporal_split

ANNUAL = math.sqrt(TRADING_DAYS)

# MacKinnon (2010) response surface of the Dickey-Fuller test with
# a constant: level -> (b0, b1, b2, b3) in powers of 1/n.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) p-value polynomials of the same test, below and
# above the switch point, and the range outside which the p-value is 0 or 1.
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SWITCH, ADF_LOWEST, ADF_HIGHEST = -1.61, -18.83, 2.74
# Kwiatkowski et al. (1992), level stationarity: p-value -> statistic.
KPSS_CRITICAL = ((0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, first and last date, and null counts per symbol."""
    return df.groupBy(SYMBOL).agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns if c not in (SYMBOL, DATE)],
    )


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per symbol and column (exact)."""
    cols = cols or [c for c in OHLCV if c in df.columns]
    long = df.unpivot([SYMBOL], cols, "column", "value")
    quarts = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(SYMBOL, "column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        quarts.alias("_q"),
        F.max("value").alias("max"),
    )
    quartiles = [F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return out.select(SYMBOL, "column", "count", "mean", "std", "min", *quartiles, "max")


def plot_series(df: DataFrame) -> DataFrame:
    """Close, volume in millions and return in percent."""
    return df.select(
        SYMBOL,
        DATE,
        "close",
        (F.col("volume") / 1e6).alias("volume_m"),
        (F.col("Return") * 100).alias("return_pct"),
    )


def histogram(df: DataFrame, col: str = "Return", bins: int = 120) -> DataFrame:
    """Density histogram over the value range, with the fitted normal density at
    each bin centre. The largest value belongs to the last bin.

    Range and moments are window aggregates over the symbol; the counts of a
    symbol's bins then meet in one short map, so the rows are read once.
    """
    x, per = F.col(col), Window.partitionBy(SYMBOL)
    known = df.filter(x.isNotNull()).select(SYMBOL, x.alias("_x"))
    stats = {
        "_lo": F.min("_x").over(per),
        "_hi": F.max("_x").over(per),
        "_mean": F.avg("_x").over(per),
        "_std": F.stddev_samp("_x").over(per),
        "_n": F.count("_x").over(per),
    }
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.floor((F.col("_x") - F.col("_lo")) / nz(width)).cast("int")
    binned = known.withColumns(stats).withColumn(
        "bin", F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1))
    )
    counts = binned.groupBy(SYMBOL, *stats, "bin").agg(F.count("*").alias("count"))
    pairs = F.map_from_entries(F.collect_list(F.struct("bin", "count")))
    every = counts.groupBy(SYMBOL, *stats).agg(pairs.alias("_counts"))
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = F.col("_lo") + (F.col("bin") + 0.5) * width
    count = F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0))
    return every.select(
        SYMBOL,
        "bin",
        centre.alias("centre"),
        count.alias("count"),
        (count / (F.col("_n") * nz(width))).alias("density"),
        normal_pdf(centre, F.col("_mean"), F.col("_std")).alias("normal"),
    )


def student_t_fit(df: DataFrame, col: str = "Return") -> DataFrame:
    """Degrees of freedom, location and scale of a t distribution by moments.

    Needs a positive excess kurtosis; otherwise the fit is the normal limit
    (degrees of freedom null).
    """
    x = F.col(col)
    m = df.groupBy(SYMBOL).agg(
        F.avg(x).alias("loc"), F.var_samp(x).alias("_var"), F.kurtosis(x).alias("_k"), F.count(x).alias("n")
    )
    nu = F.when(F.col("_k") > 0, 4.0 + 6.0 / nz(F.col("_k")))
    share = F.coalesce((nu - 2.0) / nu, F.lit(1.0))
    return m.select(SYMBOL, "n", nu.alias("df"), "loc", F.sqrt(F.col("_var") * share).alias("scale"))


def _series_arrays(df: DataFrame, col: str) -> DataFrame:
    """``symbol, x``: each symbol's known values in order, as one array (a value per day)."""
    ordered = F.array_sort(F.collect_list(F.struct(DATE, F.col(col).cast("double").alias("x"))))
    known = df.filter(F.col(col).isNotNull())
    return known.groupBy(SYMBOL).agg(F.transform(ordered, lambda r: r["x"]).alias("x"))


def _per_series(df: DataFrame, col: str, test, schema: str) -> DataFrame:
    """A statistic of each symbol's values; ``test`` gives a row or None."""

    def run(batches):
        for pdf in batches:
            rows = [(symbol, *row) for symbol, x in zip(pdf[SYMBOL], pdf["x"]) if (row := test(np.asarray(x, float))) is not None]
            yield pd.DataFrame(rows, columns=[SYMBOL, *[c.split()[0] for c in schema.split(", ")]])

    return _series_arrays(df, col).mapInPandas(run, f"{SYMBOL} string, {schema}")


#: Steps of the latent weights for each degree of freedom, and of the search for it.
WEIGHT_STEPS, SEARCH_STEPS = 200, 60
#: Least degrees of freedom that are looked at. Where one value holds a larger share of the
#: rows than this over one more, the likelihood has no top.
LEAST_DF = 0.2


def _student_t(x: np.ndarray) -> tuple | None:
    """Most likely degrees of freedom, location and scale, and the log likelihood."""
    n = len(x)
    if n < 3 or not np.var(x):
        return None
    if np.unique(x, return_counts=True)[1].max() > n * LEAST_DF / (1 + LEAST_DF):
        return n, None, None, None, None

    def profile(df: float, loc: float, scale: float) -> tuple[float, float, float]:
        """Location and square scale for given degrees of freedom, by reweighted means."""
        for _ in range(WEIGHT_STEPS):
            w = (df + 1) / (df + (x - loc) ** 2 / scale)
            moved = float(w @ x / w.sum())
            spread = float(w @ (x - moved) ** 2 / w.sum())
            still = abs(moved - loc) <= 1e-12 * math.sqrt(scale) and abs(spread - scale) <= 1e-12 * scale
            loc, scale = moved, max(spread, 1e-300)
            if still:
                break
        constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * scale)
        return n * constant - (df + 1) / 2 * float(np.log1p((x - loc) ** 2 / (df * scale)).sum()), loc, scale

    start = float(np.median(x)), float(np.var(x))
    golden, low, high = (math.sqrt(5) - 1) / 2, math.log(LEAST_DF), math.log(1e4)
    left, right = high - golden * (high - low), low + golden * (high - low)
    f_left, f_right = profile(math.exp(left), *start), profile(math.exp(right), *start)
    for _ in range(SEARCH_STEPS):
        if f_left[0] > f_right[0]:
            high, right, f_right = right, left, f_left
            left = high - golden * (high - low)
            f_left = profile(math.exp(left), *f_right[1:])
        else:
            low, left, f_left = left, right, f_right
            right = low + golden * (high - low)
            f_right = profile(math.exp(right), *f_left[1:])
    at, best = (left, f_left) if f_left[0] > f_right[0] else (right, f_right)
    return n, math.exp(at), best[1], math.sqrt(best[2]), best[0]


def student_t_likelihood(df: DataFrame, col: str = "Return") -> DataFrame:
    """Degrees of freedom, location and scale of a t distribution by maximum likelihood.

    For each number of degrees of freedom, location and scale follow from weights that
    fall with a value's distance; the number itself is searched for. It may be below
    4, where no moment fit can go; 10,000 stands for the normal limit. A symbol one of
    whose values holds more than a sixth of its rows (days without trade, say) has no most likely
    fit: its row is null.
    """
    return _per_series(df, col, _student_t, "n long, df double, loc double, scale double, loglik double")


# Coefficients of Acklam's rational approximation of the inverse
# normal distribution function (relative error below 1.2e-9).
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    middle = q * _poly(INV_A, r) / (_poly(INV_B, r) * r + 1.0)
    tail = F.sqrt(-2.0 * F.ln(F.when(p < 0.5, p).otherwise(1.0 - p)))
    edge = _poly(INV_C, tail) / (_poly(INV_D, tail) * tail + 1.0)
    return F.when((p > 0.02425) & (p < 0.97575), middle).otherwise(F.when(p < 0.5, edge).otherwise(-edge))


def qq_points(df: DataFrame, col: str = "Return") -> DataFrame:
    """Ordered values against normal quantiles at Filliben's plotting positions,
    with the fitted line on every row."""
    known = df.filter(F.col(col).isNotNull()).select(SYMBOL, F.col(col).alias("sample"))
    w = Window.partitionBy(SYMBOL).orderBy("sample")
    i, n = F.row_number().over(w), F.count("*").over(whole(w))
    rows = known.withColumns({"position": i, "_n": n})
    top = F.pow(F.lit(0.5), 1.0 / F.col("_n"))
    spot = (
        F.when(F.col("position") == F.col("_n"), top)
        .when(F.col("position") == 1, 1.0 - top)
        .otherwise((F.col("position") - 0.3175) / (F.col("_n") + 0.365))
    )
    rows = rows.withColumn("theoretical", inverse_normal(spot)).drop("_n")
    per = Window.partitionBy(SYMBOL)
    return rows.withColumns(
        {
            "slope": F.regr_slope("sample", "theoretical").over(per),
            "intercept": F.regr_intercept("sample", "theoretical").over(per),
            "r": F.corr("sample", "theoretical").over(per),
        }
    )


def rolling_shape(df: DataFrame, col: str = "Return", window: int = 63) -> DataFrame:
    """Rolling bias-corrected skewness and excess kurtosis over full windows."""
    known = df.filter(F.col(col).isNotNull())
    t = trailing(window)
    n = F.count(col).over(t).cast("double")
    rows = known.withColumns({"_n": n, "_g": F.skewness(col).over(t), "_k": F.kurtosis(col).over(t)})
    full = F.col("_n") == window
    return rows.select(
        SYMBOL,
        DATE,
        F.when(full, sample_skew(F.col("_g"), F.col("_n"))).alias("skew"),
        F.when(full, sample_kurtosis(F.col("_k"), F.col("_n"))).alias("kurtosis"),
    )


def return_stats(df: DataFrame, col: str = "Return") -> DataFrame:
    """Annualised mean and volatility, corrected skew and kurtosis, extremes."""
    m = df.groupBy(SYMBOL).agg(
        (F.avg(col) * TRADING_DAYS).alias("mean_annual"),
        (F.stddev_samp(col) * ANNUAL).alias("vol_annual"),
        F.skewness(col).alias("_g"),
        F.kurtosis(col).alias("_k"),
        F.count(col).cast("double").alias("_n"),
        F.min(col).alias("min_daily"),
        F.max(col).alias("max_daily"),
    )
    return m.withColumns(
        {
            "skew": sample_skew(F.col("_g"), F.col("_n")),
            "kurtosis": sample_kurtosis(F.col("_k"), F.col("_n")),
        }
    ).drop("_g", "_k", "_n")


def rolling_volatility(df: DataFrame, col: str = "Log_Return", windows=(21, 63, 126)) -> DataFrame:
    """Annualised volatility in percent, full windows only."""
    known = df.filter(F.col(col).isNotNull())
    out = {}
    for n in windows:
        t = trailing(n)
        out[f"HV_{n}"] = F.when(F.count(col).over(t) == n, F.stddev_samp(col).over(t) * ANNUAL * 100)
    return known.withColumns(out)


def mean_by_month(df: DataFrame) -> DataFrame:
    """Mean daily return in percent per month."""
    return df.groupBy(SYMBOL, F.month(DATE).alias("month")).agg((F.avg("Return") * 100).alias("mean_return"))


def mean_by_weekday(df: DataFrame) -> DataFrame:
    """Mean daily return in percent per weekday (0 = Monday)."""
    return df.groupBy(SYMBOL, F.weekday(DATE).alias("weekday")).agg((F.avg("Return") * 100).alias("mean_return"))


def recent_indicators(features: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """The last rows of each symbol with the RSI bands cut at 70 and 30, the sign
    of the MACD histogram and volumes in millions."""
    w = Window.partitionBy(SYMBOL).orderBy(F.col(DATE).desc())
    tail = features.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    keep = [c for c in ("close", "BB_Upper", "BB_Lower", "SMA_50", "SMA_200", "RSI", "MACD", "MACD_Signal", "MACD_Hist") if c in tail.columns]
    return tail.select(
        SYMBOL,
        DATE,
        *keep,
        F.least("RSI", F.lit(70.0)).alias("rsi_upper_clip"),
        F.greatest("RSI", F.lit(30.0)).alias("rsi_lower_clip"),
        (F.col("MACD_Hist") >= 0).cast("int").alias("hist_up"),
        (F.col("volume") / 1e6).alias("volume_m"),
        (F.col("Volume_SMA_20") / 1e6).alias("volume_sma_m"),
    )


def acf(df: DataFrame, col: str = "close", lags: int = 40) -> DataFrame:
    """Autocorrelation at lags 0..``lags`` as (symbol, lag, acf)."""
    known = df.filter(F.col(col).isNotNull())
    rows = known.withColumn("_c", F.col(col) - F.avg(col).over(whole()))
    rows = with_sql(rows, {f"_{k}": sql_lag("_c", k) for k in range(1, lags + 1)})
    terms = ["1D AS `0`"] + [f"sum(_c * _{k}) / nullif(sum(_c * _c), 0D) AS `{k}`" for k in range(1, lags + 1)]
    wide = rows.groupBy(SYMBOL).agg(*[F.expr(t) for t in terms], F.count("*").alias("_n"))
    names = [str(k) for k in range(lags + 1)]
    values = F.expr("array(" + ", ".join(f"named_struct('lag', {c}, 'acf', `{c}`)" for c in names) + ")")
    return wide.select(SYMBOL, F.explode(values).alias("v")).select(SYMBOL, "v.lag", "v.acf")


def pacf(df: DataFrame, col: str = "close", lags: int = 40) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) by the Durbin-Levinson recursion over
    each symbol's short autocorrelation array."""
    pairs = F.sort_array(F.collect_list(F.struct("lag", "acf")))
    rho = acf(df, col, lags).groupBy(SYMBOL).agg(F.transform(pairs, lambda s: s["acf"]).alias("_r"))

    def step(state: Column, k: Column) -> Column:
        phi, r = state["phi"], state["r"]
        m = F.size(phi)
        known = F.when(m > 0, F.zip_with(phi, F.reverse(F.slice(r, 2, m)), lambda a, b: a * b))
        num = F.element_at(r, k + 1) - F.aggregate(F.coalesce(known, F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)
        forward = F.zip_with(phi, F.slice(r, 2, m), lambda a, b: a * b)
        den = 1.0 - F.aggregate(forward, F.lit(0.0), lambda s, v: s + v)
        last = num / nz(den)
        shifted = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(
            F.concat(shifted, F.array(last)).alias("phi"),
            F.concat(state["out"], F.array(last)).alias("out"),
            r.alias("r"),
        )

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"), F.col("_r").alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step)
    return rho.select(SYMBOL, F.posexplode(done["out"]).alias("lag", "pacf"))


def _kpss(x: np.ndarray) -> tuple | None:
    n = len(x)
    e = x - x.mean()
    lags = int(math.floor(12 * (n / 100) ** 0.25))
    past = sum(float(e[j:] @ e[: n - j]) * (1 - j / (lags + 1)) for j in range(1, min(lags, n - 1) + 1))
    variance = (float(e @ e) + 2 * past) / n
    return n, lags, float((np.cumsum(e) ** 2).sum()) / n**2 / variance if variance else None


def kpss(df: DataFrame, col: str = "close") -> DataFrame:
    """Level-stationarity statistic with its interpolated p-value per symbol.

    The long-run variance uses Bartlett weights up to ``12 (n/100)^(1/4)`` lags.
    """
    p = F.lit(KPSS_CRITICAL[-1][0])
    for (p0, s0), (p1, s1) in reversed(list(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]))):
        inside = p0 + (F.col("statistic") - s0) / (s1 - s0) * (p1 - p0)
        p = F.when(F.col("statistic") <= s1, inside).otherwise(p)
    p = F.when(F.col("statistic") <= KPSS_CRITICAL[0][1], KPSS_CRITICAL[0][0]).otherwise(p)
    found = _per_series(df, col, _kpss, "n long, lags int, statistic double")
    return found.withColumn("p_value", F.when(F.col("statistic").isNotNull(), p))


def adf_p_value(statistic: float) -> float:
    """Approximate p-value of the unit-root statistic (constant, no trend)."""
    if statistic > ADF_HIGHEST:
        return 1.0
    if statistic < ADF_LOWEST:
        return 0.0
    terms = ADF_SMALL_P if statistic <= ADF_SWITCH else ADF_LARGE_P
    return NormalDist().cdf(sum(c * statistic**i for i, c in enumerate(terms)))


def _level_regression(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the one after ``skip`` on, and what they are regressed on: the constant,
    the level before, the ``lags`` differences before."""
    d = np.diff(x)
    rows = np.arange(skip, len(d))
    past = [d[rows - k] for k in range(1, lags + 1)]
    return d[rows], np.column_stack([np.ones(len(rows)), x[rows], *past])


def _best_lags(x: np.ndarray, reach: int) -> int:
    """The lag order with the lowest AIC, of all up to ``reach`` on one sample.

    One triangular factor of the widest regression serves every order: leaving the last
    columns out leaves the first rows of the factor as they are.
    """
    y, z = _level_regression(x, reach, reach)
    q = np.linalg.qr(z, mode="r")
    # The part of y that each column adds, by the factor of the columns and y together.
    both = np.linalg.qr(np.column_stack([z, y]), mode="r")[:, -1]
    total = float(y @ y)
    rss = np.maximum(total - np.cumsum(both[: q.shape[1]] ** 2), 1e-300)[1:]
    n = len(y)
    aic = n * np.log(rss / n) + 2 * np.arange(2, reach + 3)
    return int(np.argmin(aic))


def adf(df: DataFrame, col: str = "close", lags: int | None = None) -> DataFrame:
    """Unit-root test with a constant; lag order by AIC on a common sample, or given.

    Orders up to ``12 (n/100)^(1/4)`` are compared, all from one factorisation.
    """

    def test(x: np.ndarray) -> tuple | None:
        reach = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
        if reach < 0:
            return None
        best = _best_lags(x, reach) if lags is None else lags
        y, z = _level_regression(x, best, best)
        if len(y) <= z.shape[1]:
            return None
        inverse = np.linalg.pinv(z.T @ z, hermitian=True)
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        rss, n = float(((y - z @ beta) ** 2).sum()), len(y)
        error = math.sqrt(rss / (n - z.shape[1]) * inverse[1, 1])
        statistic = float(beta[1]) / error if error else math.nan
        critical = [sum(c / n**i for i, c in enumerate(b)) for b in ADF_CRITICAL.values()]
        return n, best, statistic, adf_p_value(statistic), *critical

    levels = ", ".join(f"critical_{k.rstrip('%')} double" for k in ADF_CRITICAL)
    return _per_series(df, col, test, f"n long, lags int, statistic double, p_value double, {levels}")


def correlation_with(df: DataFrame, target: str = "close", cols: list[str] | None = None, top: int = 21) -> DataFrame:
    """Features by absolute correlation with the target, over all rows; the target
    itself comes first. One aggregate row, opened up into (feature, corr)."""
    cols = cols or numeric_columns(df)
    one = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    long = one.unpivot([], cols, "feature", "corr").filter(F.col("corr").isNotNull())
    return long.orderBy(F.abs("corr").desc(), "feature").limit(top)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise correlations as (a, b, corr), from one aggregate over all rows."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("corr")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def split_ranges(df: DataFrame) -> DataFrame:
    """First and last date and rows of each split."""
    return temporal_split(df).groupBy(SYMBOL, "split").agg(
        F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count("*").alias("n_rows")
    )
