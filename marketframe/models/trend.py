"""Trend and seasonality regression on log prices.

The level is a piecewise linear trend (a hinge per changepoint), yearly and
weekly Fourier terms, a holiday effect and optional regressors. The design is an
array column built from the date alone; each symbol is one small ridge fit whose
penalties follow the prior scales, solved from summed cross products. Predictions
are dot products in Spark; ahead of the fitted days their band widens with the
changes of slope that the fit found.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, SYMBOL, Settings
from ..functions.linear import fit_design
from ..functions.windows import dot, series, whole
from ..operators.split import temporal_split
from ..plans.forecast import business_calendar, future_days, latest

CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
INTERVAL = 0.80

# US federal holidays as (month, rule); a rule is a day of the
# month moved to the nearest weekday, or the nth weekday (1 = Monday, -1 = last).
HOLIDAYS = (
    ("New Year's Day", 1, ("day", 1)),
    ("Birthday of Martin Luther King, Jr.", 1, ("nth", 1, 3)),
    ("Washington's Birthday", 2, ("nth", 1, 3)),
    ("Memorial Day", 5, ("nth", 1, -1)),
    ("Juneteenth National Independence Day", 6, ("day", 19)),
    ("Independence Day", 7, ("day", 4)),
    ("Labor Day", 9, ("nth", 1, 1)),
    ("Columbus Day", 10, ("nth", 1, 2)),
    ("Veterans Day", 11, ("day", 11)),
    ("Thanksgiving Day", 11, ("nth", 4, 4)),
    ("Christmas Day", 12, ("day", 25)),
)
FIRST_JUNETEENTH = 2021
HOLIDAY_YEARS = (1999, 2030)


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        shift = F.pmod(F.lit(weekday - 1) - F.weekday(first), F.lit(7))
        return F.date_add(first, shift + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday - 1), F.lit(7)))


def _observed(d: Column) -> Column:
    """A Saturday holiday is kept on Friday, a Sunday one on Monday."""
    wd = F.weekday(d)
    return F.date_add(d, F.when(wd == 5, -1).when(wd == 6, 1).otherwise(0))


def year_holidays(year: Column) -> Column:
    """Array of (holiday, date) of one year, null where a holiday was not kept."""
    out = []
    for name, month, rule in HOLIDAYS:
        if rule[0] == "day":
            d = _observed(F.make_date(year, F.lit(month), F.lit(rule[1])))
        else:
            d = _nth_weekday(year, month, rule[1], rule[2])
        if name.startswith("Juneteenth"):
            d = F.when(year >= FIRST_JUNETEENTH, d)
        out.append(F.struct(F.lit(name).alias("holiday"), d.alias(DATE)))
    return F.array(*out)


def holiday_table(spark, first_year: int = HOLIDAY_YEARS[0], last_year: int = HOLIDAY_YEARS[1]) -> DataFrame:
    """(holiday, name, date) between the first and last day of the given years;
    all days carry one ``holiday`` label, so they share one effect."""
    years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("_y"))
    rows = years.select(F.explode(year_holidays(F.col("_y"))).alias("h")).select("h.*")
    inside = F.year(DATE).between(first_year, last_year)
    return rows.filter(F.col(DATE).isNotNull() & inside).select(
        F.lit("US_market_holiday").alias("holiday"), F.col("holiday").alias("name"), DATE
    )


def is_holiday(d: Column, years: tuple[int, int] = HOLIDAY_YEARS) -> Column:
    """Whether a date is a holiday of the given years, by arithmetic on the date (no join).

    New Year's Day of the next year can be kept on the last day of this one.
    """
    here = F.exists(year_holidays(F.year(d)), lambda h: h[DATE] == d)
    eve = (F.month(d) == 12) & (F.dayofmonth(d) == 31) & (F.weekday(d) == 4)
    return (F.coalesce(here, F.lit(False)) | eve) & F.year(d).between(*years)


def to_regression_frame(df: DataFrame, log: bool = True, regressors: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, ds, y) with the log close; rows without a date or value are dropped."""
    y = F.ln("close") if log else F.col("close")
    cols = [c for c in regressors if c in df.columns]
    out = df.select(SYMBOL, F.col(DATE).alias("ds"), y.alias("y"), *cols)
    return out.filter(F.col("ds").isNotNull() & F.col("y").isNotNull())


def design(t: Column, d: Column, regressors: tuple[str, ...] = ()) -> Column:
    """Design vector at time ``t`` (0 at the first and 1 at the last fitted day)."""
    cols = [F.lit(1.0), t]
    for j in range(1, CHANGEPOINTS + 1):
        cols.append(F.greatest(t - CHANGEPOINT_SHARE * j / CHANGEPOINTS, F.lit(0.0)))
    days = F.unix_date(d).cast("double")
    for period, order in ((365.25, YEARLY_ORDER), (7.0, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            angle = days * (2 * math.pi * k / period)
            cols += [F.sin(angle), F.cos(angle)]
    cols.append(is_holiday(d).cast("double"))
    cols += [F.col(c).cast("double") for c in regressors]
    return F.array(*cols)


def penalties(cfg: Settings = DEFAULTS, n_regressors: int = 0) -> list[float]:
    """Prior scale per design column; the base level and slope are free."""
    seasonal = 2 * (YEARLY_ORDER + WEEKLY_ORDER)
    return (
        [float("inf")] * 2
        + [cfg.changepoint_prior] * CHANGEPOINTS
        + [cfg.seasonality_prior] * seasonal
        + [cfg.holidays_prior]
        + [cfg.holidays_prior] * n_regressors
    )


def _scaled(d: Column, first: Column, last: Column) -> Column:
    span = F.greatest(F.datediff(last, first), F.lit(1))
    return F.datediff(d, first) / span


def fit(
    df: DataFrame,
    log: bool = True,
    regressors: tuple[str, ...] = (),
    cfg: Settings = DEFAULTS,
    keys: tuple[str, ...] = (SYMBOL,),
) -> DataFrame:
    """Parameters per symbol (or per ``keys``): first and last fitted day,
    coefficients, residual deviation and the variance behind the penalties. The
    frame needs ``close`` and ``date``.
    """
    y = F.ln("close") if log else F.col("close")
    w = whole(Window.partitionBy(*keys).orderBy(DATE))
    rows = df.filter(y.isNotNull()).withColumns(
        {"_first": F.min(DATE).over(w), "_last": F.max(DATE).over(w), "_top": F.max(F.abs(y)).over(w)}
    )
    rows = rows.select(
        *keys,
        "_first",
        "_last",
        "_top",
        (y / F.col("_top")).alias("y"),
        design(_scaled(F.col(DATE), F.col("_first"), F.col("_last")), F.col(DATE), regressors).alias("x"),
    )
    beta = fit_design(rows, [*keys, "_first", "_last", "_top"], penalties(cfg, len(regressors)))
    return beta.select(
        *keys,
        F.col("_first").alias("first_fit"),
        F.col("_last").alias("last_fit"),
        "n",
        F.transform("beta", lambda b: b * F.col("_top")).alias("beta"),
        (F.col("sigma") * F.col("_top")).alias("sigma"),
        "noise",
    )


def fit_gap(
    df: DataFrame,
    params: DataFrame,
    log: bool = True,
    regressors: tuple[str, ...] = (),
    cfg: Settings = DEFAULTS,
    keys: tuple[str, ...] = (SYMBOL,),
) -> DataFrame:
    """How well ``params`` solve the penalised normal equations of the rows they were fitted on.

    One row per key: ``n``, ``fitted`` (sum of the fitted values, which a free level makes
    equal to the sum of the observed ones) and ``gap``, the largest entry of
    ``X'(y - X beta) - penalty * beta`` (zero at the minimum).
    """
    y = F.ln("close") if log else F.col("close")
    weight = [0.0 if math.isinf(s) else 1.0 / s**2 for s in penalties(cfg, len(regressors))]
    t = _scaled(F.col(DATE), F.col("first_fit"), F.col("last_fit"))
    rows = df.filter(y.isNotNull()).withColumn("_y", y).join(params, list(keys))
    rows = rows.withColumn("_x", design(t, F.col(DATE), regressors)).withColumn("_f", dot(F.col("_x"), F.col("beta")))
    ridge = F.transform(F.arrays_zip("beta", F.array(*map(F.lit, weight)).alias("w")), lambda b: b["beta"] * b["w"] * F.col("noise"))
    rows = rows.select(*keys, "_f", (F.col("_y") - F.col("_f")).alias("_e"), F.posexplode(F.arrays_zip("_x", ridge.alias("r"))).alias("_j", "_t"))
    entry = F.abs(F.sum(F.col("_t")["_x"] * F.col("_e")) - F.max(F.col("_t")["r"]))
    per = rows.groupBy(*keys, "_j").agg(F.count("*").alias("_n"), F.sum("_f").alias("_f"), entry.alias("_g"))
    return per.groupBy(*keys).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_j") == 0, F.col("_f"))).alias("fitted"), F.max("_g").alias("gap"))


def raw_predictions(
    dates: DataFrame,
    params: DataFrame,
    regressors: tuple[str, ...] = (),
    keys: tuple[str, ...] = (SYMBOL,),
    interval: float = INTERVAL,
) -> DataFrame:
    """Model-space fit and interval for every row of ``dates``, with the trend
    and the additive (season, holiday, regressor) part."""
    return _evaluate(dates.join(params, list(keys)), dates.columns, regressors, interval)


def _evaluate(
    rows: DataFrame, keep: list[str], regressors: tuple[str, ...] = (), interval: float = INTERVAL
) -> DataFrame:
    """Fit and interval of rows that carry their parameters.

    Beyond the last fitted day slopes go on changing as often as changepoints were
    allowed, by independent amounts of mean size ``m``, that of the fitted ones; with a
    two-sided exponential law the level then has the variance
    ``2 m^2 * CHANGEPOINTS * h^3 / 3`` at ``h`` spans of the history ahead.
    """
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    t = _scaled(F.col(DATE), F.col("first_fit"), F.col("last_fit"))
    rows = rows.withColumn("_x", design(t, F.col(DATE), regressors))
    head = 2 + CHANGEPOINTS
    size = F.size("_x")
    trend = dot(F.slice("_x", 1, head), F.slice("beta", 1, head))
    rest = dot(F.slice("_x", F.lit(head + 1), size - head), F.slice("beta", F.lit(head + 1), size - head))
    rows = rows.withColumns({"trend": trend, "additive_terms": rest})
    yhat = F.col("trend") + F.col("additive_terms")
    bend = F.aggregate(F.slice("beta", 3, CHANGEPOINTS), F.lit(0.0), lambda s, b: s + F.abs(b)) / CHANGEPOINTS
    ahead = F.greatest(t - 1, F.lit(0.0))
    spread = F.sqrt(F.col("sigma") * F.col("sigma") + bend * bend * F.pow(ahead, 3) * (2 * CHANGEPOINTS / 3))
    rows = rows.withColumns({"yhat": yhat, "yhat_lower": yhat - z * spread, "yhat_upper": yhat + z * spread})
    names = ("yhat", "yhat_lower", "yhat_upper", "trend", "additive_terms")
    return rows.select(*keep, *names)


def predict(
    params: DataFrame,
    periods: int = DEFAULTS.forecast_days,
    log: bool = True,
    future: DataFrame | None = None,
    regressors: tuple[str, ...] = (),
) -> DataFrame:
    """Forecast after the last fitted day, back in price units.

    A model with regressors needs their values to come: ``future`` holds symbol, date and
    ``regressors``; its first ``periods`` days after the last fitted one are forecast.
    """
    if future is None and regressors:
        raise ValueError("a model with regressors needs their future values")
    if future is None:
        days = F.posexplode(business_calendar(F.col("last_fit"), periods)).alias("_i", DATE)
        rows = params.select("*", days).withColumn("step", F.col("_i") + 1)
    else:
        later = future.select(SYMBOL, DATE, *regressors).join(params, SYMBOL).filter(F.col(DATE) > F.col("last_fit"))
        rows = later.withColumn("step", F.row_number().over(series())).filter(F.col("step") <= periods)
    out = _evaluate(rows, [SYMBOL, "step", DATE], regressors)
    if log:
        out = out.withColumns({c: F.exp(c) for c in ("yhat", "yhat_lower", "yhat_upper")})
    return out


def predict_on_history(df: DataFrame, params: DataFrame) -> DataFrame:
    """In-sample fit in model space, with the residual."""
    out = raw_predictions(df.select(SYMBOL, DATE, "close"), params)
    return out.withColumn("residual", F.ln("close") - F.col("yhat"))


def anchored_one_step(df: DataFrame, log: bool = True) -> DataFrame:
    """One-step prediction anchored on the previous close; needs ``yhat``.

    The model supplies only the expected move from one day to the next.
    """
    w = series()
    prev, move = F.lag("close").over(w), F.col("yhat") - F.lag("yhat").over(w)
    out = df.withColumn("predicted", prev * F.exp(move) if log else prev + move)
    return out.filter(F.col("predicted").isNotNull())


def anchored_path(last: DataFrame, path: DataFrame, log: bool = True) -> DataFrame:
    """Forward path anchored on the latest close.

    ``last`` is one row per symbol (close, yhat on that day); ``path`` holds the
    future rows with yhat and its bounds.
    """
    base = last.select(SYMBOL, F.col("close").alias("_close"), F.col("yhat").alias("_base"))
    rows = path.join(base, SYMBOL)

    def anchored(c: str) -> Column:
        rel = F.col(c) - F.col("_base")
        return F.col("_close") * F.exp(rel) if log else F.col("_close") + rel

    keep = [c for c in ("step",) if c in path.columns]
    return rows.select(
        SYMBOL,
        *keep,
        DATE,
        anchored("yhat").alias("predicted"),
        anchored("yhat_lower").alias("lower"),
        anchored("yhat_upper").alias("upper"),
    )


def forecast_path(df: DataFrame, params: DataFrame, steps: int = DEFAULTS.forecast_days, log: bool = True) -> DataFrame:
    """Path over the next business days from each symbol's latest close."""
    last = raw_predictions(latest(df.select(SYMBOL, DATE, "close")), params)
    return anchored_path(last, raw_predictions(future_days(df, steps), params), log)


def stage_rows(parts: DataFrame) -> DataFrame:
    """The rows each of the two stages is fitted on, marked with its ``stage``."""
    stage = F.explode(
        F.when(F.col("split") == "train", F.array(F.lit("val"), F.lit("test")))
        .when(F.col("split") == "val", F.array(F.lit("test")))
        .otherwise(F.array().cast("array<string>"))
    )
    return parts.withColumn("stage", stage)


def two_stage_predictions(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Validation days from a train fit, test days from a train + validation fit.

    The two fits are one grouped job: each row is given to the stages that may
    see it.
    """
    parts = df if "split" in df.columns else temporal_split(df)
    params = fit(stage_rows(parts), cfg=cfg, keys=(SYMBOL, "stage"))
    # The row before a split is its first anchor.
    r, nt, nv = F.col("row_no"), F.col("n_train"), F.col("n_val")
    which = F.explode(
        F.array_compact(
            F.array(
                F.when((r >= nt - 1) & (r < nt + nv), F.lit("val")),
                F.when(r >= nt + nv - 1, F.lit("test")),
            )
        )
    )
    rows = parts.withColumn("stage", which).select(SYMBOL, "stage", DATE, "close")
    yhat = raw_predictions(rows, params, keys=(SYMBOL, "stage"))
    w = Window.partitionBy(SYMBOL, "stage").orderBy(DATE)
    move = F.col("yhat") - F.lag("yhat").over(w)
    out = yhat.withColumn("predicted", F.lag("close").over(w) * F.exp(move))
    return out.filter(F.col("predicted").isNotNull()).select(SYMBOL, DATE, "predicted")


def cutoff_rows(
    df: DataFrame,
    initial_days: int = DEFAULTS.cv_initial_days,
    period_days: int = DEFAULTS.cv_period_days,
    horizon_days: int = DEFAULTS.cv_horizon_days,
) -> DataFrame:
    """Rows of every cutoff, up to its horizon, marked with ``cutoff``.

    Cutoffs run back from the last day less the horizon in steps of the period,
    as long as the initial span is left. Every row lists its own cutoffs by date
    arithmetic, so no table of cutoffs is joined by range.
    """
    w = whole()
    rows = df.select(SYMBOL, DATE, "close").withColumns({"_f": F.min(DATE).over(w), "_l": F.max(DATE).over(w)})
    newest = F.date_sub("_l", horizon_days)
    oldest = F.date_add("_f", initial_days)
    count = F.floor(F.datediff(newest, oldest) / period_days)
    index = F.explode(F.sequence(F.lit(0), count.cast("int")))
    rows = (
        rows.filter(F.datediff(newest, oldest) >= 0)
        .withColumn("_i", index)
        .withColumn("cutoff", F.expr(f"date_sub(date_sub(_l, {horizon_days}), _i * {period_days})"))
        .filter(F.col(DATE) <= F.date_add("cutoff", horizon_days))
    )
    return rows.select(SYMBOL, "cutoff", DATE, "close")


def cross_validate(
    df: DataFrame,
    initial_days: int = DEFAULTS.cv_initial_days,
    period_days: int = DEFAULTS.cv_period_days,
    horizon_days: int = DEFAULTS.cv_horizon_days,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Rolling-origin validation: errors in model space over the scored rows (``n``) of all cutoffs."""
    rows = cutoff_rows(df, initial_days, period_days, horizon_days)
    keys = (SYMBOL, "cutoff")
    params = fit(rows.filter(F.col(DATE) <= F.col("cutoff")), cfg=cfg, keys=keys)
    ahead = rows.filter(F.col(DATE) > F.col("cutoff"))
    scored = raw_predictions(ahead, params, keys=keys)
    y, e = F.ln("close"), F.ln("close") - F.col("yhat")
    return scored.groupBy(SYMBOL).agg(
        F.countDistinct("cutoff").alias("cutoffs"),
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))) * 100).alias("MAPE"),
    )
