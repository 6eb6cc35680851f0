"""Model queries: autoregression, trend and season, boosting, lookback, ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.config import DEFAULTS, ENSEMBLE_WEIGHTS
from marketframe.functions.storage import materialise
from marketframe.models import ar
from marketframe.models import boosted as bo
from marketframe.models import ensemble as en
from marketframe.models import sequence as sq
from marketframe.models import trend as tr
from marketframe.operators import features as ft
from marketframe.operators import split as sp
from marketframe.operators.permute import permuted
from marketframe.plans import forecast as fc

from . import check
from .bars import BARS, PANEL, bars, panel
from .evaluation import BASE, DAYS_AHEAD, FUTURE, PRED, predictions
from .indicators import SERIES

AR_ROWS = f"""{PANEL},
logs AS (
  SELECT symbol, date, close, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM panel),
recent AS (SELECT *, y - lag(y) OVER {SERIES} AS z FROM logs WHERE back <= 500),
pairs AS (SELECT *, lag(z) OVER {SERIES} AS z1 FROM recent),
params AS MATERIALIZED (
  SELECT symbol, regr_count(z, z1) AS n, regr_slope(z, z1) AS phi, regr_intercept(z, z1) AS const,
         (regr_syy(z, z1) - regr_slope(z, z1) * regr_sxy(z, z1)) / regr_count(z, z1) AS sigma2
  FROM pairs GROUP BY symbol)"""


@check(
    "A1_fit_log",
    "symbol n:i const:6 phi1:6 sigma2:6 aic:3",
    f"WITH {AR_ROWS}, result AS (SELECT symbol, n, const, phi AS phi1, sigma2, n * ln(sigma2) + 4 AS aic FROM params)",
)
def fit_log(spark, sf):
    return ar.fit_log(panel(spark, sf), last=500).withColumn("phi1", F.col("phi")[0])


@check(
    "A1_fit_log_whole",
    "symbol n:i const:6 phi1:6 sigma2:6 aic:3",
    f"WITH {AR_ROWS.replace(' WHERE back <= 500', '')}, result AS (SELECT symbol, n, const, phi AS phi1, sigma2, n * ln(sigma2) + 4 AS aic FROM params)",
)
def fit_log_whole(spark, sf):
    """The same over each symbol's whole history."""
    return ar.fit_log(panel(spark, sf)).withColumn("phi1", F.col("phi")[0])


@check("A2_order_search", "symbol p:i d:i q:i n:i aic:4")
def order_search(spark, sf):
    return ar.auto_fit(panel(spark, sf), last=500)


@check(
    "A3_fit_given_order",
    "symbol n:i phi1:6 phi2:6",
    f"""WITH {PANEL},
d AS (SELECT symbol, date, close - lag(close) OVER {SERIES} AS z FROM panel),
l AS (SELECT symbol, z, lag(z) OVER {SERIES} AS z1, lag(z, 2) OVER {SERIES} AS z2 FROM d),
g AS (SELECT symbol, count(*) AS n, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c,
             sum(z1 * z) AS u, sum(z2 * z) AS v FROM l WHERE z2 IS NOT NULL GROUP BY symbol),
result AS (SELECT symbol, n, (c * u - b * v) / (a * c - b * b) AS phi1, (a * v - b * u) / (a * c - b * b) AS phi2 FROM g)""",
)
def fit_given(spark, sf):
    return ar.fit(panel(spark, sf), (2, 1, 0)).select("symbol", "n", F.col("phi")[0].alias("phi1"), F.col("phi")[1].alias("phi2"))


@check(
    "A4_one_step",
    "symbol date:d predicted:5",
    f"""WITH {AR_ROWS},
l AS (SELECT *, lag(y) OVER {SERIES} AS y1, lag(y, 2) OVER {SERIES} AS y2,
             row_number() OVER {SERIES} - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n_all FROM logs),
result AS (SELECT l.symbol, date, exp(y1 + const + phi * (y1 - y2)) AS predicted
           FROM l JOIN params p ON l.symbol = p.symbol WHERE r >= floor(n_all * 0.7::DOUBLE))""",
)
def one_step(spark, sf):
    parts = sp.temporal_split(panel(spark, sf))
    params = ar.fit_log(panel(spark, sf), last=500)
    return ar.one_step_predictions(parts, params, terms=1, where=F.col("row_no") >= F.col("n_train"))


#: A model with a strong moving average; the recursion of its innovations goes row by row.
MIXED = (0.0001, 0.3, -0.9, 0.0004)
INNOVATIONS = f"""{PANEL},
logs AS (SELECT symbol, date, ln(close) AS y, row_number() OVER {SERIES} AS r FROM panel),
moves AS (SELECT *, y - lag(y) OVER {SERIES} AS z, lag(y) OVER {SERIES} AS y1 FROM logs),
steps AS (
  SELECT symbol, r, date, y, z, 0.0::DOUBLE AS e, NULL::DOUBLE AS predicted FROM moves WHERE r = 2
  UNION ALL
  SELECT m.symbol, m.r, m.date, m.y, m.z, m.z - ({MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * s.z + {MIXED[2]}::DOUBLE * s.e) AS e,
         exp(m.y1 + {MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * s.z + {MIXED[2]}::DOUBLE * s.e) AS predicted
  FROM steps s JOIN moves m ON m.symbol = s.symbol AND m.r = s.r + 1)"""


def mixed_model(df):
    const, phi, theta, sigma2 = (F.lit(v) for v in MIXED)
    return df.select("symbol").distinct().select(
        "symbol", F.lit(1).alias("p"), F.lit(1).alias("d"), F.lit(1).alias("q"), F.lit(0.0).alias("n"), const.alias("const"),
        F.array(phi).alias("phi"), F.array(theta).alias("theta"), sigma2.alias("sigma2"), F.lit(0.0).alias("aic"),
    )


@check(
    "A4_one_step_mixed",
    "symbol date:d predicted:6",
    f"WITH RECURSIVE {INNOVATIONS}, result AS (SELECT symbol, date, predicted FROM steps WHERE predicted IS NOT NULL)",
)
def one_step_mixed(spark, sf):
    """Every row's prediction by a model with a moving average, its innovations followed exactly."""
    bars = panel(spark, sf)
    return ar.one_step_predictions(bars, mixed_model(bars)).filter(F.col("predicted").isNotNull())


@check(
    "A5_forecast_mixed",
    "symbol step:i predicted:5 lower:5",
    f"""WITH RECURSIVE {INNOVATIONS},
ends AS (SELECT symbol, arg_max(y, r) AS y, arg_max(z, r) AS z, arg_max(e, r) AS e FROM steps GROUP BY symbol),
path AS (
  SELECT symbol, 1 AS step, y + {MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * z + {MIXED[2]}::DOUBLE * e AS mean,
         {MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * z + {MIXED[2]}::DOUBLE * e AS z, 1.0::DOUBLE AS psi, 1.0::DOUBLE AS total, 1.0::DOUBLE AS v
  FROM ends
  UNION ALL
  SELECT symbol, step + 1, mean + {MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * z, {MIXED[0]}::DOUBLE + {MIXED[1]}::DOUBLE * z,
         {MIXED[1]}::DOUBLE * psi + CASE step WHEN 1 THEN {MIXED[2]}::DOUBLE ELSE 0 END,
         total + {MIXED[1]}::DOUBLE * psi + CASE step WHEN 1 THEN {MIXED[2]}::DOUBLE ELSE 0 END,
         v + power(total + {MIXED[1]}::DOUBLE * psi + CASE step WHEN 1 THEN {MIXED[2]}::DOUBLE ELSE 0 END, 2)
  FROM path WHERE step < 30),
result AS (SELECT symbol, step, exp(mean) AS predicted,
                  exp(mean - 1.959963984540054::DOUBLE * sqrt({MIXED[3]}::DOUBLE * v)) AS lower FROM path)""",
)
def forecast_mixed(spark, sf):
    bars = panel(spark, sf)
    return ar.forecast(bars, mixed_model(bars), 30)


PATH = f"""{AR_ROWS},
state AS (
  SELECT p.symbol, max(date) AS last_date, arg_max(y, date) AS y, arg_max(z, date) AS z,
         any_value(const) AS c, any_value(phi) AS phi, any_value(sigma2) AS sigma2
  FROM recent r JOIN params p ON r.symbol = p.symbol GROUP BY p.symbol),
h AS (SELECT *, unnest(range(1, 31)) AS step FROM state),
shock AS (SELECT h.*, list_sum([power((1 - power(phi, k)) / (1 - phi), 2) for k in range(1, step + 1)]) AS v FROM h),
path AS (
  SELECT symbol, step, y + step * c / (1 - phi) + (z - c / (1 - phi)) * phi * (1 - power(phi, step)) / (1 - phi) AS mean,
         1.959963984540054::DOUBLE * sqrt(sigma2 * v) AS half FROM shock)"""


@check(
    "A5_forecast",
    "symbol step:i predicted:4 lower:5 upper_log:5",
    f"WITH {PATH}, result AS (SELECT symbol, step, exp(mean) AS predicted, exp(mean - half) AS lower, mean + half AS upper_log FROM path)",
)
def forecast(spark, sf):
    bars = panel(spark, sf)
    return ar.forecast(bars, ar.fit_log(bars, last=500), 30, terms=1).withColumn("upper_log", F.ln("upper"))


@check(
    "A6_update_and_predict",
    "symbol date:d predicted:5",
    f"""WITH {AR_ROWS},
state AS (
  SELECT p.symbol, max(date) AS last_date, arg_max(y, date) AS y0, arg_max(close, date) AS c0,
         any_value(const) AS c, any_value(phi) AS phi
  FROM recent r JOIN params p ON r.symbol = p.symbol GROUP BY p.symbol),
result AS (
  SELECT symbol, last_date + CASE isodow(last_date + 1) WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 2 END AS date,
         exp(ln(c0 * 1.01::DOUBLE) + c + phi * (ln(c0 * 1.01::DOUBLE) - y0)) AS predicted FROM state)""",
)
def update(spark, sf):
    """A new bar one percent above the last close, on the day after it."""
    bars = panel(spark, sf)
    params = ar.fit_log(bars, last=500)
    last = bars.groupBy("symbol").agg(F.max("date").alias("d"), F.max_by("close", "date").alias("c"))
    new = last.select("symbol", F.date_add("d", 1).alias("date"), (F.col("c") * 1.01).alias("close"))
    return ar.update_and_predict(bars, new, params, terms=1)


@check(
    "A2_order_search_short",
    "symbol p:i n:i aic:4",
    f"""WITH {AR_ROWS},
common AS (SELECT * FROM pairs WHERE z1 IS NOT NULL),
fits AS (
  SELECT symbol, 0 AS p, count(*) AS n, count(*) * ln(var_pop(z)) + 2 AS aic FROM common GROUP BY symbol
  UNION ALL
  SELECT symbol, 1 AS p, count(*) AS n,
         count(*) * ln((regr_syy(z, z1) - regr_slope(z, z1) * regr_sxy(z, z1)) / count(*)) + 4 AS aic
  FROM common GROUP BY symbol),
result AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY aic, p) = 1)""",
)
def order_search_short(spark, sf):
    return ar.auto_fit(panel(spark, sf), [(0, 1, 0), (1, 1, 0)], last=500)


@check(
    "A7_walk_forward",
    "symbol MAE:3 RMSE:3 MAPE:4",
    f"""WITH {PANEL},
d AS (SELECT symbol, date, close, close - lag(close) OVER {SERIES} AS z, row_number() OVER {SERIES} - 1 AS r,
             count(*) OVER (PARTITION BY symbol) AS n FROM panel),
l AS (SELECT *, lag(z) OVER {SERIES} AS z1, floor(n * 0.6::DOUBLE) AS f,
             floor((n - floor(n * 0.6::DOUBLE) - 30) / 5) AS s FROM d),
folds AS (SELECT l.*, i, f + i * s AS stop FROM l, range(5) AS x(i)),
phi AS (SELECT symbol, i, sum(z * z1) / sum(z1 * z1) AS phi FROM folds WHERE r < stop AND z1 IS NOT NULL GROUP BY symbol, i),
ends AS (SELECT symbol, i, close AS last, z AS move, stop FROM folds WHERE r = stop - 1),
path AS (
  SELECT a.symbol, a.close AS actual, last + move * phi * (1 - power(phi, a.r - a.stop + 1)) / (1 - phi) AS predicted
  FROM folds a JOIN ends e ON a.symbol = e.symbol AND a.i = e.i JOIN phi p ON a.symbol = p.symbol AND a.i = p.i
  WHERE a.r >= a.stop AND a.r < a.stop + 30),
result AS (SELECT symbol, avg(abs(actual - predicted)) AS MAE, sqrt(avg(power(actual - predicted, 2))) AS RMSE,
                  avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS MAPE FROM path GROUP BY symbol)""",
)
def walk_forward(spark, sf):
    return ar.walk_forward_cv(panel(spark, sf), (1, 1, 0))


@check(
    "T2_regression_frame",
    "symbol ds:d y:8",
    f"WITH {PANEL}, result AS (SELECT symbol, date AS ds, ln(close) AS y FROM panel)",
)
def regression_frame(spark, sf):
    return tr.to_regression_frame(panel(spark, sf))


_NTH = "CAST(date_trunc('month', make_date(y, {m}, 1)) AS DATE) + ((({d} - isodow(make_date(y, {m}, 1))) % 7 + 7) % 7 + {k})::INT"
_DAY = "make_date(y, {m}, {d}) + CASE isodow(make_date(y, {m}, {d})) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END"
_HOLIDAYS = " UNION ALL ".join(
    [f"SELECT {_DAY.format(m=m, d=d)} AS h FROM yrs {'WHERE y >= 2021' if m == 6 else ''}" for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    + [f"SELECT {_NTH.format(m=m, d=d, k=7 * (k - 1))} AS h FROM yrs" for m, d, k in ((1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4))]
    + ["SELECT last_day(make_date(y, 5, 1)) - (isodow(last_day(make_date(y, 5, 1))) - 1)::INT AS h FROM yrs"]
)


@check(
    "T3_holidays",
    "symbol date:d volume:6",
    f"""WITH {BARS}, yrs AS (SELECT unnest(range(1999, 2032)) AS y),
hol AS (SELECT h FROM ({_HOLIDAYS}) WHERE year(h) BETWEEN 1999 AND 2030),
result AS (SELECT symbol, date, volume FROM bars JOIN hol ON date = h)""",
)
def holidays(spark, sf):
    """Bars that fall on a holiday; the calendar is a fixed few hundred rows."""
    return bars(spark, sf).join(F.broadcast(tr.holiday_table(spark)), "date")


@check(
    "T5_anchored_one_step",
    "symbol date:d predicted:5",
    f"""WITH {PANEL},
h AS (SELECT symbol, date, close, 0.001::DOUBLE * date_diff('day', DATE '1995-01-01', date) AS yhat FROM panel),
p AS (SELECT symbol, date, lag(close) OVER {SERIES} * exp(yhat - lag(yhat) OVER {SERIES}) AS predicted FROM h),
result AS (SELECT * FROM p WHERE predicted IS NOT NULL)""",
)
def anchored(spark, sf):
    yhat = 0.001 * F.datediff("date", F.lit("1995-01-01").cast("date"))
    return tr.anchored_one_step(panel(spark, sf).withColumn("yhat", yhat))


@check(
    "T6_anchored_path",
    "symbol step:i date:d predicted:5 lower:5 upper:5",
    f"""WITH {FUTURE},
base AS (SELECT p.symbol, p.close, e.last_date FROM parts p JOIN ends e ON p.symbol = e.symbol AND p.date = e.last_date),
result AS (
  SELECT f.symbol, step, f.date, close * exp(0.001::DOUBLE * (f.date - b.last_date)) AS predicted,
         close * exp(0.001::DOUBLE * (f.date - b.last_date) - 0.1) AS lower,
         close * exp(0.001::DOUBLE * (f.date - b.last_date) + 0.1) AS upper
  FROM future f JOIN base b ON f.symbol = b.symbol)""",
)
def anchored_path(spark, sf):
    df = panel(spark, sf)
    yhat = 0.001 * F.datediff("date", F.lit("1995-01-01").cast("date"))
    last = fc.latest(df).withColumn("yhat", yhat)
    path = fc.future_days(df, 30).withColumns(
        {"yhat": yhat, "yhat_lower": yhat - 0.1, "yhat_upper": yhat + 0.1}
    )
    return tr.anchored_path(last, path)


@check("T1_trend_fit", "symbol n:i sigma:4")
def trend_fit(spark, sf):
    return tr.fit(panel(spark, sf))


@check("T4_trend_predict", "symbol step:i date:d yhat:3 yhat_lower:3 yhat_upper:3")
def trend_predict(spark, sf):
    return tr.predict(tr.fit(panel(spark, sf)), 30)


@check("T7_in_sample", "symbol date:d yhat:4 trend:4 residual:4")
def in_sample(spark, sf):
    df = panel(spark, sf)
    return tr.predict_on_history(df, tr.fit(df))


@check("T8_cross_validation", "symbol cutoffs:i MAE:4 RMSE:4 MAPE:4")
def trend_cv(spark, sf):
    return tr.cross_validate(panel(spark, sf))


@check("T9_two_stage", "symbol date:d predicted:3")
def two_stage(spark, sf):
    return tr.two_stage_predictions(panel(spark, sf))


@check(
    "T1_normal_equations",
    "symbol n:i fitted:5 gap:5",
    f"WITH {PANEL}, result AS (SELECT symbol, count(*) AS n, sum(ln(close)) AS fitted, 0 AS gap FROM panel GROUP BY symbol)",
)
def trend_normal_equations(spark, sf):
    """The fit of T1 is the minimum: no gap in X'(y - X beta) = penalty * beta."""
    df = panel(spark, sf)
    return tr.fit_gap(df, tr.fit(df))


#: Fixed parameters of a trend model; SQL follows the same design day by day.
LEVEL, SLOPE, BEND, SINE, COSINE, HOLIDAY, SIGMA = 4.0123, 0.51371, 0.04177, 0.00313, 0.00217, -0.01019, 0.02


def given_trend(df):
    waves = [c / k for order in (tr.YEARLY_ORDER, tr.WEEKLY_ORDER) for k in range(1, order + 1) for c in (SINE, COSINE)]
    beta = [LEVEL, SLOPE, *[BEND * (-1) ** j for j in range(1, tr.CHANGEPOINTS + 1)], *waves, HOLIDAY]
    return df.filter("close IS NOT NULL").groupBy("symbol").agg(
        F.min("date").alias("first_fit"), F.max("date").alias("last_fit"),
        F.lit(beta).alias("beta"), F.lit(SIGMA).alias("sigma"),
    )


def _waves(period, order):
    angle = f"date_diff('day', DATE '1970-01-01', date) * (2 * pi() * k / {period}::DOUBLE)"
    return f"list_sum([{SINE}::DOUBLE / k * sin({angle}) + {COSINE}::DOUBLE / k * cos({angle}) for k in range(1, {order + 1})])"


def given_sql(days):
    """CTE ``trended`` with the model's parts on the rows of CTE ``days``."""
    return f"""yrs AS (SELECT unnest(range(1999, 2032)) AS y),
hol AS (SELECT DISTINCT h FROM ({_HOLIDAYS}) WHERE year(h) BETWEEN 1999 AND 2030),
span AS (SELECT symbol, min(date) AS a, max(date) AS b FROM panel WHERE close IS NOT NULL GROUP BY symbol),
timed AS (SELECT d.*, (d.date - a)::DOUBLE / greatest(b - a, 1) AS t FROM {days} d JOIN span s ON d.symbol = s.symbol),
trended AS (
  SELECT timed.*, {LEVEL}::DOUBLE + {SLOPE}::DOUBLE * t
         + list_sum([{BEND}::DOUBLE * CASE k % 2 WHEN 0 THEN 1 ELSE -1 END * greatest(t - 0.8::DOUBLE * k / 25, 0) for k in range(1, 26)]) AS trend,
         {_waves(365.25, 10)} + {_waves(7.0, 3)} + CASE WHEN h IS NULL THEN 0 ELSE {HOLIDAY}::DOUBLE END AS rest,
         1.2815515655446004::DOUBLE * sqrt({SIGMA}::DOUBLE * {SIGMA}::DOUBLE
           + {BEND}::DOUBLE * {BEND}::DOUBLE * power(greatest(t - 1, 0), 3) * (50::DOUBLE / 3)) AS half
  FROM timed LEFT JOIN hol ON date = h)"""


@check(
    "T4_given_trend",
    "symbol step:i date:d yhat:5 yhat_lower:5 yhat_upper:5",
    f"""WITH {FUTURE}, {given_sql("future")}, result AS (
  SELECT symbol, step, date, exp(trend + rest) AS yhat, exp(trend + rest - half) AS yhat_lower, exp(trend + rest + half) AS yhat_upper
  FROM trended)""",
)
def given_predict(spark, sf):
    """Thirty days ahead by a given model, with the band that widens."""
    return tr.predict(given_trend(panel(spark, sf)), 30)


@check(
    "T7_given_trend",
    "symbol date:d yhat:6 trend:6 residual:6",
    f"""WITH {PANEL}, {given_sql("panel")},
result AS (SELECT symbol, date, trend + rest AS yhat, trend, ln(close) - trend - rest AS residual FROM trended)""",
)
def given_in_sample(spark, sf):
    df = panel(spark, sf)
    return tr.predict_on_history(df, given_trend(df))


HORIZON, INITIAL, PERIOD = DEFAULTS.cv_horizon_days, DEFAULTS.cv_initial_days, DEFAULTS.cv_period_days
CUTOFFS = f"""{PANEL},
span AS (SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol),
cuts AS (SELECT symbol, unnest(generate_series(0, (b - a - {HORIZON} - {INITIAL}) // {PERIOD})) AS i, b - {HORIZON} AS newest FROM span
         WHERE b - a - {HORIZON} - {INITIAL} >= 0),
cutoffs AS (SELECT symbol, newest - (i * {PERIOD})::INT AS cutoff FROM cuts)"""


@check(
    "T8_normal_equations",
    "symbol cutoff:d n:i fitted:5 gap:5",
    f"""WITH {CUTOFFS}, result AS (
  SELECT c.symbol, cutoff, count(*) AS n, sum(ln(close)) AS fitted, 0 AS gap
  FROM cutoffs c JOIN panel p ON p.symbol = c.symbol AND p.date <= cutoff GROUP BY c.symbol, cutoff)""",
)
def cv_normal_equations(spark, sf):
    """Every cutoff's fit is the minimum over the days up to it, and over no later one."""
    rows = tr.cutoff_rows(panel(spark, sf)).filter("date <= cutoff")
    keys = ("symbol", "cutoff")
    return tr.fit_gap(rows, tr.fit(rows, keys=keys), keys=keys)


@check(
    "T8_scored_rows",
    "symbol cutoffs:i n:i",
    f"""WITH {CUTOFFS}, result AS (
  SELECT c.symbol, count(DISTINCT cutoff) AS cutoffs, count(*) AS n
  FROM cutoffs c JOIN panel p ON p.symbol = c.symbol AND p.date > cutoff AND p.date <= cutoff + {HORIZON} GROUP BY c.symbol)""",
)
def cv_scored_rows(spark, sf):
    return tr.cross_validate(panel(spark, sf))


@check(
    "T9_normal_equations",
    "symbol stage n:i fitted:5 gap:5",
    f"""WITH {PANEL},
l AS (SELECT symbol, close, row_number() OVER {SERIES} - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM panel),
stages AS (SELECT 'val' AS stage, floor(n * 0.7::DOUBLE) AS stop, l.* FROM l
           UNION ALL SELECT 'test', floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE), l.* FROM l),
result AS (SELECT symbol, stage, count(*) AS n, sum(ln(close)) AS fitted, 0 AS gap FROM stages WHERE r < stop GROUP BY symbol, stage)""",
)
def stage_normal_equations(spark, sf):
    """Validation is predicted from training rows alone, test from both."""
    rows = tr.stage_rows(sp.temporal_split(panel(spark, sf)))
    keys = ("symbol", "stage")
    return tr.fit_gap(rows, tr.fit(rows, keys=keys), keys=keys)


@check("N1_fit_weights", "symbol model weight:4 rmse:4")
def fit_weights(spark, sf):
    parts = sp.temporal_split(panel(spark, sf)).filter(F.col("split") == "val")
    return en.fit_weights(predictions(spark, sf, BASE), parts)


_written: dict[tuple[str, str, str], object] = {}


def once(spark, sf, name, make):
    """What ``make`` gives, made once in an application: several queries read it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def marked(spark, sf):
    """All model features with target, split and training marks, and the features' names; written
    once because fits read them many times."""

    def make():
        frame = ft.make_model_frame(panel(spark, sf))
        cols = ft.model_feature_columns(frame)
        kept = frame.select("symbol", "date", "close", *cols)
        return materialise(sp.training_masks(ft.add_target(kept))), cols

    return once(spark, sf, "marked", make)


def boosted(spark, sf):
    """The model of G1, G3 and G4: every feature, depth and rounds as they are by default."""
    return once(spark, sf, "boosted", lambda: bo.fit(*marked(spark, sf)))


@check("G1_boosted_fit", "symbol n:i mean_r:4 std_r:4")
def boosted_fit(spark, sf):
    scored = bo.predict(boosted(spark, sf), *marked(spark, sf))
    return scored.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r")
    )


@check("G2_search", "trial:i eta:6 max_depth:i min_child_weight:i rmse:4 folds:i")
def boosted_search(spark, sf):
    rows, cols = marked(spark, sf)
    _, scores = bo.search(rows.filter("fit_row"), cols)
    return scores


@check("G3_boosted_predict", "symbol date:d predicted:3")
def boosted_predict(spark, sf):
    return ft.next_prices(bo.predict(boosted(spark, sf), *marked(spark, sf)))


@check("G4_importance", "feature importance:4")
def boosted_importance(spark, sf):
    return bo.contributions(boosted(spark, sf), *marked(spark, sf))


@check("G4_permutation_importance", "feature importance:8")
def permutation_importance(spark, sf):
    return bo.permutation_importance(boosted(spark, sf), *marked(spark, sf))


@check(
    "G4_permuted_columns",
    "n:i close:4 close_low:6 close_high:6 volume:2 pairs:i",
    f"""WITH {PANEL}, result AS (
  SELECT count(*) AS n, sum(close) AS close, min(close) AS close_low, max(close) AS close_high, sum(volume) AS volume,
         count(DISTINCT (close, volume)) AS pairs FROM panel)""",
)
def permuted_columns(spark, sf):
    """The values of permuted columns are those of the table, and keep together."""
    close, volume = F.col("_permuted")[0], F.col("_permuted")[1]
    return permuted(panel(spark, sf), ["close", "volume"]).agg(
        F.count("*").alias("n"), F.sum(close).alias("close"), F.min(close).alias("close_low"), F.max(close).alias("close_high"),
        F.sum(volume).alias("volume"), F.count_distinct(close, volume).alias("pairs"),
    )


@check("L1_lookback", "symbol date:d r:4")
def lookback(spark, sf):
    rows, cols = marked(spark, sf)
    return sq.predict(once(spark, sf, "lookback", lambda: sq.fit(rows, cols)), rows)


def _damped(frame):
    """A step model with a closed form: a tenth of the last log return."""
    last = fc.latest(frame.select("symbol", "date", "Log_Return"))
    return last.select("symbol", (F.col("Log_Return") / 10).alias("r"))


RECURSION = f"""{FUTURE},
ret AS (SELECT symbol, date, close, ln(close / lag(close) OVER {SERIES}) AS lr FROM parts),
base AS (SELECT r.symbol, r.close, r.lr FROM ret r JOIN ends e ON r.symbol = e.symbol AND r.date = e.last_date),
recursion AS (
  SELECT f.symbol, f.step, f.date, close * exp(lr * (1 - power(0.1::DOUBLE, f.step)) / 9) AS predicted
  FROM future f JOIN base b ON f.symbol = b.symbol)"""


@check(
    "H1_recursive",
    "symbol step:i date:d predicted:5",
    f"WITH {RECURSION}, result AS (SELECT * FROM recursion)",
)
def recursive(spark, sf):
    return fc.recursive_forecast(panel(spark, sf), _damped)


def _jobs(spark, sf, steps=30):
    """An autoregression, a path anchored on a given steady trend, and a job that fails."""
    df = panel(spark, sf)

    def steady():
        yhat = 0.001 * F.datediff("date", F.lit("1995-01-01").cast("date"))
        bounds = {"yhat": yhat, "yhat_lower": yhat, "yhat_upper": yhat}
        last = fc.latest(df.select("symbol", "date", "close")).withColumn("yhat", yhat)
        return tr.anchored_path(last, fc.future_days(df, steps).withColumns(bounds))

    def broken():
        raise RuntimeError("no such model")

    return {
        "arima": lambda: ar.forecast(df, ar.fit_log(df, last=500), steps, terms=1),
        "prophet": steady,
        "lstm": broken,
    }


FANNED = f"""{PATH},
{DAYS_AHEAD},
fanned AS (
  SELECT f.symbol, f.date, 'arima' AS model, exp(p.mean) AS predicted
  FROM future f JOIN path p ON f.symbol = p.symbol AND f.step = p.step
  UNION ALL
  SELECT f.symbol, f.date, 'prophet' AS model, b.close * exp(0.001::DOUBLE * (f.date - f.last_date)) AS predicted
  FROM future f JOIN panel b ON f.symbol = b.symbol AND f.last_date = b.date)"""


@check(
    "H2_fan_out",
    "symbol date:d model predicted:4",
    f"WITH {FANNED}, result AS (SELECT * FROM fanned)",
)
def fan_out(spark, sf):
    return fc.forecast_all(_jobs(spark, sf))


@check(
    "H4_forecast_table",
    "symbol date:d arima:4 prophet:4 ensemble:4 ci_lower:4 ci_upper:4",
    f"""WITH {FANNED},
w AS (SELECT *, CASE model WHEN 'arima' THEN {ENSEMBLE_WEIGHTS['arima']}::DOUBLE ELSE {ENSEMBLE_WEIGHTS['prophet']}::DOUBLE END AS w FROM fanned),
t AS (SELECT symbol, date, max(predicted) FILTER (model = 'arima') AS arima, max(predicted) FILTER (model = 'prophet') AS prophet,
             sum(w * predicted) / sum(w) AS ensemble, 1.96::DOUBLE * stddev_pop(predicted) AS band FROM w GROUP BY symbol, date),
result AS (SELECT *, ensemble - band AS ci_lower, ensemble + band AS ci_upper FROM t)""",
)
def forecast_table(spark, sf):
    return fc.forecast_table(fc.forecast_all(_jobs(spark, sf)), ["arima", "prophet"])


@check(
    "N1_fit_weights_two",
    "symbol model weight:5 rmse:5",
    f"""WITH {PRED},
e AS (SELECT symbol, arima - actual AS a, lstm - actual AS b FROM pred_wide
      WHERE split = 'val' AND arima IS NOT NULL AND lstm IS NOT NULL),
w AS (SELECT symbol, least(greatest(sum(b * (b - a)) / sum((a - b) * (a - b)), 0), 1) AS w FROM e GROUP BY symbol),
s AS (SELECT e.symbol, any_value(w) AS w, sqrt(avg(power(w * a + (1 - w) * b, 2))) AS rmse
      FROM e JOIN w ON e.symbol = w.symbol GROUP BY e.symbol),
result AS (SELECT symbol, 'arima' AS model, w AS weight, rmse FROM s
           UNION ALL SELECT symbol, 'lstm' AS model, 1 - w AS weight, rmse FROM s)""",
)
def fit_weights_two(spark, sf):
    """Two models have a closed-form optimum on the line between them."""
    parts = sp.temporal_split(panel(spark, sf)).filter(F.col("split") == "val")
    return en.fit_weights(predictions(spark, sf, ("arima", "lstm")), parts, ["arima", "lstm"])


@check(
    "H6_single_step",
    "symbol date:d predicted:4",
    f"WITH {RECURSION}, result AS (SELECT symbol, date, predicted FROM recursion WHERE step = 10)",
)
def single(spark, sf):
    return fc.single_step(fc.recursive_forecast(panel(spark, sf), _damped, steps=10), 10)
