"""Autoregressive moving-average models on log prices, for all symbols at once.

Orders without moving-average terms are estimated by conditional least squares: lags
are window columns, cross products are grouped sums, and one small system per symbol
is solved. With such terms a series is one row's array (it has a value per day), and
the conditional sum of squares is minimised from the two-stage estimate of Hannan and
Rissanen (1982), whose long autoregression grows with the series. A fitted model goes on
from exact state: the last p values and the last q innovations.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, SYMBOL
from ..functions.linear import gram_aggregates, gram_arrays, residual_sum, solve_batch
from ..functions.recursion import expected_levels, inverse_filter, last_states
from ..functions.windows import dot, series, sql_lag, with_sql
from ..operators.metrics import evaluate
from ..plans.forecast import business_calendar, last_rows, next_business_day

Order = tuple[int, int, int]
PARAMS = (
    f"{SYMBOL} string, p int, d int, q int, n double, const double, phi array<double>, "
    "theta array<double>, sigma2 double, aic double"
)


def _level(df: DataFrame, log: bool) -> DataFrame:
    """``_y``: (log) close, with rows that have none removed."""
    y = F.ln("close") if log else F.col("close")
    return df.select(SYMBOL, DATE, *[c for c in ("_seg",) if c in df.columns], y.alias("_y")).filter(
        F.col("_y").isNotNull()
    )


def _differenced(d: int, lag: int = 0) -> Column:
    w = series()
    y = F.lag("_y", lag).over(w) if lag else F.col("_y")
    return y - F.lag("_y", lag + 1).over(w) if d else y


def _invertible(theta: np.ndarray) -> np.ndarray:
    """The moving average with the same autocorrelations whose roots are all inside the
    unit circle; roots on it are moved just inside."""
    roots = np.roots(np.r_[1.0, theta])
    if not len(roots) or np.max(np.abs(roots)) < 1:
        return theta
    outside = np.abs(roots) >= 1
    roots = np.where(outside, 1 / np.conj(np.where(outside, roots, 1)), roots)
    size = np.maximum(np.abs(roots), 1e-300)
    roots = roots * np.minimum(1, (1 - 1e-6) / size)
    return np.real(np.poly(roots))[1:]


def _solve_orders(orders: list[Order], lags: int, trend: bool, keys: list[str]):
    """Fit every order without moving-average terms from one set of cross products per key and d."""
    head = 1 if trend else 0
    width = head + lags

    def solve(batches):
        for pdf in batches:
            rows = []
            for p, d, q in orders:
                sub = pdf[(pdf["d"] == d) & (pdf["n"] > head + p)]
                if not len(sub):
                    continue
                n, yy, k = sub["n"].to_numpy(), sub["yy"].to_numpy(), head + p
                xy = np.array(sub["xy"].tolist(), dtype=float).reshape(len(sub), width)[:, :k]
                xx = np.array(sub["xx"].tolist(), dtype=float).reshape(len(sub), width, width)[:, :k, :k]
                beta = solve_batch(xx, xy) if k else np.zeros((len(n), 0))
                rss = residual_sum(xx, xy, yy, beta) if k else yy
                aic = n * np.log(np.maximum(rss, 1e-300) / n) + 2 * k
                for i, key in enumerate(sub[keys].itertuples(index=False)):
                    const = float(beta[i, 0]) if trend else 0.0
                    rows.append((*key, p, d, q, n[i], const, beta[i, head:].tolist(), [], rss[i] / n[i], aic[i]))
            names = "p d q n const phi theta sigma2 aic".split()
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return solve


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    """The values 1 to ``k`` places earlier as columns, 0 before the start."""
    return np.column_stack([np.append(np.zeros(i), x[: len(x) - i]) for i in range(1, k + 1)]) if k else np.zeros((len(x), 0))


def _long_residuals(z: np.ndarray, trend: bool) -> np.ndarray:
    """Residuals of an autoregression whose order grows with the series; 0 where it has no full past."""
    m = int(min(np.ceil(12 * (len(z) / 100) ** 0.25), len(z) // 4))
    x = np.column_stack([np.ones(len(z)), _lagged(z, m)])[:, 0 if trend else 1 :]
    beta = np.linalg.lstsq(x[m:], z[m:], rcond=None)[0]
    return np.append(np.zeros(m), z[m:] - x[m:] @ beta)


#: Newton steps at most, and the relative gain below which they end.
STEPS, GAIN = 50, 1e-10


def css_fit(y: np.ndarray, order: Order, trend: bool, start: int) -> tuple | None:
    """``n, const, phi, theta, sigma2, aic`` of one series: the conditional sum of squares
    over the rows from ``start`` on is minimised by Gauss and Newton's steps.

    Innovations are 0 until p values are there. Their slopes in all parameters follow
    the same recursion as they do, so each step is one pass over the series.
    """
    p, d, q = order
    z = np.diff(y) if d else y
    used = slice(start - d, None)
    head, size = int(trend), len(z[used])
    k = head + p + q
    if start - d < p or size <= k:
        return None
    x = np.column_stack([np.ones(len(z)), _lagged(z, p)])[:, 1 - head :]

    def residuals(beta: np.ndarray) -> tuple[np.ndarray, float]:
        u = z - x @ beta[: head + p]
        u[:p] = 0.0
        e = inverse_filter(u, beta[head + p :])
        return e, float(e[used] @ e[used])

    first = np.column_stack([x, _lagged(_long_residuals(z, trend), q)])
    beta = np.linalg.lstsq(first[used], z[used], rcond=None)[0]
    beta[head + p :] = _invertible(beta[head + p :])
    e, rss = residuals(beta)
    for _ in range(STEPS):
        theta = beta[head + p :]
        slopes = np.column_stack([x, _lagged(e, q)])
        slopes[:p] = 0.0
        slopes = inverse_filter(slopes, theta)
        step = np.linalg.lstsq(slopes[used], e[used], rcond=None)[0]
        part = 1.0
        while part > 1e-4:
            tried = beta + part * step
            tried[head + p :] = _invertible(tried[head + p :])
            e_tried, rss_tried = residuals(tried)
            if rss_tried < rss:
                break
            part /= 2
        else:
            break
        gain, beta, e, rss = rss - rss_tried, tried, e_tried, rss_tried
        if gain <= GAIN * rss:
            break
    aic = size * np.log(max(rss, 1e-300) / size) + 2 * k
    const = float(beta[0]) if trend else 0.0
    return float(size), const, beta[head : head + p].tolist(), beta[head + p :].tolist(), rss / size, aic


def fit_orders(
    df: DataFrame,
    orders: list[Order],
    log: bool = True,
    last: int | None = None,
    trend: bool = True,
) -> DataFrame:
    """One parameter row per symbol and order.

    All orders are fitted on one sample per symbol, the rows where the longest lag of any
    order exists, so their AIC values are comparable. Those without moving-average
    terms share their cross products: one aggregate per symbol and d. The others
    take each symbol's levels as one array. ``last`` limits the fit to the latest rows
    of each symbol; by default the whole history counts.
    """
    rows = _level(last_rows(df, last) if last else df, log)
    start = max(p for p, _, _ in orders) + max(q for _, _, q in orders) + max(d for _, d, _ in orders)
    plain, moving = [o for o in orders if not o[2]], [o for o in orders if o[2]]
    parts = []
    if plain:
        parts.append(_gram_orders(rows, plain, trend, start))
    if moving:
        levels = F.transform(F.array_sort(F.collect_list(F.struct(DATE, "_y"))), lambda r: r["_y"])
        series_rows = rows.groupBy(SYMBOL).agg(levels.alias("y"))

        def solve(batches):
            for pdf in batches:
                out = []
                for symbol, y in zip(pdf[SYMBOL], pdf["y"]):
                    fits = [(o, css_fit(np.asarray(y, float), o, trend, start)) for o in moving]
                    out += [(symbol, *o, *f) for o, f in fits if f is not None]
                names = "p d q n const phi theta sigma2 aic".split()
                yield pd.DataFrame(out, columns=[SYMBOL, *names])

        parts.append(series_rows.mapInPandas(solve, PARAMS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _gram_orders(rows: DataFrame, orders: list[Order], trend: bool, start: int) -> DataFrame:
    lags = max(p for p, _, _ in orders)
    ds = sorted({d for _, d, _ in orders})
    w = series()
    rows = rows.withColumns({"_r": F.row_number().over(w) - 1, **{f"_z{d}": _differenced(d) for d in ds}})
    names = {d: [f"_z{d}_{i}" for i in range(1, lags + 1)] for d in ds}
    lagged = {c: sql_lag(c.rpartition("_")[0], int(c.rpartition("_")[2])) for d in ds for c in names[d]}
    rows = with_sql(rows, lagged) if lagged else rows
    sums: dict[str, Column] = {}
    for d in ds:
        xs = (["1D"] if trend else []) + names[d]
        sums |= gram_aggregates(xs, f"_z{d}", f"_r >= {start}", f"d{d}_")
    size = int(trend) + lags
    packed = [F.struct(F.lit(d).alias("d"), *gram_arrays(size, f"d{d}_")) for d in ds]
    grams = (
        rows.groupBy(SYMBOL)
        .agg(*[c.alias(n) for n, c in sums.items()])
        .select(SYMBOL, F.explode(F.array(*packed)).alias("g"))
        .select(SYMBOL, "g.*")
    )
    return grams.mapInPandas(_solve_orders(orders, lags, trend, [SYMBOL]), PARAMS)


def fit(df: DataFrame, order: Order, log: bool = False, trend: bool = False, last: int | None = None) -> DataFrame:
    """Fit a given order, by default on the price itself without a constant."""
    return fit_orders(df, [order], log, last, trend)


def fit_log(df: DataFrame, order: Order = (1, 1, 0), last: int | None = None) -> DataFrame:
    """Fit a given order on log prices (of the ``last`` rows if given), with drift (or a
    constant when nothing is differenced)."""
    return fit_orders(df, [order], True, last, True)


def all_orders() -> list[Order]:
    return [
        (p, d, q)
        for p in range(DEFAULTS.ar_max_p + 1)
        for d in range(DEFAULTS.ar_max_d + 1)
        for q in range(DEFAULTS.ar_max_q + 1)
    ]


def select_order(candidates: DataFrame) -> DataFrame:
    """The parameter row with the lowest AIC per symbol."""
    best = candidates.groupBy(SYMBOL).agg(
        F.min_by(F.struct(*[c for c in candidates.columns if c != SYMBOL]), F.struct("aic", "p", "d", "q")).alias("_b")
    )
    return best.select(SYMBOL, "_b.*")


def auto_fit(
    df: DataFrame, orders: list[Order] | None = None, log: bool = True, last: int | None = None
) -> DataFrame:
    """Order search by AIC over the full grid, one pass per d."""
    return select_order(fit_orders(df, orders or all_orders(), log, last))


def _with_model(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params.select(SYMBOL, "d", "const", "phi", "theta"), SYMBOL)


def one_step_predictions(
    df: DataFrame, params: DataFrame, terms: int | None = None, log: bool = True, where: Column | None = None
) -> DataFrame:
    """Predicted price of each row from the rows before it, parameters frozen.

    Innovations are followed along each series. Where no model has moving-average terms,
    ``terms`` may name the largest p: then the past is a window of so many rows.
    ``where`` limits the rows that come out, not the rows looked at.
    """
    keep = [c for c in df.columns if c not in (SYMBOL, DATE)]
    rows = df.withColumn("_y", F.ln("close") if log else F.col("close"))
    if terms is None:
        rows = expected_levels(_with_model(rows, params))
        rows = rows if where is None else rows.filter(where)
        return rows.select(SYMBOL, DATE, *keep, (F.exp("_next") if log else F.col("_next")).alias("predicted"))
    rows = rows.withColumn("_dy", F.col("_y") - F.lag("_y").over(series()))
    before = series().rowsBetween(-terms, -1)
    rows = rows.withColumns(
        {
            "_zs": F.reverse(F.collect_list("_dy").over(before)),
            "_ys": F.reverse(F.collect_list("_y").over(before)),
            "_prev": F.lag("_y").over(series()),
        }
    )
    rows = _with_model(rows if where is None else rows.filter(where), params)
    z = F.when(F.col("d") == 1, F.col("_zs")).otherwise(F.col("_ys"))
    k = F.least(F.size("phi"), F.size(z))
    step = F.col("const") + F.when(k > 0, dot(F.slice("phi", 1, k), F.slice(z, 1, k))).otherwise(0.0)
    level = F.when(F.col("d") == 1, F.col("_prev")).otherwise(0.0) + step
    enough = F.col("_prev").isNotNull() & (F.size(z) >= F.least(F.size("phi"), F.lit(1)))
    out = rows.withColumn("predicted", F.when(enough, F.exp(level) if log else level))
    return out.select(SYMBOL, DATE, *keep, "predicted")


def end_state(df: DataFrame, params: DataFrame, log: bool = True, terms: int | None = None) -> DataFrame:
    """Where each symbol's model stands behind its last row: ``last_date, last_y``, the last
    values ``_zs`` and innovations ``_es``, newest first. ``terms`` as in
    :func:`one_step_predictions`."""
    y = F.ln("close") if log else F.col("close")
    if terms is None:
        rows = df.select(SYMBOL, DATE, y.alias("_y")).filter(F.col("_y").isNotNull())
        return last_states(_with_model(rows, params))
    tail = last_rows(df, terms + 1).withColumn("_y", y)
    tail = tail.withColumn("_dy", F.col("_y") - F.lag("_y").over(series()))
    newest = lambda c: F.transform(
        F.reverse(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(DATE, F.col(c).alias("v")))))),
        lambda s: s["v"],
    )
    ends = tail.groupBy(SYMBOL).agg(
        F.max(DATE).alias("last_date"), F.max_by("_y", DATE).alias("last_y"), newest("_dy").alias("_zs"), newest("_y").alias("_ys")
    )
    values = F.when(F.col("d") == 1, F.col("_zs")).otherwise(F.col("_ys"))
    none = F.array().cast("array<double>").alias("_es")
    return ends.join(params.select(SYMBOL, "d"), SYMBOL).select(SYMBOL, "last_date", "last_y", values.alias("_zs"), none)


def advance(state: DataFrame, new_bars: DataFrame, params: DataFrame, log: bool = True) -> DataFrame:
    """The state of every symbol of ``new_bars`` behind its new rows; a symbol without a state
    starts with them."""
    y = F.ln("close") if log else F.col("close")
    rows = new_bars.select(SYMBOL, DATE, y.alias("_y")).filter(F.col("_y").isNotNull())
    rows = rows.join(state.select(SYMBOL, "last_y", "_zs", "_es"), SYMBOL, "left")
    return last_states(_with_model(rows, params))


def _path(const: Column, phi: Column, theta: Column, values: Column, innovations: Column, steps: int) -> Column:
    """The next ``steps`` values of ``z``; values and innovations are newest first, and
    innovations to come are 0."""
    both = F.struct(values.alias("z"), innovations.alias("e"))

    def weighted(weights: Column, past: Column) -> Column:
        k = F.least(F.size(weights), F.size(past))
        return F.when(k > 0, dot(F.slice(weights, 1, k), F.slice(past, 1, k))).otherwise(0.0)

    def grow(acc: Column, _: Column) -> Column:
        value = const + weighted(phi, acc["z"]) + weighted(theta, acc["e"])
        return F.struct(F.concat(F.array(value), acc["z"]).alias("z"), F.concat(F.array(F.lit(0.0)), acc["e"]).alias("e"))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), both, grow, lambda acc: acc["z"])
    return F.reverse(F.slice(grown, 1, steps))


def _running_sum(values: Column) -> Column:
    return F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))),
    )


def forecast_from(state: DataFrame, params: DataFrame, steps: int, alpha: float = 0.05, log: bool = True) -> DataFrame:
    """Path from a state table; see :func:`forecast`."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    drop = [c for c in ("p", "q", "n", "aic") if c in params.columns]
    rows = state.join(params.drop(*drop), [c for c in (SYMBOL, "fold") if c in state.columns and c in params.columns])
    zero = F.lit(0.0)
    diff = F.col("d") == 1
    model = F.col("phi"), F.col("theta")
    one = F.array(F.lit(1.0))
    rows = rows.withColumns(
        {
            "_zpath": _path(F.col("const"), *model, F.col("_zs"), F.col("_es"), steps),
            # Response of z to one shock: the same recursion from the shock alone.
            "_psi": F.concat(one, _path(zero, *model, one, one, steps)),
        }
    )
    rows = rows.withColumns(
        {
            "_level": F.when(diff, F.transform(_running_sum(F.col("_zpath")), lambda v: v + F.col("last_y"))).otherwise(
                F.col("_zpath")
            ),
            "_resp": F.when(diff, _running_sum(F.col("_psi"))).otherwise(F.col("_psi")),
        }
    )
    rows = rows.withColumn(
        "_var", _running_sum(F.transform(F.slice("_resp", 1, steps), lambda v: v * v * F.col("sigma2")))
    )
    keys = [c for c in (SYMBOL, "fold", "last_date", "_next") if c in rows.columns]
    out = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("_level").alias("level"), F.col("_var").alias("var"))).alias("_i", "v"))
    mean, half = F.col("v.level"), z * F.sqrt("v.var")
    back = F.exp if log else (lambda c: c)
    return out.select(
        *keys,
        (F.col("_i") + 1).alias("step"),
        back(mean).alias("predicted"),
        back(mean - half).alias("lower"),
        back(mean + half).alias("upper"),
    )


def forecast(df: DataFrame, params: DataFrame, steps: int = DEFAULTS.forecast_days, alpha: float = 0.05, log: bool = True, terms: int | None = None) -> DataFrame:
    """Forecast path with its (1 - alpha) interval and the dates it falls on."""
    path = forecast_from(end_state(df, params, log, terms), params, steps, alpha, log)
    day = F.element_at(business_calendar(F.col("last_date"), steps), F.col("step"))
    return path.withColumn(DATE, day).drop("last_date")


def predict_next(state: DataFrame, params: DataFrame, log: bool = True) -> DataFrame:
    """The next value of each symbol and the business day it falls on."""
    return forecast_from(state, params, 1, log=log).select(
        SYMBOL, next_business_day(F.col("last_date")).alias(DATE), "predicted"
    )


def update_and_predict(history: DataFrame, new_bars: DataFrame, params: DataFrame, log: bool = True, terms: int | None = None) -> DataFrame:
    """Append new observations without refitting and predict the next value.

    With ``terms``, ``history`` needs only the last rows of each symbol: ``terms`` plus one.
    """
    cols = [SYMBOL, DATE, "close"]
    rows = history.select(*cols).unionByName(new_bars.select(*cols))
    return predict_next(end_state(rows, params, log, terms), params, log)


FOLD_PARAMS = PARAMS.replace(f"{SYMBOL} string,", f"{SYMBOL} string, fold int,")


def _fold_totals(rows: DataFrame, order: Order, lags: list[str], n_splits: int) -> DataFrame:
    """Parameters per fold from running totals of cross products."""
    p, d, _ = order
    # First fold whose training part holds the row: row < first + fold * step.
    ahead = F.floor((F.col("_r") - F.col("_first")) / F.col("_step")) + 1
    sums = gram_aggregates(lags, "_z")
    seg = (
        rows.withColumn("fold", F.greatest(F.lit(0), ahead).cast("int"))
        .filter(F.col("fold") < n_splits)
        .groupBy(SYMBOL, "fold")
        .agg(*[c.alias(k) for k, c in sums.items()])
    )
    upto = Window.partitionBy(SYMBOL).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumns({k: F.sum(k).over(upto) for k in sums})
    grams = seg.select(SYMBOL, "fold", F.lit(d).alias("d"), *gram_arrays(p))
    return grams.mapInPandas(_solve_orders([order], p, False, [SYMBOL, "fold"]), FOLD_PARAMS)


def _fold_copies(rows: DataFrame, order: Order, n_splits: int) -> tuple[DataFrame, DataFrame]:
    """Parameters and end state per fold from one copy of the training rows per fold."""
    copies = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    copies = copies.filter(F.col("_r") < F.col("_first") + F.col("fold") * F.col("_step"))
    named = copies.select(F.concat_ws("\u0001", SYMBOL, "fold").alias(SYMBOL), DATE, "close")
    fitted = fit_orders(named, [order], log=False, last=None, trend=False)
    parts = F.split(SYMBOL, "\u0001")
    folds = lambda df: df.withColumns({"fold": parts[1].cast("int"), SYMBOL: parts[0]})
    return folds(fitted), folds(end_state(named, fitted, log=False).drop("last_date"))


def walk_forward_cv(df: DataFrame, order: Order, n_splits: int = 5, horizon: int = 30) -> DataFrame:
    """Expanding-window validation on prices; metrics pooled over the folds.

    Training sets are nested, so each row is summed once, into the first fold
    that sees it, and a running total over folds gives every fold's cross
    products: the rows are not copied per fold. Only moving-average terms, whose
    innovations differ from fold to fold, need a copy per fold.
    """
    p, d, q = order
    n, r = F.col("_n"), F.col("_r")
    w = series()
    rows = df.select(SYMBOL, DATE, "close").withColumns(
        {"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    )
    first = F.floor(n * F.lit(0.6))
    step = F.floor((n - first - horizon) / n_splits)
    rows = rows.withColumns({"_first": first, "_step": step}).filter(F.col("_step") > 0)
    rows = rows.withColumn("_y", F.col("close"))
    rows = rows.withColumn("_z", _differenced(d))
    lags = {f"_z{i}": F.lag("_z", i).over(w) for i in range(1, p + 1)}
    rows = rows.withColumns(lags)
    past = series().rowsBetween(1 - max(p, 1), 0)
    rows = rows.withColumns(
        {"_zs": F.reverse(F.collect_list("_z").over(past)), "_next": F.collect_list("close").over(series().rowsBetween(1, horizon))}
    )
    # The last row of each training part, with the closes that follow it.
    number = (r + 1 - F.col("_first")) / F.col("_step")
    ends = rows.withColumn("fold", number.cast("int")).filter((number == F.col("fold")) & F.col("fold").between(0, n_splits - 1))
    state = ends.select(SYMBOL, "fold", F.col("_y").alias("last_y"), "_zs", F.array().cast("array<double>").alias("_es"), "_next")
    if q:
        params, exact = _fold_copies(rows, order, n_splits)
        state = state.drop("last_y", "_zs", "_es").join(exact, [SYMBOL, "fold"])
    else:
        params = _fold_totals(rows, order, list(lags), n_splits)
    path = forecast_from(state, params, horizon, log=False)
    actual = F.try_element_at("_next", F.col("step"))
    # Folds follow one another; a running number keeps the pooled order.
    place = F.col("fold") * horizon + F.col("step")
    scored = path.select(SYMBOL, place.alias(DATE), actual.alias("actual"), "predicted")
    return evaluate(scored, keys=(SYMBOL,), previous=None)


def refit_selected(df: DataFrame, chosen: DataFrame, log: bool = True, last: int | None = None) -> DataFrame:
    """Refit each symbol with the order chosen for it before; only orders that some
    symbol has (at most the grid's) are fitted."""
    keys = [SYMBOL, "p", "d", "q"]
    orders = [tuple(r) for r in chosen.select("p", "d", "q").distinct().orderBy("p", "d", "q").collect()]
    if not orders:
        return chosen.limit(0)
    return fit_orders(df, orders, log, last).join(chosen.select(*keys), keys, "left_semi")
