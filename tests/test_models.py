"""Models by recovery of planted parameters and by optimality."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import panel_of, series_of
from marketframe.functions.linear import fit_design
from marketframe.functions.recursion import inverse_filter
from marketframe.models import ar, boosted, ensemble, sequence, trend
from marketframe.operators.split import training_masks
from marketframe.plans import forecast as fc


@pytest.fixture(scope="module")
def arma(spark):
    """Two series whose log returns are AR(1) with 0.6 and MA(1) with 0.5."""
    rng = np.random.default_rng(11)
    idx = pd.bdate_range("2010-01-01", periods=3000)
    parts = []
    for name, phi, theta in (("ar", 0.6, 0.0), ("ma", 0.0, 0.5)):
        e = rng.normal(0, 0.01, 3000)
        z = np.zeros(3000)
        for t in range(1, 3000):
            z[t] = 0.0002 + phi * z[t - 1] + e[t] + theta * e[t - 1]
        parts.append(panel_of(pd.DataFrame({"Close": 50 * np.exp(np.cumsum(z))}, index=idx), name))
    return spark.createDataFrame(pd.concat(parts)).persist()


def test_ar_recovers_planted_values(arma):
    got = {r.symbol: r for r in ar.fit_log(arma, (1, 1, 0), last=None).collect()}
    assert got["ar"].phi[0] == pytest.approx(0.6, abs=0.03)
    assert np.sqrt(got["ar"].sigma2) == pytest.approx(0.01, rel=0.05)
    ma = {r.symbol: r for r in ar.fit_log(arma, (0, 1, 1), last=None).collect()}
    assert ma["ma"].theta[0] == pytest.approx(0.5, abs=0.05)


def innovations(z, const, phi, theta):
    e = np.zeros(len(z))
    for t in range(len(phi), len(z)):
        e[t] = z[t] - const - sum(f * z[t - i] for i, f in enumerate(phi, 1)) - sum(h * e[t - j] for j, h in enumerate(theta, 1) if t >= j)
    return e


@pytest.mark.parametrize("theta", [-0.9, -0.97, 0.95])
def test_strong_moving_averages_are_recovered(theta):
    rng = np.random.default_rng(int(abs(theta) * 100))
    e = rng.normal(0, 1, 3001)
    y = np.cumsum(np.append(0.0, e[1:] + theta * e[:-1]))
    n, const, phi, got, sigma2, aic = ar.css_fit(y, (0, 1, 1), True, 2)
    assert got[0] == pytest.approx(theta, abs=0.02) and sigma2 == pytest.approx(1, rel=0.08)
    # No value near the fitted one does better.
    z = np.diff(y)
    loss = lambda c, h: np.sum(innovations(z, c, [], [h])[1:] ** 2)
    best = loss(const, got[0])
    assert best == pytest.approx(n * sigma2, rel=1e-9)
    assert all(best <= loss(const + a, got[0] + b) + 1e-9 for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3))


def test_mixed_order_is_recovered_and_starts_from_any_sample():
    rng = np.random.default_rng(5)
    e, z = rng.normal(0, 1, 6000), np.zeros(6000)
    for t in range(2, 6000):
        z[t] = 0.1 + 0.6 * z[t - 1] - 0.2 * z[t - 2] + e[t] + 0.5 * e[t - 1] - 0.3 * e[t - 2]
    n, const, phi, theta, *_ = ar.css_fit(z, (2, 0, 2), True, 10)
    assert n == 5990
    one = innovations(z, const, phi, theta)
    assert one[10:] @ one[10:] / n <= np.mean(e[10:] ** 2)
    assert ar.css_fit(z[:5], (2, 0, 2), True, 4) is None


@pytest.mark.parametrize(("n", "q"), [(1, 1), (5, 3), (64, 2), (200, 3), (129, 1)])
def test_block_filter_equals_the_loop(n, q):
    rng = np.random.default_rng(n)
    x, theta, before = rng.normal(size=(n, 2)), rng.uniform(-0.4, 0.4, q), rng.normal(size=(q, 2))
    want = list(before[::-1])
    for t in range(n):
        want.append(x[t] - sum(theta[j] * want[-1 - j] for j in range(q)))
    assert np.allclose(inverse_filter(x, theta, before), want[q:])


def test_recursion_goes_on_from_its_state(spark, arma):
    """One-step values, states and later values equal the loop, whatever the batches."""
    params = spark.createDataFrame(
        [("ar", 2, 1, 1, 9.0, 0.001, [0.4, -0.2], [-0.9], 1.0, 0.0), ("ma", 0, 1, 2, 9.0, 0.0, [], [0.3, 0.2], 1.0, 0.0)], ar.PARAMS
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = ar.one_step_predictions(arma, params).toPandas().sort_values("date")
        cut = sorted(got["date"].unique())[2000]
        half = ar.end_state(arma.filter(F.col("date") < cut), params)
        after = ar.advance(half, arma.filter(F.col("date") >= cut), params)
        moved = {r.symbol: r for r in after.collect()}
        whole = {r.symbol: r for r in ar.end_state(arma, params).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in params.collect():
        mine = got[got["symbol"] == r.symbol]
        y = np.log(mine["close"].to_numpy())
        z = np.diff(y)
        e = innovations(z, r.const, list(r.phi), list(r.theta))
        want = np.exp(y[:-1] + z - e)[max(r.p, 1) :]
        assert np.allclose(mine["predicted"].to_numpy()[1 + max(r.p, 1) :], want, rtol=1e-12) and np.isnan(mine["predicted"].to_numpy()[0])
        for state in (moved[r.symbol], whole[r.symbol]):
            assert state.last_y == pytest.approx(y[-1]) and np.allclose(state["_es"], e[::-1][: r.q]) and np.allclose(state["_zs"][: r.p], z[::-1][: r.p])
    path = ar.forecast(arma, params, 3).filter("symbol = 'ma'").orderBy("step").toPandas()
    e, y = innovations(z, 0.0, [], [0.3, 0.2]), np.log(series_of(arma.filter("symbol = 'ma'"), "close")["close"].to_numpy())
    steps = [0.3 * e[-1] + 0.2 * e[-2], 0.2 * e[-1], 0.0]
    assert np.allclose(np.log(path["predicted"]), y[-1] + np.cumsum(steps))
    assert np.allclose(np.log(path["upper"] / path["predicted"]), 1.959963984540054 * np.sqrt(np.cumsum([1, 1.3**2, 1.5**2])))


def test_ar_fit_equals_least_squares(arma):
    got = {r.symbol: r for r in ar.fit_log(arma, (2, 1, 0), last=500).collect()}
    for symbol, row in got.items():
        y = np.log(series_of(arma.filter(F.col("symbol") == symbol), "close")["close"].to_numpy())[-500:]
        z = np.diff(y)
        x = np.column_stack([np.ones(len(z) - 2), z[1:-1], z[:-2]])
        beta, rss, *_ = np.linalg.lstsq(x, z[2:], rcond=None)
        assert np.allclose([row.const, *row.phi], beta, rtol=1e-6)
        assert row.sigma2 == pytest.approx(rss[0] / len(x))
        assert row.aic == pytest.approx(len(x) * np.log(rss[0] / len(x)) + 6)


def test_order_search_takes_the_lowest_aic(arma):
    orders = [o for o in ar.all_orders() if o[2] == 0]
    rows = ar.fit_orders(arma, orders).collect()
    best = {r.symbol: r for r in ar.auto_fit(arma, orders).collect()}
    for symbol in ("ar", "ma"):
        mine = [r for r in rows if r.symbol == symbol]
        assert len(mine) == len(orders)
        assert best[symbol].aic == min(r.aic for r in mine)
    # AIC values of different sample sizes say nothing about each other.
    full = ar.fit_orders(arma, ar.all_orders()).collect()
    assert len({r.n for r in full}) == 1 and {(r.p, r.d, r.q) for r in full} <= set(ar.all_orders())
    chosen = {r.symbol: r for r in ar.select_order(ar.fit_orders(arma, ar.all_orders())).collect()}
    assert chosen["ar"].aic == min(r.aic for r in full if r.symbol == "ar")


def test_forecast_follows_the_recursion(arma):
    params = ar.fit_log(arma, (2, 1, 0))
    got = ar.forecast(arma, params, 10).filter("symbol = 'ar'").orderBy("step").toPandas()
    p = params.filter("symbol = 'ar'").first()
    y = np.log(series_of(arma.filter("symbol = 'ar'"), "close")["close"].to_numpy())
    z, level, want = list(np.diff(y)), y[-1], []
    psi, sums = [1.0, p.phi[0]], []
    for h in range(10):
        z.append(p.const + p.phi[0] * z[-1] + p.phi[1] * z[-2])
        level += z[-1]
        want.append(np.exp(level))
        psi.append(p.phi[0] * psi[-1] + p.phi[1] * psi[-2])
    for h in range(1, 11):
        sums.append(p.sigma2 * sum(np.sum(psi[:k]) ** 2 for k in range(1, h + 1)))
    assert np.allclose(got["predicted"], want)
    half = 1.959963984540054 * np.sqrt(sums)
    assert np.allclose(np.log(got["upper"]) - np.log(got["predicted"]), half)
    assert (got["date"].map(lambda d: d.weekday()) < 5).all()


def test_one_step_uses_only_the_past(arma):
    params = ar.fit_log(arma, (1, 1, 0))
    before = ar.one_step_predictions(arma, params, terms=1)
    last = arma.agg(F.max("date")).first()[0]
    shocked = arma.withColumn("close", F.when(F.col("date") == last, F.col("close") * 3).otherwise(F.col("close")))
    after = ar.one_step_predictions(shocked, params, terms=1)
    on = lambda df: sorted(r.predicted for r in df.filter(F.col("date") == last).collect())
    assert on(before) == pytest.approx(on(after))


def test_walk_forward_equals_a_fold_loop(spark, arma):
    one = arma.filter("symbol = 'ar'")
    got = ar.walk_forward_cv(one, (1, 1, 0), n_splits=3, horizon=5).first()
    y = series_of(one, "close")["close"].to_numpy()
    first = int(len(y) * 0.6)
    step = (len(y) - first - 5) // 3
    pred, act = [], []
    for i in range(3):
        train = y[: first + i * step]
        z = np.diff(train)
        phi = (z[1:] @ z[:-1]) / (z[:-1] @ z[:-1])
        level, move = train[-1], z[-1]
        for h in range(5):
            move *= phi
            level += move
            pred.append(level)
        act += list(y[first + i * step : first + i * step + 5])
    assert got.MAE == pytest.approx(np.mean(np.abs(np.array(pred) - np.array(act))))


def test_walk_forward_with_moving_average_terms(arma):
    one = arma.filter("symbol = 'ma'")
    got = ar.walk_forward_cv(one, (0, 1, 1), n_splits=2, horizon=5).first()
    flat = ar.walk_forward_cv(one, (0, 1, 0), n_splits=2, horizon=5).first()
    assert 0 < got.MAE < 1.2 * flat.MAE and got.MAE != flat.MAE


@pytest.fixture(scope="module")
def seasonal(spark):
    idx = pd.bdate_range("2012-01-02", periods=2200)
    t = np.arange(2200) / 2200
    week = np.where(idx.dayofweek == 0, 0.02, 0.0)
    year = 0.1 * np.sin(2 * np.pi * idx.dayofyear / 365.25)
    y = 3 + 1.5 * t + year + week + np.random.default_rng(2).normal(0, 0.005, 2200)
    return spark.createDataFrame(panel_of(pd.DataFrame({"Close": np.exp(y)}, index=idx))).persist()


def test_trend_recovers_planted_shape(seasonal):
    params = trend.fit(seasonal)
    hist = series_of(trend.predict_on_history(seasonal, params), "residual", "trend")
    assert hist["residual"].std() < 0.007
    rise = hist["trend"].iloc[-1] - hist["trend"].iloc[0]
    assert rise == pytest.approx(1.5, abs=0.1)


def test_trend_path_is_anchored(seasonal):
    params = trend.fit(seasonal)
    path = trend.forecast_path(seasonal, params, 5).orderBy("step").toPandas()
    last = series_of(seasonal, "close")["close"].iloc[-1]
    assert len(path) == 5 and abs(path["predicted"][0] / last - 1) < 0.06
    assert (path["lower"] < path["predicted"]).all() and (path["predicted"] < path["upper"]).all()
    free = trend.predict(params, 5)
    assert free.count() == 5 and free.filter("yhat_lower < yhat AND yhat < yhat_upper").count() == 5


def test_trend_stages_do_not_look_ahead(seasonal):
    got = trend.two_stage_predictions(seasonal)
    assert got.count() == 2200 - int(2200 * 0.7)
    cut = trend.cross_validate(seasonal).first()
    assert cut.cutoffs > 3 and cut.MAE < 0.2


def test_design_fit_equals_plain_least_squares_however_rows_are_dealt(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6)) @ np.diag([1.0, 10.0, 0.1, 1.0, 1.0, 1e-3])
    beta = np.array([1.0, -0.2, 3.0, 0.0, 0.5, 40.0])
    y = x @ beta + rng.normal(0, 0.1, 4000)
    key = np.where(np.arange(4000) < 3900, "hot", "small")
    rows = pd.DataFrame({"k": key, "x": x.tolist(), "y": y})
    df = spark.createDataFrame(rows).repartition(16)
    got = {r.k: r for r in fit_design(df, ["k"]).collect()}
    for name in ("hot", "small"):
        want = np.linalg.lstsq(x[key == name], y[key == name], rcond=None)[0]
        assert got[name].n == (key == name).sum()
        assert np.allclose(got[name].beta, want, rtol=1e-8, atol=1e-10)
    tight = fit_design(df.filter("k = 'hot'"), ["k"], [1e-6] * 6).first()
    assert np.abs(np.array(tight.beta)[:5]).max() < 0.2 * np.abs(beta).max()
    assert fit_design(df.filter("y IS NULL"), ["k"]).count() == 0


def test_trend_fits_need_no_group_in_python_and_are_minima(seasonal):
    params = trend.fit(seasonal)
    plan = params._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    gap = trend.fit_gap(seasonal, params).first()
    observed = seasonal.agg(F.sum(F.ln("close"))).first()[0]
    assert gap.n == 2200 and gap.gap < 1e-6 and gap.fitted == pytest.approx(observed, abs=1e-6)
    moved = params.withColumn("beta", F.transform("beta", lambda b: b * 1.001))
    assert trend.fit_gap(seasonal, moved).first().gap > 1e-3


def test_trend_band_widens_with_the_bends_of_the_fit(seasonal):
    params = trend.fit(seasonal)
    path = trend.predict(params, 250).orderBy("step").toPandas()
    width = np.log(path["yhat_upper"]) - np.log(path["yhat_lower"])
    assert (np.diff(width) > 0).all()
    one = params.first()
    span = (one.last_fit - one.first_fit).days
    h = (path["date"].iloc[-1] - one.last_fit).days / span
    bend = np.mean(np.abs(one.beta[2:27]))
    # Jumps of slope at the rate of the changepoints, two-sided exponential.
    rng = np.random.default_rng(4)
    ends = [np.sum(rng.laplace(0, bend, n) * (h - rng.uniform(0, h, n))) for n in rng.poisson(25 * h, 60000)]
    want = np.hypot(np.std(ends), one.sigma)
    assert width.iloc[-1] / (2 * 1.2815515655446004) == pytest.approx(want, rel=0.03)


def test_trend_takes_future_regressors(seasonal):
    push = F.when(F.pmod(F.unix_date("date"), F.lit(3)) == 0, 1.0).otherwise(0.0)
    pushed = seasonal.withColumn("push", push).withColumn("close", F.col("close") * F.exp(0.05 * F.col("push")))
    params = trend.fit(pushed, regressors=("push",))
    assert params.first().beta[-1] == pytest.approx(0.05, abs=0.002)
    future = fc.future_days(pushed, 8).withColumn("push", push).unionByName(pushed.select("symbol", "date", "push"), True)
    with_push = trend.predict(params, 6, future=future, regressors=("push",)).toPandas()
    none = trend.predict(params, 6, future=future.withColumn("push", F.lit(0.0)), regressors=("push",)).toPandas()
    both = with_push.merge(none, on=["step", "date"])
    assert sorted(both["step"]) == [1, 2, 3, 4, 5, 6]
    days = (pd.to_datetime(both["date"]) - pd.Timestamp("1970-01-01")).dt.days
    assert np.allclose(np.log(both["yhat_x"] / both["yhat_y"]), np.where(days % 3 == 0, params.first().beta[-1], 0.0))
    with pytest.raises(ValueError):
        trend.predict(params, 6, regressors=("push",))


def test_holidays_equal_the_federal_calendar(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = {d.date() for d in USFederalHolidayCalendar().holidays("1999-01-01", "2030-12-31")}
    table = trend.holiday_table(spark)
    got = {r.date for r in table.collect()}
    assert got == want
    days = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2030-12-31')) AS d")
    marked = {r.d for r in days.filter(trend.is_holiday(F.col("d"))).collect()}
    assert marked == want


# Each model's own error: a constant, a wave, a drift and noise.
ERRORS = {
    "arima": lambda t, r: 0.7 + 0 * t,
    "prophet": lambda t, r: 1.1 * np.sin(t / 2.5),
    "lstm": lambda t, r: 0.04 * (t - t.mean()),
    "xgboost": lambda t, r: r.uniform(-1.6, 1.6, len(t)),
}


def long_predictions(spark, n=45, seed=31):
    rng, t = np.random.default_rng(seed), np.arange(n)
    actual = 25 + 0.3 * t + 2 * np.cos(t / 4)
    days = pd.bdate_range("2022-02-07", periods=n).date
    preds = {m: actual + error(t, rng) for m, error in ERRORS.items()}
    long = pd.concat([pd.DataFrame({"symbol": "A", "date": days, "model": m, "predicted": p}) for m, p in preds.items()])
    bars = pd.DataFrame({"symbol": "A", "date": days, "close": actual})
    return actual, preds, spark.createDataFrame(long), spark.createDataFrame(bars)


def test_weights_are_the_best_on_the_simplex(spark):
    actual, preds, long, bars = long_predictions(spark)
    rows = ensemble.fit_weights(long, bars).collect()
    w = {r.model: r.weight for r in rows}
    assert sum(w.values()) == pytest.approx(1.0) and min(w.values()) >= 0
    score = lambda ws: np.sqrt(np.mean((sum(ws[m] * preds[m] for m in preds) - actual) ** 2))
    assert rows[0].rmse == pytest.approx(score(w))
    grid = [g for g in itertools.product(np.arange(0, 1.01, 0.05), repeat=3) if sum(g) <= 1]
    best = min(score(dict(zip(preds, (*g, 1 - sum(g))))) for g in grid)
    assert score(w) <= best + 1e-9


def test_weights_fall_back_without_a_usable_day(spark):
    _, _, long, bars = long_predictions(spark, 5)
    rows = ensemble.fit_weights(long.filter("model <> 'lstm'"), bars).collect()
    assert not any(r.optimised for r in rows)
    assert {r.model: r.weight for r in rows}["lstm"] == 0.35


def test_blend_uses_the_models_present(spark):
    _, preds, long, bars = long_predictions(spark, 30)
    got = series_of(ensemble.blend(long.filter("model IN ('arima', 'lstm')")), "ensemble", "lower")
    want = (0.15 * preds["arima"] + 0.35 * preds["lstm"]) / 0.5
    assert np.allclose(got["ensemble"], want)
    spread = np.std([preds["arima"], preds["lstm"]], axis=0)
    assert np.allclose(got["lower"], want - 1.96 * spread)
    table = ensemble.ensemble_table(long, actuals=bars)
    assert {"arima", "ensemble", "lower", "upper", "actual"} <= set(table.columns) and table.count() == 30


@pytest.fixture(scope="module")
def tabular(spark):
    """A target with one strong step, one weak slope and one column without effect."""
    rng, n = np.random.default_rng(90), 420
    x = rng.uniform(-1, 1, (n, 3))
    days = pd.bdate_range("2018-01-01", periods=n).date
    pdf = pd.DataFrame({"symbol": "A", "date": days, "close": 40.0, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2]})
    pdf["Target_LogRet"] = np.where(x[:, 0] > 0.1, 4.0, -4.0) - 1.5 * x[:, 1] + rng.normal(0, 0.2, n)
    return training_masks(spark.createDataFrame(pdf)).persist()


def test_boosted_learns_and_ranks_features(spark, tabular):
    cols = ["x0", "x1", "x2"]
    model = boosted.fit(tabular, cols, {"max_depth": 3}, max_iter=15)
    scored = boosted.predict(model, tabular, cols)
    assert scored.count() == 420
    err = scored.agg(F.sqrt(F.avg(F.pow(F.col("r") - F.col("Target_LogRet"), 2)))).first()[0]
    assert err < 2.0
    assert [r.feature for r in boosted.importance(model, cols, spark, 2).collect()] == ["x0", "x1"]
    assert [r.feature for r in boosted.contributions(model, tabular, cols, 2).collect()] == ["x0", "x1"]


def test_search_picks_the_lowest_fold_error(tabular):
    best, table = boosted.search(tabular, ["x0", "x1"], trials=4, folds=3, max_iter=3)
    rows = sorted(table.collect(), key=lambda r: r.rmse)
    whole = [r for r in rows if r.folds == 3]
    assert len(rows) == 4 and len(whole) == 2 and {r.folds for r in rows} == {2, 3}
    assert whole[0].max_depth == best["max_depth"] and whole[0].eta == best["eta"]
    assert boosted.candidates(3) == boosted.candidates(3)
    again = boosted.search(tabular, ["x0", "x1"], trials=4, folds=3, max_iter=3, threads=1)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))


def test_lookback_model_is_null_before_a_full_window(tabular):
    fitted = sequence.fit(tabular, ["x0", "x1"], lookback=5, max_iter=20)
    got = series_of(sequence.predict(fitted, tabular), "r", "Target_LogRet")
    assert got["r"].isna().sum() == 4
    assert got["r"].corr(got["Target_LogRet"]) > 0.8  # a line through a step


def test_recursion_compounds(spark, growth):
    two = growth.unionByName(growth.withColumn("symbol", F.lit("BBB")).withColumn("close", F.col("close") * 2))
    step = lambda frame: frame.select("symbol").distinct().withColumn("r", F.lit(0.01))
    got = fc.recursive_forecast(two, step, steps=3).orderBy("symbol", "step").toPandas()
    last = series_of(growth, "close")["close"].iloc[-1]
    want = last * np.exp(0.01 * np.arange(1, 4))
    assert np.allclose(got["predicted"], np.r_[want, 2 * want])
    assert (got["date"].map(lambda d: d.weekday()) < 5).all()


def test_recursion_treats_a_bad_return_as_zero(growth):
    step = lambda frame: frame.select("symbol").distinct().withColumn("r", F.lit(float("nan")))
    got = fc.recursive_forecast(growth, step, steps=1).first()
    assert got.predicted == pytest.approx(series_of(growth, "close")["close"].iloc[-1])


def test_fan_out_isolates_failures(spark, growth):
    def broken():
        raise RuntimeError("missing")

    good = lambda: fc.future_days(growth, 2).withColumn("predicted", F.lit(1.0))
    late = lambda: good().withColumn("predicted", F.raise_error(F.lit("late")).cast("double"))
    got = fc.forecast_all({"arima": good, "lstm": broken, "xgboost": late}, ["arima", "lstm", "xgboost", "absent"])
    assert {r.model for r in got.collect()} == {"arima"}
    with pytest.raises(RuntimeError):
        fc.forecast_all({"lstm": broken})


def test_document_checks_its_arguments(spark, growth):
    paths = fc.future_days(growth, 7).select("symbol", "date", F.lit("arima").alias("model"), F.lit(1.23456).alias("predicted"))
    for steps, models in ((0, ["arima"]), (253, ["arima"]), (5, ["other"])):
        with pytest.raises(ValueError):
            fc.forecast_document(paths, models, steps)
    doc = fc.forecast_document(paths, ["arima"], 7, history=growth).first()
    assert len(doc.forecasts["arima"]) == 7 and doc.forecasts["arima"][0].predicted == 1.2346
    assert doc.ensemble is None and doc.models_used == ["arima"]
    assert doc.metadata.last_known_date == str(growth.agg(F.max("date")).first()[0])
    both = fc.forecast_document(paths, ["ensemble"], 7, include_ci=False).first()
    assert both.ensemble[0].lower_bound is None and both.models_used == ["ensemble"]
    assert '"ticker":"AAA"' in fc.document_json(fc.forecast_document(paths, ["arima"], 7)).first().json


def test_single_step_range(growth):
    path = fc.future_days(growth, 3).withColumn("predicted", F.lit(2.0))
    assert fc.single_step(path, 3).count() == 1
    with pytest.raises(ValueError):
        fc.single_step(path, 11)


def test_training_end_to_end(spark, growth):
    from marketframe.operators.clean import add_returns
    from marketframe.plans.training import forecast_forward, train

    run = train(add_returns(growth), max_iter=3)
    table = {r.model: r for r in run.test.collect()}
    assert set(table) == {"arima", "prophet", "lstm", "xgboost", "ensemble", "naive_last_close"}
    assert table["naive_last_close"].Sharpe_Ratio is None and table["naive_last_close"].RMSE > 0
    val = {r.model: r.RMSE for r in run.validation.collect()}
    assert val["ensemble"] <= min(v for m, v in val.items() if m != "naive_last_close") + 1e-3
    assert run.features[0] == "Return" and len(run.features) == 61
    ahead = forecast_forward(growth, run, steps=2)
    got = ahead.orderBy("date").collect()
    assert len(got) == 2 and all(r.ci_lower <= r.ensemble <= r.ci_upper for r in got)
