"""Training and batch forecast: load, clean, features, models, blend, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, SYMBOL, Settings
from ..functions.storage import materialise
from ..models import ar, boosted, ensemble, sequence, trend
from ..operators.features import (
    add_target,
    build_feature_set,
    model_feature_columns,
    next_prices,
)
from ..operators.metrics import actual_vs_predicted, evaluate_split
from ..operators.split import training_masks
from .forecast import forecast_all, forecast_table, recursive_forecast

MODELS = ("arima", "prophet", "lstm", "xgboost")


@dataclass
class TrainingRun:
    """Fitted models and tables of one run; every table is a lazy DataFrame."""

    frame: DataFrame
    features: list[str]
    predictions: DataFrame
    weights: DataFrame | None
    validation: DataFrame
    test: DataFrame
    test_forecast: DataFrame
    models: dict[str, object]


def train(
    clean_bars: DataFrame,
    models: tuple[str, ...] = MODELS,
    cfg: Settings = DEFAULTS,
    max_iter: int = 100,
    trials: int = 0,
) -> TrainingRun:
    """Fit every requested model and score it one step ahead on both later splits.

    The feature frame is written once: every model reads it, and
    a lost executor does not send the run back to the raw bars. ``trials`` above
    zero turns on the hyper-parameter search of the boosted model.
    """
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}, choose from {MODELS}")
    frame = materialise(training_masks(add_target(build_feature_set(clean_bars, cfg))))
    cols = model_feature_columns(frame.drop("Target_LogRet"))
    later = F.col("row_no") >= F.col("n_train")
    fitted: dict[str, object] = {}
    parts: dict[str, DataFrame] = {}

    if "arima" in models:
        best = ar.auto_fit(frame.filter(~later))
        parts["arima"] = ar.one_step_predictions(
            frame.select(SYMBOL, DATE, "close", "row_no", "n_train"), best, where=later
        )
        fitted["arima"] = best
    if "prophet" in models:
        parts["prophet"] = trend.two_stage_predictions(
            frame.select(SYMBOL, DATE, "close", "split", "row_no", "n_train", "n_val"), cfg
        )
        fitted["prophet"] = trend.fit(frame, cfg=cfg)
    if "lstm" in models:
        lookback = sequence.fit(frame, cols, cfg.lookback, max_iter)
        parts["lstm"] = next_prices(sequence.predict(lookback, frame))
        fitted["lstm"] = lookback
    if "xgboost" in models:
        params = {}
        if trials:
            fit_rows = frame.filter(F.col("fit_row"))
            params, _ = boosted.search(fit_rows, cols, trials, cfg.search_folds, max_iter)
        gbt = boosted.fit(frame, cols, params, max_iter)
        parts["xgboost"] = next_prices(boosted.predict(gbt, frame, cols))
        fitted["xgboost"] = gbt

    days = frame.filter(later).select(SYMBOL, DATE)
    base = None
    for name, part in parts.items():
        rows = part.select(SYMBOL, DATE, F.lit(name).alias("model"), "predicted").join(days, [SYMBOL, DATE])
        base = rows if base is None else base.unionByName(rows)
    base = materialise(base.filter(F.col("predicted").isNotNull()))

    predictions, weights = base, None
    if len(parts) > 1:
        val = frame.filter(F.col("split") == "val")
        weights = materialise(ensemble.fit_weights(base, val, list(parts)))
        mixed = ensemble.blend(base, weights, compute_ci=False)
        predictions = base.unionByName(
            mixed.select(SYMBOL, DATE, F.lit("ensemble").alias("model"), F.col("ensemble").alias("predicted"))
        )
    naive = ensemble.naive_last_close(frame).join(days, [SYMBOL, DATE])
    predictions = predictions.unionByName(
        naive.select(SYMBOL, DATE, F.lit("naive_last_close").alias("model"), "predicted")
    )
    names = [*parts, *(["ensemble"] if weights is not None else []), "naive_last_close"]
    return TrainingRun(
        frame=frame,
        features=cols,
        predictions=predictions,
        weights=weights,
        validation=evaluate_split(frame, predictions, "val", names),
        test=evaluate_split(frame, predictions, "test", names),
        test_forecast=actual_vs_predicted(frame, predictions, names, "test"),
        models=fitted,
    )


def forecast_forward(
    bars: DataFrame,
    run: TrainingRun,
    steps: int = DEFAULTS.forecast_days,
    which: list[str] | None = None,
) -> DataFrame:
    """Wide forward forecast of the fitted models with ensemble and band.

    The autoregression and the trend are refitted on the whole history first.
    """
    names = [m for m in (which or list(run.models)) if m in run.models]

    def ar_path() -> DataFrame:
        # Same order as chosen in training, parameters from the latest rows.
        again = ar.refit_selected(bars, run.models["arima"])
        return ar.forecast(bars, again, steps)

    jobs = {
        "arima": ar_path,
        "prophet": lambda: trend.forecast_path(bars, trend.fit(bars), steps),
        "xgboost": lambda: recursive_forecast(
            bars, boosted.next_return(run.models["xgboost"], run.features), steps
        ),
        "lstm": lambda: recursive_forecast(bars, sequence.next_return(run.models["lstm"]), steps),
    }
    paths = forecast_all({n: jobs[n] for n in names})
    return forecast_table(paths, names, run.weights)
