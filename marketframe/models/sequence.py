"""Lookback regression: the next return from a window of scaled features.

The window is flattened into one vector and fitted with a Huber loss, pooled over
symbols. Targets are learned in percent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, RETURN_SCALE, SYMBOL, TARGET
from ..operators.features import VOLUME_FEATURES, clip_features
from ..functions.windows import trailing
from ..operators.split import apply_scaler, fit_scaler
from ..plans.forecast import NextReturn, last_rows


@dataclass(frozen=True)
class LookbackModel:
    model: LinearRegressionModel
    stats: DataFrame
    cols: list[str]
    lookback: int


def _windows(df: DataFrame, stats: DataFrame, cols: list[str], lookback: int) -> DataFrame:
    """The rows with their flattened window ``features``; ``_full`` marks those
    that have ``lookback`` rows, the others get a zero vector of the same length.

    Scaled values live in scratch columns, so the caller's columns stay as they
    are and nothing has to be joined back.
    """
    df = df.fillna(0.0, [c for c in cols if c in VOLUME_FEATURES])
    scratch = {f"_s_{c}": F.col(c).cast("double") for c in cols}
    renamed = stats.select(
        SYMBOL, *[F.col(f"{c}_{part}").alias(f"_s_{c}_{part}") for c in cols for part in ("centre", "scale")]
    )
    names = list(scratch)
    rows = clip_features(apply_scaler(df.withColumns(scratch), renamed, names), names)
    window = F.flatten(F.collect_list(F.array(*names)).over(trailing(lookback)))
    size = lookback * len(cols)
    rows = rows.withColumn("_w", window).withColumn("_full", F.size("_w") == size)
    filled = F.when(F.col("_full"), F.col("_w")).otherwise(F.array_repeat(F.lit(0.0), size))
    return rows.withColumn("features", array_to_vector(filled)).drop("_w", *names)


def fit(
    df: DataFrame,
    cols: list[str],
    lookback: int = DEFAULTS.lookback,
    max_iter: int = 50,
    reg: float = 0.01,
) -> LookbackModel:
    """Fit on marked rows (see ``training_masks``); scaling uses the train split."""
    stats = fit_scaler(df.filter(F.col("split") == "train"), cols, "standard")
    rows = _windows(df, stats, cols, lookback)
    usable = F.col("_full") & F.col("fit_row") & F.col(TARGET).isNotNull()
    train = rows.filter(usable).select("features", (F.col(TARGET) * RETURN_SCALE).alias("y"))
    regression = LinearRegression(
        featuresCol="features", labelCol="y", predictionCol="p", loss="huber", maxIter=max_iter, regParam=reg
    )
    return LookbackModel(regression.fit(train), stats, list(cols), lookback)


def predict(fitted: LookbackModel, df: DataFrame) -> DataFrame:
    """Predicted next-day log return ``r``; null before the first full window."""
    rows = _windows(df, fitted.stats, fitted.cols, fitted.lookback)
    scored = fitted.model.transform(rows)
    r = F.when(F.col("_full"), F.col("p") / RETURN_SCALE)
    return scored.withColumn("r", r).drop("features", "p", "_full")


def next_return(fitted: LookbackModel) -> NextReturn:
    """Step function of a recursive forecast, on the tail a window needs."""

    def step(frame: DataFrame) -> DataFrame:
        tail = last_rows(frame.select(SYMBOL, DATE, *fitted.cols), fitted.lookback)
        newest = predict(fitted, tail).filter(F.col("r").isNotNull())
        return newest.select(SYMBOL, "r")

    return step
