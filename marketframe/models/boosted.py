"""Gradient-boosted regression of the next-day return, pooled over symbols.

Targets are learned in percent, so that the share by which the validation error must
fall is one of the error itself.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from statistics import median

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, RETURN_SCALE, SYMBOL, TARGET
from ..operators.features import VOLUME_FEATURES
from ..functions.storage import discard, materialise
from ..operators.permute import permuted
from ..operators.split import number_rows
from ..plans.forecast import NextReturn, latest

# Search space of one candidate: learning rate (log scale), tree depth, leaf
# size, row and feature share. Penalty terms have no counterpart here.
SPACE = {
    "eta": (0.01, 0.3),
    "max_depth": (3, 10),
    "min_child_weight": (1, 10),
    "subsample": (0.5, 1.0),
    "colsample": (0.5, 1.0),
}


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add the ``features`` vector; rows with a missing input are dropped. Volume
    features of a series that does not trade count as zero."""
    df = df.fillna(0.0, [c for c in cols if c in VOLUME_FEATURES])
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def _regressor(params: dict, max_iter: int, seed: int, validation: bool) -> GBTRegressor:
    # Boosting stops once the validation error no longer falls by this share.
    stop = {"validationIndicatorCol": "stop_row", "validationTol": 1e-4} if validation else {}
    return GBTRegressor(
        featuresCol="features",
        labelCol="_percent",
        predictionCol="_p",
        maxIter=max_iter,
        stepSize=params.get("eta", 0.1),
        maxDepth=int(params.get("max_depth", 5)),
        minInstancesPerNode=int(params.get("min_child_weight", 1)),
        subsamplingRate=params.get("subsample", 1.0),
        featureSubsetStrategy=str(params.get("colsample", "all")),
        seed=seed,
        **stop,
    )


def fit(
    df: DataFrame,
    cols: list[str],
    params: dict | None = None,
    max_iter: int = 100,
    seed: int = 42,
) -> GBTRegressionModel:
    """Fit on the rows marked ``fit_row``, stop early on those marked ``stop_row``
    (see ``training_masks``); without marks every row with a target is used."""
    rows = df.filter(F.col(TARGET).isNotNull())
    marked = "fit_row" in df.columns
    if marked:
        rows = rows.filter(F.col("fit_row") | F.col("stop_row"))
    keep = ["stop_row"] if marked else []
    train = assemble(rows, cols).select("features", (F.col(TARGET) * RETURN_SCALE).alias("_percent"), *keep)
    return _regressor(params or {}, max_iter, seed, marked).fit(train)


def predict(model: GBTRegressionModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """Predicted next-day log return ``r`` for every row."""
    scored = model.transform(assemble(df, cols))
    return scored.withColumn("r", F.col("_p") / RETURN_SCALE).drop("features", "_p")


def next_return(model: GBTRegressionModel, cols: list[str]) -> NextReturn:
    """The step function of a recursive forecast: score each symbol's last row."""

    def step(frame: DataFrame) -> DataFrame:
        return predict(model, latest(frame.select(SYMBOL, DATE, *cols)), cols).select(SYMBOL, "r")

    return step


def candidates(trials: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from the search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        low, high = SPACE["eta"]
        out.append(
            {
                "eta": low * (high / low) ** rng.random(),
                "max_depth": rng.randint(*SPACE["max_depth"]),
                "min_child_weight": rng.randint(*SPACE["min_child_weight"]),
                "subsample": rng.uniform(*SPACE["subsample"]),
                "colsample": rng.uniform(*SPACE["colsample"]),
            }
        )
    return out


#: Share of a fold's training days, the latest ones, that say when boosting stops.
STOP_SHARE = 0.2


def search(
    df: DataFrame,
    cols: list[str],
    trials: int = DEFAULTS.search_trials,
    folds: int = DEFAULTS.search_folds,
    max_iter: int = 100,
    seed: int = 42,
    threads: int = 8,
) -> tuple[dict, DataFrame]:
    """Best parameters by mean fold RMSE over expanding folds, and all scores.

    Fold after fold, the trials still in it run side by side in ``threads`` threads, each
    fit a distributed job in a scheduler pool of its own, so that the tail of one fills
    the gaps of others. In a fold the latest days of the training part say when
    boosting stops. From the second fold on, trials whose mean error so far is above the
    median are given up: their score is that mean, and ``folds`` says how many they saw.
    Folds never train on rows later than their test block, and give the last day
    of a training part away, whose target lies in the test block.
    """
    spark = df.sparkSession
    rows = df.drop("row_no", "n_rows") if "row_no" in df.columns else df
    rows = assemble(rows.filter(F.col(TARGET).isNotNull()), cols)
    rows = rows.select(SYMBOL, DATE, (F.col(TARGET) * RETURN_SCALE).alias("_percent"), "features")
    # A row is stored once, with the test block it lies in; folds are conditions on that.
    size = F.floor(F.col("n_rows") / (folds + 1))
    first = F.col("n_rows") - folds * size
    numbered = number_rows(rows).withColumns({"_first": first, "_size": size})
    stored = materialise(numbered.select("_percent", "features", "row_no", "_first", "_size"))
    score = RegressionEvaluator(labelCol="_percent", predictionCol="_p", metricName="rmse")
    drawn = candidates(trials, seed)

    def error(number: int, k: int) -> float:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number}")
        start = F.col("_first") + k * F.col("_size")
        stop_row = F.col("row_no") >= F.floor(start * (1 - STOP_SHARE))
        train = stored.filter(F.col("row_no") < start - 1).select("_percent", "features", stop_row.alias("stop_row"))
        test = stored.filter((F.col("row_no") >= start) & (F.col("row_no") < start + F.col("_size")))
        model = _regressor(drawn[number], max_iter, seed, True).fit(train)
        return score.evaluate(model.transform(test)) / RETURN_SCALE

    errors: list[list[float]] = [[] for _ in range(trials)]
    alive = list(range(trials))
    with ThreadPoolExecutor(threads) as pool:
        for k in range(folds):
            for number, value in zip(alive, pool.map(error, alive, [k] * len(alive))):
                errors[number].append(value)
            if 0 < k < folds - 1:
                means = {n: sum(errors[n]) / len(errors[n]) for n in alive}
                alive = [n for n in alive if means[n] <= median(means.values())]
    results = [{"trial": n, **drawn[n], "rmse": sum(e) / len(e), "folds": len(e)} for n, e in enumerate(errors)]
    discard(stored)
    best = min((r for r in results if r["folds"] == folds), key=lambda r: r["rmse"])
    table = spark.createDataFrame([tuple(r.values()) for r in results], list(results[0]))
    return {k: v for k, v in best.items() if k not in ("trial", "rmse", "folds")}, table


def importance(model: GBTRegressionModel, cols: list[str], spark, top_n: int = 20) -> DataFrame:
    """Built-in importance, largest first."""
    values = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(cols, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    ).limit(top_n)


def contributions(model: GBTRegressionModel, df: DataFrame, cols: list[str], top_n: int = 20) -> DataFrame:
    """Mean absolute change of the prediction when a feature is set to its mean.

    Every row is scored once per feature in the tasks that hold it; only one
    running mean per feature is shuffled.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = F.array(*[F.lit(v) for v in rows.agg(*[F.avg(c) for c in cols]).first()])
    base = rows.select(F.array(*cols).alias("_x"))
    whole = model.transform(base.withColumn("features", array_to_vector("_x"))).select("_x", F.col("_p").alias("_r0"))
    one = whole.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), means[i]).otherwise(v))
    scored = model.transform(one.withColumn("features", array_to_vector(swapped)))
    per = scored.groupBy("_j").agg((F.avg(F.abs(F.col("_p") - F.col("_r0"))) / RETURN_SCALE).alias("importance"))
    names = F.array(*[F.lit(c) for c in cols])
    return (
        per.select(names[F.col("_j")].alias("feature"), "importance")
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top_n)
    )


def permutation_importance(model: GBTRegressionModel, df: DataFrame, cols: list[str], seed: int = 42, top_n: int = 20) -> DataFrame:
    """Rise of the mean squared error when a feature's values are dealt anew over the rows.

    One join gives each row the values of another; a row is then scored once per feature in
    the task that holds it, and one running mean per feature is shuffled.
    """
    rows = df.select(TARGET, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    both = permuted(rows, cols, seed).select(TARGET, F.array(*cols).alias("_x"), "_permuted")
    one = both.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.get("_permuted", i)).otherwise(v))
    scored = model.transform(one.withColumn("features", array_to_vector(swapped)))
    error = F.avg(F.pow(F.col("_p") / RETURN_SCALE - F.col(TARGET), F.lit(2.0)))
    per = scored.groupBy("_j").agg(error.alias("_error"))
    base = F.max(F.when(F.col("_j") < 0, F.col("_error"))).over(Window.partitionBy())
    names = F.array(*[F.lit(c) for c in cols])
    rise = per.withColumn("importance", F.col("_error") - base).where("_j >= 0")
    return rise.select(names[F.col("_j")].alias("feature"), "importance").orderBy(F.col("importance").desc(), "feature").limit(top_n)
