"""Naive baseline, weighted blending and simplex-constrained weights."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, SYMBOL
from ..functions.linear import gram
from ..functions.windows import nz, series


def naive_last_close(df: DataFrame) -> DataFrame:
    """Tomorrow equals today."""
    out = df.select(SYMBOL, DATE, F.lag("close").over(series()).alias("predicted"))
    return out.filter(F.col("predicted").isNotNull())


def _weighted(predictions: DataFrame, weights: dict[str, float] | DataFrame | None) -> DataFrame:
    """Add ``weight``; null for a model without one."""
    if isinstance(weights, DataFrame):
        return predictions.join(weights.select(SYMBOL, "model", "weight"), [SYMBOL, "model"], "left")
    table = weights or DEFAULTS.weights
    pairs = [F.lit(v) for m, w in table.items() for v in (m, float(w))]
    return predictions.withColumn("weight", F.try_element_at(F.create_map(*pairs), F.col("model")))


def wide_blend(
    predictions: DataFrame,
    models: list[str],
    weights: dict[str, float] | DataFrame | None = None,
    std_multiplier: float = 1.96,
) -> DataFrame:
    """One column per model next to the blend and its band, in one grouped pass.

    The blend is the weighted mean over the models present on a day, weights
    renormalised; the band is a multiple of the models' population spread.
    ``weights`` is one dict for all symbols or a (symbol, model, weight) table;
    a model without a weight is left out of the blend.
    """
    rows = _weighted(predictions, weights)
    w = F.when(F.col("predicted").isNotNull(), F.col("weight"))
    p = F.when(F.col("weight").isNotNull(), F.col("predicted"))
    out = rows.groupBy(SYMBOL, DATE).agg(
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models],
        (F.sum(w * p) / nz(F.sum(w))).alias("ensemble"),
        F.stddev_pop(p).alias("_std"),
    )
    band = std_multiplier * F.col("_std")
    both = {"lower": F.col("ensemble") - band, "upper": F.col("ensemble") + band}
    return out.withColumns(both).drop("_std")


def blend(
    predictions: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    compute_ci: bool = True,
    std_multiplier: float = 1.96,
) -> DataFrame:
    """The blend alone; see :func:`wide_blend`. Days without a weighted model drop out."""
    out = wide_blend(predictions, [], weights, std_multiplier).filter(F.col("ensemble").isNotNull())
    return out if compute_ci else out.drop("lower", "upper")


def ensemble_table(
    predictions: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    actuals: DataFrame | None = None,
    models: list[str] | None = None,
) -> DataFrame:
    """Dated wide table: one column per model, blend, band and optional actual."""
    out = wide_blend(predictions, models or list(DEFAULTS.weights), weights)
    if actuals is not None:
        actual = actuals.select(SYMBOL, DATE, F.col("close").alias("actual"))
        out = out.join(actual, [SYMBOL, DATE], "left")
    return out


def best_simplex_weights(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimise w'Gw - 2b'w over non-negative weights that sum to one.

    The minimum over the simplex is the equality-constrained minimum of one of
    its faces; there are 2^k - 1 faces, and every vertex is feasible.
    """
    k = len(b)
    scale = max(float(np.max(np.abs(g))), 1e-300)
    best, best_value = np.full(k, 1.0 / k), np.inf
    for size in range(1, k + 1):
        for face in combinations(range(k), size):
            idx = list(face)
            kkt = np.zeros((size + 1, size + 1))
            kkt[:size, :size] = g[np.ix_(idx, idx)] / scale
            kkt[:size, size] = kkt[size, :size] = 1.0
            w = np.linalg.lstsq(kkt, np.append(b[idx] / scale, 1.0), rcond=None)[0][:size]
            if w.min() < -1e-10 or abs(w.sum() - 1) > 1e-6:
                continue
            full = np.zeros(k)
            full[idx] = np.clip(w, 0, None) / np.clip(w, 0, None).sum()
            value = full @ g @ full - 2 * b @ full
            if value < best_value - 1e-15 * abs(best_value if np.isfinite(best_value) else 0):
                best, best_value = full, value
    return best


def fit_weights(
    predictions: DataFrame, actuals: DataFrame, models: list[str] | None = None
) -> DataFrame:
    """Weights per symbol that minimise the blend's RMSE on the given days.

    One aggregate builds the cross products of errors (a day counts when every
    model is there); the solve sees one k x k row per symbol. With the weights
    summing to one, the squared blend error is the quadratic form of the errors
    themselves, which avoids cancellation of price-level squares. A symbol
    without a usable day gets the default weights and ``optimised`` false.
    """
    models = models or list(DEFAULTS.weights)
    actual = actuals.select(SYMBOL, DATE, F.col("close").alias("_actual"))
    wide = (
        predictions.groupBy(SYMBOL, DATE)
        .agg(*[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models])
        .join(actual, [SYMBOL, DATE])
    )
    grams = gram(wide, [SYMBOL], [f"`{m}` - _actual" for m in models], "0D")
    default = np.array([DEFAULTS.weights.get(m, 0.0) for m in models])

    def solve(batches):
        for pdf in batches:
            rows = []
            for symbol, n, xx in zip(pdf[SYMBOL], pdf["n"], pdf["xx"]):
                solved = n > 0
                if solved:
                    g = np.asarray(xx, dtype=float).reshape(len(models), -1) / n
                    w = best_simplex_weights(g, np.zeros(len(models)))
                    score = float(np.sqrt(max(w @ g @ w, 0.0)))
                else:
                    w, score = default, None
                rows += [(symbol, m, float(v), score, bool(solved)) for m, v in zip(models, w)]
            yield pd.DataFrame(rows, columns=[SYMBOL, "model", "weight", "rmse", "optimised"])

    return grams.mapInPandas(
        solve, f"{SYMBOL} string, model string, weight double, rmse double, optimised boolean"
    )
