"""Least squares as a Spark aggregate plus a small dense solve.

:func:`gram` sums cross products with plain aggregates, so rows are combined on
the map side and only one k x k row per key is shuffled, whatever the number of
rows behind a key. :func:`fit_design` is for wider designs kept as one array
column: tasks sum their rows' cross products, which are then added up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matrices of different keys that a task holds at once.
HELD = 256


def gram_aggregates(
    xs: Sequence[str], y: str, where: str = "true", prefix: str = ""
) -> dict[str, Column]:
    """Sums ``n``, ``yy``, ``xy_i``, ``xx_i_j`` (j >= i) over complete rows, named
    with ``prefix``. ``xs``, ``y`` and ``where`` are SQL expressions."""
    known = " AND ".join(f"({e}) IS NOT NULL" for e in (y, *xs))
    rule = f"FILTER (WHERE {known} AND {where})"
    out = {f"_{prefix}n": f"CAST(count(*) {rule} AS DOUBLE)", f"_{prefix}yy": f"sum(({y}) * ({y})) {rule}"}
    for i, a in enumerate(xs):
        out[f"_{prefix}xy_{i}"] = f"sum(({a}) * ({y})) {rule}"
        for j in range(i, len(xs)):
            out[f"_{prefix}xx_{i}_{j}"] = f"sum(({a}) * ({xs[j]})) {rule}"
    return {name: F.expr(e) for name, e in out.items()}


def gram_arrays(k: int, prefix: str = "") -> list[Column]:
    """Pack the sums of :func:`gram_aggregates` into n, yy, xx (row major) and xy."""
    entry = [f"_{prefix}xx_{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)]
    return [
        F.col(f"_{prefix}n").alias("n"),
        F.col(f"_{prefix}yy").alias("yy"),
        F.array(*entry).cast("array<double>").alias("xx"),
        F.array(*[f"_{prefix}xy_{i}" for i in range(k)]).cast("array<double>").alias("xy"),
    ]


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """One row per key: n, yy, xx (k*k), xy (k)."""
    sums = gram_aggregates(xs, y)
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    return grouped.select(*keys, *gram_arrays(len(xs)))


def solve_batch(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Solve a stack of symmetric systems; singular ones by pseudo-inverse.

    Columns are scaled to unit diagonal first, which keeps mixed units well
    conditioned.
    """
    d = np.sqrt(np.clip(np.einsum("...ii->...i", xx), 0, None))
    d = np.where(d > 0, d, 1.0)
    scaled = xx / (d[..., :, None] * d[..., None, :])
    inv = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True)
    return np.einsum("...ij,...j->...i", inv, xy / d) / d


def refined(xx: np.ndarray, xy: np.ndarray, rounds: int = 3) -> np.ndarray:
    """:func:`solve_batch`, then solved again for what its rounding left over."""
    beta = solve_batch(xx, xy)
    for _ in range(rounds):
        beta = beta + solve_batch(xx, xy - np.einsum("...ij,...j->...i", xx, beta))
    return beta


def residual_sum(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, beta: np.ndarray) -> np.ndarray:
    fit = np.einsum("...i,...ij,...j->...", beta, xx, beta)
    return np.clip(yy - 2 * np.einsum("...i,...i->...", beta, xy) + fit, 0.0, None)


def solve_grams(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficients and residual sum of squares per key, by one batched solve."""
    key_fields = [f for f in grams.schema if f.name in keys]
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in key_fields]
        + ["n double", "beta array<double>", "rss double"]
    )
    names = [f.name for f in key_fields]

    def solve(batches):
        for pdf in batches:
            pdf = pdf[(pdf["n"] > 0)].reset_index(drop=True)
            out = pdf[names + ["n"]].copy()
            if len(pdf):
                xy = np.stack(pdf["xy"].to_numpy())
                xx = np.stack(pdf["xx"].to_numpy()).reshape(len(pdf), xy.shape[1], -1)
                beta = solve_batch(xx, xy)
                out["beta"] = list(beta)
                out["rss"] = residual_sum(xx, xy, pdf["yy"].to_numpy(), beta)
            else:
                out["beta"], out["rss"] = [], []
            yield out

    return grams.mapInPandas(solve, schema)


def design_grams(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Cross products of (x, y, 1) per key, as the packed upper triangle.

    Every task adds its rows up by key and sends one triangle per key, so the rows of a key
    need not meet; the triangles are added entry by entry. Rows without ``y`` count as absent.
    """
    names = list(keys)
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)

    def triangles(held: dict) -> pd.DataFrame:
        upper = np.triu_indices(len(next(iter(held.values()))))
        out = {name: [key[i] for key in held] for i, name in enumerate(names)}
        return pd.DataFrame({**out, "packed": [g[upper] for g in held.values()]})

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(names, sort=False, dropna=False):
                z = np.column_stack([np.stack(rows[x].to_numpy()), rows[y].to_numpy(float), np.ones(len(rows))])
                held[key] = held.get(key, 0.0) + z.T @ z
            if len(held) > HELD:
                yield triangles(held)
                held = {}
        if held:
            yield triangles(held)

    known = df.filter(F.col(y).isNotNull()).select(*names, x, y)
    parts = known.mapInPandas(partial, f"{key_fields}, packed array<double>").repartition(*names)
    entries = parts.select(*names, F.posexplode("packed").alias("_i", "_v"))
    sums = entries.groupBy(*names, "_i").agg(F.sum("_v").alias("_v"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    return sums.groupBy(*names).agg(ordered.alias("_p")).select(*names, F.col("_p._v").alias("packed"))


def fit_design(
    df: DataFrame,
    keys: Sequence[str],
    penalties: Sequence[float] | None = None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Ridge or plain least squares on an array column, from its cross products.

    ``penalties`` are prior scales per coefficient (``inf`` for none): the ridge
    term is the residual variance over the squared scale, with the variance
    estimated from the data in three rounds.

    Returns n, beta, rss, sigma and noise, the variance behind the ridge term.
    """
    names = list(keys)
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)
    schema = f"{key_fields}, n double, beta array<double>, rss double, sigma double, noise double"
    weight = None if penalties is None else np.array([0.0 if np.isinf(s) else 1.0 / s**2 for s in penalties])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack(pdf["packed"].to_numpy())
        m = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
        i, j = np.triu_indices(m)
        full = np.zeros((len(pdf), m, m))
        full[:, i, j] = full[:, j, i] = packed
        k = m - 2
        xx, xy, yy, total, n = full[:, :k, :k], full[:, :k, k], full[:, k, k], full[:, k, k + 1], full[:, k + 1, k + 1]
        noise = np.zeros(len(pdf))
        if weight is None:
            beta = refined(xx, xy)
        else:
            variance = np.clip(yy / n - (total / n) ** 2, 0, None) * 0.01 + 1e-12
            for _ in range(3):
                noise = variance
                beta = refined(xx + noise[:, None, None] * np.diag(weight), xy)
                variance = np.maximum(residual_sum(xx, xy, yy, beta) / n, 1e-12)
        rss = residual_sum(xx, xy, yy, beta)
        dof = np.maximum(n - k, 1) if weight is None else n
        out = pdf[names].copy()
        out["n"], out["beta"], out["rss"], out["sigma"], out["noise"] = n, list(beta), rss, np.sqrt(rss / dof), noise
        return out

    def solve(batches):
        for pdf in batches:
            for at in range(0, len(pdf), HELD):
                yield solved(pdf.iloc[at : at + HELD].reset_index(drop=True))

    return design_grams(df, names, x, y).mapInPandas(solve, schema)
