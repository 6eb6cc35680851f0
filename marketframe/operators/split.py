"""Chronological splits, leak-safe scaling and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, SYMBOL
from ..functions.windows import series, whole
from .features import supervised_sequences

SCALERS = ("minmax", "standard", "robust")


def number_rows(df: DataFrame) -> DataFrame:
    """Row number from zero and series length, in one window pass."""
    return df.withColumns(
        {
            "row_no": F.row_number().over(series()) - 1,
            "n_rows": F.count("*").over(whole()),
        }
    )


def split_sizes(
    n: Column, train: float = DEFAULTS.train_ratio, val: float = DEFAULTS.val_ratio
) -> tuple[Column, Column]:
    """Number of training and validation rows, both rounded down."""
    return F.floor(n * F.lit(train)), F.floor(n * F.lit(val))


def temporal_split(
    df: DataFrame,
    train: float = DEFAULTS.train_ratio,
    val: float = DEFAULTS.val_ratio,
    test: float = DEFAULTS.test_ratio,
) -> DataFrame:
    """Label rows train / val / test in time order; keeps the row numbers."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    n_train, n_val = split_sizes(F.col("n_rows"), train, val)
    return (
        number_rows(df)
        .withColumns({"n_train": n_train, "n_val": n_val})
        .withColumn(
            "split",
            F.when(F.col("row_no") < F.col("n_train"), "train")
            .when(F.col("row_no") < F.col("n_train") + F.col("n_val"), "val")
            .otherwise("test"),
        )
    )


def training_masks(df: DataFrame) -> DataFrame:
    """Rows whose next-day target stays inside their own split.

    ``fit_row`` marks train rows and ``stop_row`` the validation rows used for
    early stopping; the last row of either split is left out.
    """
    if "split" not in df.columns:
        df = temporal_split(df)
    r, nt, nv = F.col("row_no"), F.col("n_train"), F.col("n_val")
    return df.withColumns(
        {
            "fit_row": r < nt - 1,
            "stop_row": (r >= nt) & (r < nt + nv - 1),
        }
    )


def _scaler_stats(kind: str, x: Column) -> tuple[Column, Column]:
    """Centre and scale aggregates of one column."""
    if kind == "minmax":
        return F.min(x), F.max(x) - F.min(x)
    if kind == "standard":
        return F.avg(x), F.stddev_pop(x)
    if kind == "robust":
        q = F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
        return q[1], q[2] - q[0]
    raise ValueError(f"unknown scaler {kind!r}, choose from {SCALERS}")


def _safe(scale: Column) -> Column:
    return F.when(scale == 0, 1.0).otherwise(scale)


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "minmax") -> DataFrame:
    """Centre and scale per symbol, as one row of ``<col>_centre, <col>_scale``.

    Fit it on the training rows. Columns that are not there are skipped; a zero
    scale becomes one.
    """
    aggs = []
    for c in [c for c in cols if c in df.columns]:
        centre, scale = _scaler_stats(kind, F.col(c))
        aggs += [centre.alias(f"{c}_centre"), _safe(scale).alias(f"{c}_scale")]
    return df.groupBy(SYMBOL).agg(*aggs)


def scale_on_train(df: DataFrame, cols: list[str], kind: str = "minmax") -> DataFrame:
    """Scale a labelled frame with statistics of its own training rows.

    The statistics are window aggregates over the symbol, so the rows are read
    and shuffled once, with no join back. Use :func:`fit_scaler` to keep them.
    """
    per = Window.partitionBy(SYMBOL)
    stats = {}
    for c in [c for c in cols if c in df.columns]:
        x = F.when(F.col("split") == "train", F.col(c))
        if kind == "robust":
            stats[f"_q_{c}"] = F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).over(per)
        elif kind == "minmax":
            stats |= {f"_c_{c}": F.min(x).over(per), f"_s_{c}": F.max(x).over(per)}
        elif kind == "standard":
            stats |= {f"_c_{c}": F.avg(x).over(per), f"_s_{c}": F.stddev_pop(x).over(per)}
        else:
            raise ValueError(f"unknown scaler {kind!r}, choose from {SCALERS}")
    out = {}
    for c in [c for c in cols if c in df.columns]:
        if kind == "robust":
            centre, scale = F.col(f"_q_{c}")[1], F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
        else:
            centre, scale = F.col(f"_c_{c}"), F.col(f"_s_{c}")
            scale = scale - centre if kind == "minmax" else scale
        out[c] = (F.col(c) - centre) / _safe(scale)
    return df.withColumns(stats).withColumns(out).select(*df.columns)


def scaled_columns(stats: DataFrame) -> list[str]:
    return [c[: -len("_centre")] for c in stats.columns if c.endswith("_centre")]


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Scale ``cols`` (default: all fitted); unknown columns are left as they are."""
    known = [c for c in scaled_columns(stats) if c in df.columns and c in (cols or df.columns)]
    joined = df.join(stats, SYMBOL, "left")
    scaled = {c: (F.col(c) - F.col(f"{c}_centre")) / F.col(f"{c}_scale") for c in known}
    return joined.withColumns(scaled).select(*df.columns)


def inverse_scale(df: DataFrame, stats: DataFrame, col: str, value: str | None = None) -> DataFrame:
    """Bring ``value`` (default ``col`` itself) back to the units of ``col``."""
    if col not in scaled_columns(stats):
        raise KeyError(f"no scaler was fitted for {col!r}")
    value = value or col
    pair = stats.select(SYMBOL, f"{col}_centre", f"{col}_scale")
    back = F.col(value) * F.col(f"{col}_scale") + F.col(f"{col}_centre")
    return df.join(pair, SYMBOL, "left").withColumn(value, back).select(*df.columns)


def prepare_data(
    df: DataFrame,
    cols: list[str],
    kind: str = "minmax",
    lookback: int = DEFAULTS.lookback,
    horizon: int = 1,
    target: str = "close",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split, scale on train only, and build sequences inside each split.

    Returns the scaled labelled rows, the sequences with their split, and the
    scaler statistics. The target is always the first column of a window.
    """
    parts = temporal_split(df)
    cols = [c for c in cols if c in df.columns]
    stats = fit_scaler(parts.filter(F.col("split") == "train"), cols, kind)
    scaled = scale_on_train(parts, cols, kind)
    ordered = [target] + [c for c in cols if c != target]
    return scaled, supervised_sequences(scaled, ordered, lookback, horizon, "split"), stats


def time_series_folds(
    df: DataFrame, k: int = DEFAULTS.search_folds, row: str = "row_no", n: str = "n_rows"
) -> DataFrame:
    """Expanding folds: the last ``k`` blocks of ``n // (k+1)`` rows are the tests,
    everything before a block is its training part.

    A row belongs to every fold it is not later than, so it is expanded over its
    own fold numbers instead of being joined to a fold table by range.
    """
    if row not in df.columns:
        df = number_rows(df)
    size = F.floor(F.col(n) / (k + 1))
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col(n) - (k - F.col("fold")) * size
    role = F.when(F.col(row) < start, "train").when(F.col(row) < start + size, "test")
    return folds.withColumn("role", role).filter(F.col("role").isNotNull())


def calendar_folds(df: DataFrame, k: int = DEFAULTS.search_folds, purge: int = 1, embargo: int = 0) -> DataFrame:
    """Expanding folds cut at the same dates for every symbol.

    The days are cut into ``k + 1`` blocks of about equally many rows; fold ``f`` tests block
    ``f + 1`` and trains on all before, without the ``purge`` days whose targets reach
    into the test block and ``embargo`` more. So no fold learns from a day that another
    symbol is tested on. There is one row per day to number, not one per bar.
    """
    days = df.groupBy(DATE).agg(F.count("*").alias("_rows"))
    ordered = Window.orderBy(DATE)
    total = F.sum("_rows").over(Window.partitionBy())
    before = F.sum("_rows").over(ordered) - F.col("_rows")
    days = days.select(DATE, F.row_number().over(ordered).alias("_day"), F.floor(before * (k + 1) / total).cast("int").alias("_block"))
    first = days.groupBy((F.col("_block") - 1).alias("fold")).agg(F.min("_day").alias("_start"))
    folds = days.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_block") - 1, F.lit(0)), F.lit(k - 1)))).join(first, "fold")
    train = F.col("_day") < F.col("_start") - (purge + embargo)
    role = F.when(F.col("_block") == F.col("fold") + 1, "test").when(train, "train")
    folds = folds.select(DATE, "fold", role.alias("role")).where("role IS NOT NULL")
    return df.join(folds, DATE)
