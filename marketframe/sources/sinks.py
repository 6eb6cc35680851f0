"""Writers for bars, metric tables, forecasts and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, OHLCV, SYMBOL

BAR_COLUMNS = (SYMBOL, DATE, *OHLCV, "dividends", "splits", "source")


def bar_layout(df: DataFrame) -> DataFrame:
    """Canonical bar columns; missing dividends and splits are zero."""
    fill = {c: F.lit(0.0) for c in ("dividends", "splits") if c not in df.columns}
    df = df.withColumns(fill) if fill else df
    return df.select(*[c for c in BAR_COLUMNS if c in df.columns])


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write bars clustered by symbol and date.

    Range partitioning cuts the table evenly even when one symbol dominates, and
    the sorted files give tight min/max statistics, so a read of one symbol or
    one period skips most of them. A directory per symbol would be one small
    file per ticker.
    """
    rows = bar_layout(df).repartitionByRange(SYMBOL, DATE).sortWithinPartitions(SYMBOL, DATE)
    writer = rows.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def merge_bars(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Bars after a refresh: the newer batch wins on a shared day."""
    both = bar_layout(stored).withColumn("_gen", F.lit(0)).unionByName(
        bar_layout(batch).withColumn("_gen", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in both.columns if c not in (SYMBOL, DATE, "_gen")]
    newest = both.groupBy(SYMBOL, DATE).agg(F.max_by(F.struct(*values), "_gen").alias("_row"))
    return newest.select(SYMBOL, DATE, *[F.col("_row")[c].alias(c) for c in values])


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric table or forecast as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def run_log(metrics: DataFrame, run_id: str) -> DataFrame:
    """Metric table as ``(run_id, symbol, model, metric, value)`` rows; the metric
    key is ``model_metric`` and non-finite values are left out."""
    keys = [c for c in (SYMBOL, "model") if c in metrics.columns]
    names = [c for c in metrics.columns if c not in keys]
    long = metrics.unpivot(keys, names, "metric", "value")
    finite = long.filter(F.abs("value") < float("inf"))
    return finite.select(
        F.lit(run_id).alias("run_id"),
        *keys,
        F.concat_ws("_", "model", "metric").alias("metric"),
        "value",
    )


def run_params(spark, run_id: str, params: dict[str, object]) -> DataFrame:
    """Run parameters as key/value rows."""
    rows = [(run_id, k, str(v)) for k, v in params.items()]
    return spark.createDataFrame(rows, "run_id string, key string, value string")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
