"""Multi-day forecasts: business calendar, recursion, fan-out, tables, documents."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, DEFAULTS, FORECAST_MODELS, OHLCV, SYMBOL, Settings
from ..functions.storage import materialise, new_table
from ..functions.windows import finite, pick_rows
from ..models.ensemble import wide_blend
from ..operators.features import make_model_frame

log = logging.getLogger(__name__)
MAX_STEPS = 252


def next_business_day(d):
    """The weekday after ``d``."""
    return F.date_add(d, F.greatest(F.lit(1), F.when(F.weekday(d) >= 4, 7 - F.weekday(d)).otherwise(1)))


def business_calendar(start, steps: int):
    """Array of the next ``steps`` weekdays after ``start``."""
    span = 7 * (steps // 5 + 2)
    days = F.sequence(F.date_add(start, 1), F.date_add(start, span))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, steps)


def future_days(df: DataFrame, steps: int = DEFAULTS.forecast_days) -> DataFrame:
    """(symbol, step, date) of the next ``steps`` business days of each symbol."""
    last = df.groupBy(SYMBOL).agg(F.max(DATE).alias("_last"))
    days = F.posexplode(business_calendar(F.col("_last"), steps)).alias("_pos", DATE)
    return last.select(SYMBOL, days).select(SYMBOL, (F.col("_pos") + 1).alias("step"), DATE)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rows of each symbol, pruned before the shuffle."""
    w = Window.partitionBy(SYMBOL).orderBy(F.col(DATE).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame) -> DataFrame:
    """The last row of each symbol, by a map-side combined aggregate."""
    return pick_rows(df, [SYMBOL], DATE, first=False).select(*df.columns)


NextReturn = Callable[[DataFrame], DataFrame]


def recursive_forecast(
    ohlcv: DataFrame,
    next_logret: NextReturn,
    steps: int = DEFAULTS.forecast_days,
    history_rows: int = DEFAULTS.history_rows,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Forecast ``steps`` business days of closes for all symbols together.

    ``next_logret`` takes the feature frame and returns ``(symbol, r)``, the log
    return expected after each symbol's last bar. Every step appends one
    synthetic bar per symbol (open = high = low = close, volume = mean of the
    last 20) and rebuilds the features; a symbol without a feature row, for example with
    too short a history, is an error. The loop runs over steps only; each step
    is one Spark job over every symbol. The pruned history is written once, and
    then only the appended bars, one row per symbol and step.
    """
    values = [c for c in OHLCV if c in ohlcv.columns]
    history = materialise(last_rows(ohlcv.select(SYMBOL, DATE, *values), history_rows))
    volume = F.avg("volume") if "volume" in values else F.lit(0.0)
    state = (
        last_rows(history, 20)
        .groupBy(SYMBOL)
        .agg(F.max(DATE).alias(DATE), F.max_by("close", DATE).alias("close"), volume.alias("_vol"))
    )
    # Every step is one partition of a single table, so the plan of a late step
    # reads one relation, not one per earlier step.
    spark, table = ohlcv.sparkSession, new_table(ohlcv.sparkSession)
    layout = f"{SYMBOL} string, {DATE} date, {', '.join(f'{c} double' for c in values)}, _vol double, step int"
    bars, now = history, state
    for step in range(1, steps + 1):
        r = next_logret(make_model_frame(bars, cfg, "calendar")).select(SYMBOL, "r", F.lit(True).alias("_known"))
        absent = F.raise_error(F.concat(F.lit("no feature row at the end of "), F.col(SYMBOL))).cast("double")
        move = F.when(F.col("_known"), F.coalesce(finite(F.col("r")), F.lit(0.0))).otherwise(absent)
        close = F.col("close") * F.exp(move)
        bar = now.join(r, SYMBOL, "left").select(
            SYMBOL,
            next_business_day(F.col(DATE)).alias(DATE),
            *[(F.col("_vol") if c == "volume" else close).alias(c) for c in values],
            "_vol",
        )
        bar.write.parquet(f"{table}/step={step}")
        added = spark.read.schema(layout).parquet(table)
        bars = history.unionByName(added.select(SYMBOL, DATE, *values))
        now = added.filter(F.col("step") == step).select(*state.columns)
    return added.select(SYMBOL, "step", DATE, F.col("close").alias("predicted"))


def single_step(path: DataFrame, steps: int = 1) -> DataFrame:
    """The last point of a path of one to ten steps."""
    if not 1 <= steps <= 10:
        raise ValueError("steps must be between 1 and 10")
    return path.filter(F.col("step") == steps).select(
        SYMBOL, DATE, F.round("predicted", 4).alias("predicted")
    )


def forecast_all(
    jobs: dict[str, Callable[[], DataFrame]],
    which: list[str] | None = None,
    isolate: bool = True,
) -> DataFrame:
    """Long ``(symbol, date, model, predicted)`` over the available models.

    A model that fails is logged and left out; the others go on. ``isolate``
    runs each job to a written table of its path (one row per symbol and step), so
    that a failure at run time is caught as well; without it the plan stays lazy.
    """
    parts = []
    for name in which or list(jobs):
        if name not in jobs:
            continue
        try:
            part = jobs[name]()
            part = part.select(SYMBOL, DATE, F.lit(name).alias("model"), "predicted")
            parts.append(materialise(part) if isolate else part)
        except Exception as exc:  # one bad model must not stop the rest
            log.warning("%s forecast failed: %s", name, exc)
    if not parts:
        raise RuntimeError("every model forecast failed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forecast_table(
    predictions: DataFrame, models: list[str], weights: dict[str, float] | DataFrame | None = None
) -> DataFrame:
    """Wide forward forecast: models, ensemble and band by date."""
    return wide_blend(predictions, models, weights).withColumnsRenamed(
        {"lower": "ci_lower", "upper": "ci_upper"}
    )


def forecast_document(
    predictions: DataFrame,
    models: list[str],
    steps: int = DEFAULTS.forecast_days,
    include_ci: bool = True,
    weights: dict[str, float] | DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """One nested forecast per symbol: model -> rounded points, blend, metadata.

    One pass over the predictions: models and blend per day, then the days of a
    symbol (at most 252) as one list. Asking for the blend uses every base model;
    only the requested ones are listed. The metadata names the last date of
    ``history`` when it is given.
    """
    if not 1 <= steps <= MAX_STEPS:
        raise ValueError(f"steps must be between 1 and {MAX_STEPS}")
    unknown = set(models) - set(FORECAST_MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}, choose from {FORECAST_MODELS}")
    shown = [m for m in FORECAST_MODELS if m in models and m != "ensemble"]
    daily = wide_blend(predictions, shown, weights)
    day = F.struct(F.date_format(DATE, "yyyy-MM-dd").alias("date"), *shown, "ensemble", "lower", "upper")
    days = F.slice(F.sort_array(F.collect_list(day)), 1, steps)
    doc = daily.groupBy(SYMBOL).agg(days.alias("_days"))
    if history is None:
        doc = doc.withColumn("_known", F.lit(None).cast("date"))
    else:
        doc = doc.join(history.groupBy(SYMBOL).agg(F.max(DATE).alias("_known")), SYMBOL, "left")

    def points(m: str) -> Column:
        known = F.filter("_days", lambda d: d[m].isNotNull())
        return F.transform(known, lambda d: F.struct(d["date"].alias("date"), F.round(d[m], 4).alias("predicted")))

    def blended(d: Column) -> Column:
        bound = (lambda c: F.round(c, 4)) if include_ci else (lambda c: F.lit(None).cast("double"))
        return F.struct(
            d["date"].alias("date"),
            F.round(d["ensemble"], 4).alias("predicted"),
            bound(d["lower"]).alias("lower_bound"),
            bound(d["upper"]).alias("upper_bound"),
        )

    point = "array<struct<date:string,predicted:double>>"
    bounded = "array<struct<date:string,predicted:double,lower_bound:double,upper_bound:double>>"
    entries = [F.struct(F.lit(m).alias("key"), points(m).cast(point).alias("value")) for m in shown]
    listed = F.array(*entries) if entries else F.array().cast(f"array<struct<key:string,value:{point}>>")
    full = F.filter(listed, lambda e: F.size(e["value"]) > 0)
    ensemble = F.filter("_days", lambda d: d["ensemble"].isNotNull())
    wanted = F.transform(ensemble, blended) if "ensemble" in models else F.lit(None)
    doc = doc.withColumns({"forecasts": F.map_from_entries(full), "ensemble": wanted.cast(bounded)})
    tail = F.array(*[F.lit("ensemble")]) if "ensemble" in models else F.array().cast("array<string>")
    return doc.select(
        SYMBOL,
        F.current_timestamp().alias("generated_at"),
        F.lit(steps).alias("forecast_days"),
        F.concat(F.map_keys("forecasts"), tail).alias("models_used"),
        "forecasts",
        "ensemble",
        F.struct(
            F.date_format("_known", "yyyy-MM-dd").alias("last_known_date"),
            F.lit(include_ci).alias("ci_included"),
        ).alias("metadata"),
    )


def document_json(doc: DataFrame) -> DataFrame:
    """(symbol, json)."""
    rest = [c for c in doc.columns if c != SYMBOL]
    return doc.select(SYMBOL, F.to_json(F.struct(F.col(SYMBOL).alias("ticker"), *rest)).alias("json"))


def document_rows(doc: DataFrame) -> DataFrame:
    """The document opened up again: one row per model and date."""
    per_model = doc.select(SYMBOL, F.explode("forecasts").alias("model", "points")).select(
        SYMBOL, "model", F.explode("points").alias("p")
    )
    base = per_model.select(
        SYMBOL,
        "model",
        F.to_date("p.date").alias(DATE),
        "p.predicted",
        F.lit(None).cast("double").alias("lower_bound"),
        F.lit(None).cast("double").alias("upper_bound"),
    )
    ens = doc.select(SYMBOL, F.lit("ensemble").alias("model"), F.explode("ensemble").alias("p"))
    return base.unionByName(
        ens.select(
            SYMBOL,
            "model",
            F.to_date("p.date").alias(DATE),
            "p.predicted",
            "p.lower_bound",
            "p.upper_bound",
        )
    )
