"""Weekday calendar, gap filling, bad-tick repair, returns and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATE, OHLCV, SYMBOL
from ..functions.windows import (
    double_columns,
    drop_scratch,
    finite,
    log_ratio,
    pick_rows,
    ratio,
    rolling_median,
    running,
    series,
    whole,
)


def weekdays_only(df: DataFrame) -> DataFrame:
    return df.filter(F.weekday(DATE) < 5)


def first_per_day(df: DataFrame, order: list[str], *, keep: str = "first") -> DataFrame:
    """One row per (symbol, date): the first (or last) by ``order``.

    A grouped aggregate rather than a ranking window, so copies of one day are
    combined on the map side and a heavily repeated key never meets in one task.
    A single order column keeps it hash based. ``_dropped`` counts the losers.
    """
    rank = order[0]
    if len(order) > 1:
        rank = "_rank"
        df = df.withColumn(rank, F.struct(*order))
    return pick_rows(
        df, [SYMBOL, DATE], rank, keep == "first", {"_dropped": F.count("*") - 1}
    ).select(*[c for c in df.columns if c != "_rank"], "_dropped")


def business_days(df: DataFrame) -> DataFrame:
    """Add the missing weekdays between each symbol's first and last bar, as nulls.

    Each bar is expanded over the days up to the next bar, so the calendar needs
    neither a join nor a second shuffle.
    """
    nxt = F.lead(DATE).over(series())
    values = [c for c in df.columns if c not in (SYMBOL, DATE)]
    days = F.explode(
        F.sequence(F.col(DATE), F.greatest(F.date_sub(F.col("_next"), 1), F.col(DATE)))
    )
    spread = (
        df.withColumn("_next", nxt)
        .select(SYMBOL, F.col(DATE).alias("_bar"), days.alias(DATE), *values)
        .filter(F.weekday(DATE) < 5)
    )
    own = F.col(DATE) == F.col("_bar")
    return spread.select(SYMBOL, DATE, *[F.when(own, F.col(c)).alias(c) for c in values])


def fill_forward(
    df: DataFrame, cols: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Carry the last known value forward, over at most ``limit`` rows if given."""
    cols = cols or [c for c in df.columns if c not in (SYMBOL, DATE)]
    w = running() if limit is None else series().rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_both(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Forward fill, then give a leading gap the first known value.

    After a forward fill only a leading gap is left, so the backward fill is the
    first non-null of the partition: one pass instead of a frame that reaches to
    the end of the series from every row.
    """
    cols = cols or [c for c in df.columns if c not in (SYMBOL, DATE)]
    return df.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(running()),
                F.first(c, ignorenulls=True).over(whole()),
            )
            for c in cols
        }
    )


def drop_missing_close(df: DataFrame) -> DataFrame:
    return df.filter(F.col("close").isNotNull())


def repair_bad_ticks(
    df: DataFrame,
    cols: list[str] | None = None,
    factor: float = 3.0,
    window: int = 21,
    trailing_only: bool = False,
) -> DataFrame:
    """Replace isolated bad values by their neighbour.

    A value is bad when its log distance from the rolling median leaves the
    interquartile fence of its own series, or when it is not positive. The fence
    is widened to at least 0.5 (2.0 for volume) so that ordinary volatile days
    stay. The median is centred, hence looks ahead; ``trailing_only`` uses past
    rows only.
    """
    cols = [c for c in (cols or OHLCV) if c in df.columns]
    half = window // 2
    frame = (
        series().rowsBetween(1 - window, 0)
        if trailing_only
        else series().rowsBetween(-half, window - 1 - half)
    )
    df = df.withColumns({f"_x_{c}": F.when(F.col(c) > 0, F.col(c)) for c in cols})
    df = df.withColumns({f"_m_{c}": rolling_median(F.col(f"_x_{c}"), frame) for c in cols})
    df = df.withColumns(
        {f"_d_{c}": log_ratio(F.col(f"_x_{c}"), F.col(f"_m_{c}")) for c in cols}
    )
    per_symbol = Window.partitionBy(SYMBOL)
    quarts = F.array(F.lit(0.25), F.lit(0.75))
    df = df.withColumns(
        {f"_q_{c}": F.percentile(f"_d_{c}", quarts).over(per_symbol) for c in cols}
    )

    def kept(c: str) -> Column:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        floor = 2.0 if c == "volume" else 0.5
        spread = F.greatest(factor * (q3 - q1), F.lit(floor))
        d = F.col(f"_d_{c}")
        return F.when((d >= q1 - spread) & (d <= q3 + spread), F.col(c))

    return fill_both(drop_scratch(df.withColumns({c: kept(c) for c in cols})))


def add_returns(df: DataFrame) -> DataFrame:
    """Simple and log return of the close."""
    prev = F.lag("close").over(series())
    return df.withColumns(
        {
            "Return": ratio(F.col("close"), prev) - 1,
            "Log_Return": log_ratio(F.col("close"), prev),
        }
    )


def fill_calendar(df: DataFrame, limit: int = 3) -> DataFrame:
    """Weekdays only, full business calendar, bounded forward fill, close known."""
    full = business_days(weekdays_only(df))
    return drop_missing_close(fill_forward(full, limit=limit))


def clean(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Full cleaning, one row per symbol and day. ``order`` names the columns that
    decide which row of a repeated day wins; without it a hash of the row's values
    does, so the choice is the same in every run. NaN counts as missing."""
    missing = F.lit(None).cast("double")
    doubles = double_columns(df)
    df = weekdays_only(df.withColumns({c: F.nanvl(F.col(c), missing) for c in OHLCV if c in doubles}))
    values = [c for c in df.columns if c not in (SYMBOL, DATE)]
    ranked = df if order else df.withColumn("_pick", F.xxhash64(*values))
    df = first_per_day(ranked, order or ["_pick"]).drop("_dropped", "_pick")
    return add_returns(repair_bad_ticks(fill_calendar(df)))


def nonfinite_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in (cols or double_columns(df))})


def complete(df: DataFrame, cols: list[str]) -> str:
    """Condition that no column of ``cols`` is null, NaN or infinite."""
    doubles = set(double_columns(df))
    return " AND ".join(
        f"abs(`{c}`) < double('infinity')" if c in doubles else f"`{c}` IS NOT NULL" for c in cols
    )


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null, NaN or infinity in any of ``cols`` (default: all)."""
    return df.filter(complete(df, cols or df.columns))


def data_expectations(df: DataFrame, first_year: int = 2000, last_year: int = 2024) -> DataFrame:
    """One row of rule results per symbol, from one two-step aggregate.

    Counting per day first keeps the duplicate test exact without a distinct
    aggregate over raw rows.
    """
    present = [c for c in OHLCV if c in df.columns]
    daily = df.groupBy(SYMBOL, DATE).agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present],
    )
    return daily.groupBy(SYMBOL).agg(
        F.sum("_rows").alias("n_rows"),
        F.sum(F.col("_rows") - 1).alias("n_duplicate_dates"),
        F.sum(F.when(F.weekday(DATE) >= 5, F.col("_rows")).otherwise(0)).alias("n_weekend_rows"),
        *[F.sum(f"_null_{c}").alias(f"n_null_{c}") for c in present],
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        ((F.year(F.min(DATE)) <= first_year) & (F.year(F.max(DATE)) >= last_year)).alias(
            "covers_years"
        ),
    )
