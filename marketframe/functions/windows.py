"""Window specs and small column helpers.

Every per-series window is partitioned by ``symbol``. Bars are unique per
``(symbol, date)`` once ingested, so a partition never holds more rows than
there are days on the calendar (about 260 a year): no symbol can grow with the
data volume. Raw, non-unique input is only ever reduced by grouped aggregates
with map-side combine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DATE, SYMBOL

UNBOUNDED = Window.unboundedPreceding
INFINITY = float("inf")


class _Named:
    """Column by attribute: ``bar.close``."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


bar = _Named()


def series(*extra: str) -> WindowSpec:
    """The chronological window of one symbol (and of ``extra`` key columns)."""
    return Window.partitionBy(SYMBOL, *extra).orderBy(DATE)


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return (w or series()).rowsBetween(1 - n, 0)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(UNBOUNDED, 0)


def whole(w: WindowSpec | None = None) -> WindowSpec:
    """The whole partition, keeping the ordered spec so windows stay fused."""
    return (w or series()).rowsBetween(UNBOUNDED, Window.unboundedFollowing)


def nz(x: Column) -> Column:
    """Null instead of zero, for use as a divisor."""
    return F.nullif(x, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return a / nz(b)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(a / nz(b))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(x) < INFINITY, x)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "long", "integer", "short", "byte")
    return [f.name for f in df.schema if f.dataType.typeName() in kinds]


def drop_scratch(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def pick_rows(df: DataFrame, keys: list[str], order: str, first: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """The row with the smallest (largest) ``order`` per key, by a grouped aggregate.

    One ``min_by`` per column rather than one over a struct: fixed-width columns
    then keep the aggregation hash based on both sides of the shuffle. All of
    them follow the same comparisons, so they come from the same row.
    """
    by = F.min_by if first else F.max_by
    values = [c for c in df.columns if c not in keys]
    picked = [by(c, order).alias(c) for c in values]
    more = [x.alias(n) for n, x in (extra or {}).items()]
    return df.groupBy(*keys).agg(*picked, *more)


# SQL text twins, for wide projections: one parsed expression is much cheaper to
# build from Python than a tree of column calls.


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def sql_ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0D)"


def sql_log_ratio(a: str, b: str) -> str:
    return f"ln({sql_ratio(a, b)})"


def sql_over(fn: str, n: int | None = None, order: str = DATE) -> str:
    """``fn`` over the last ``n`` rows of a symbol (all rows so far without ``n``)."""
    start = "UNBOUNDED" if n is None else n - 1
    return (
        f"{fn} OVER (PARTITION BY {SYMBOL} ORDER BY {order} "
        f"ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"
    )


def sql_lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY {SYMBOL} ORDER BY {DATE})"


def with_sql(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """``withColumns`` for SQL text."""
    return df.withColumns({name: F.expr(e) for name, e in exprs.items()})


def median_of(sorted_values: Column) -> Column:
    """Median of an already sorted array; null for an empty one."""
    n = F.size(sorted_values)
    lo = F.try_element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(sorted_values, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def rolling_median(x: Column, w: WindowSpec) -> Column:
    """Median inside a row frame (the built-in median takes no frame)."""
    return median_of(F.sort_array(F.collect_list(x).over(w)))


def sample_skew(g: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population form and the count."""
    return F.when(n > 2, g * F.sqrt(n * (n - 1.0)) / nz(n - 2.0))


def sample_kurtosis(g: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population form and the count."""
    return F.when(
        n > 3, ((n + 1.0) * g + 6.0) * (n - 1.0) / nz((n - 2.0) * (n - 3.0))
    )


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / nz(std)
    return F.exp(-0.5 * z * z) / (nz(std) * math.sqrt(2 * math.pi))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )
