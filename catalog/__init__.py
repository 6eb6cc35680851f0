"""Queries over the test tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def fields(spec: str) -> list[tuple[str, str]]:
    """``"symbol date:d close:6 n:i"`` -> name and kind; kind s when left out."""
    out = []
    for token in spec.split():
        name, _, kind = token.partition(":")
        out.append((name, kind or "s"))
    return out


def tidy(df: DataFrame, spec: str) -> DataFrame:
    """Project to comparable types: text dates, rounded doubles, 64-bit integers."""
    cols = []
    for name, kind in fields(spec):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind.isdigit():
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def tidy_sql(body: str, spec: str, source: str) -> str:
    """The same projection around a SQL body that ends in CTE ``source``."""
    cols = []
    for name, kind in fields(spec):
        if kind == "d":
            cols.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind == "i":
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind.isdigit():
            cols.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0::DOUBLE AS {name}")
        else:
            cols.append(f"CAST({name} AS VARCHAR) AS {name}")
    return f"{body}\nSELECT {', '.join(cols)} FROM {source}"


def check(name: str, spec: str, sql: str | None = None, source: str = "result"):
    """Register a query under ``name``; ``sql`` is a WITH clause defining ``source``."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), spec)
        if sql is not None:
            ORACLES[name] = tidy_sql(sql, spec, source)
        return fn

    return add


def load() -> None:
    from . import (  # noqa: F401
        analysis,
        cleaning,
        evaluation,
        features,
        indicators,
        ingest,
        models,
        splits,
    )
