"""Price files from several providers, read, standardised and reconciled."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COLUMN_ALIASES, DATE, OHLCV, SOURCE_PRIORITY, SYMBOL
from ..functions.windows import running

log = logging.getLogger(__name__)

# Accepted date layouts as (shape, layout, carries a zone offset).
DATE_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", False),
    (r"^\d{8}$", "yyyyMMdd", False),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm", False),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", False),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd HH:mm:ssXXX", True),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", False),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", False),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", False),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[','] yyyy", False),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", "MMMM d[','] yyyy", False),
    (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", "d[ ]['-']MMM[ ]['-']yyyy", False),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy", False),
)


def standardise_columns(df: DataFrame) -> DataFrame:
    """Trim header names and map them, whatever their case, to the canonical set."""
    names = []
    for c in df.columns:
        key = c.strip()
        names.append(COLUMN_ALIASES.get(key.lower(), key.lower() if key.lower() in ("source", SYMBOL) else key))
    return df.toDF(*names)


def clean_number(c: Column) -> Column:
    """Money text to double: ``$`` and ``,`` stripped, anything else unreadable is null."""
    text = F.trim(F.regexp_replace(c.cast("string"), "[$,]", ""))
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def parse_date(c: Column) -> Column:
    """Date of a text in any accepted layout, in UTC when it carries an offset.

    The shape of the text picks the one layout it is parsed with: trying layouts
    in turn would pay for a failed parse per row and layout. The text is bound by
    ``transform``, as an expression would be repeated for each layout.
    """

    def tidied(t: Column) -> Column:
        # A "T" before the time, fractions of a second and offsets without a colon change no day.
        timed = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
        timed = F.regexp_replace(timed, r"(:\d{2})[.,]\d{1,9}", "$1")
        timed = F.regexp_replace(timed, r"(:\d{2}) ?([+-]\d{2}):?(\d{2})$", "$1$2:$3")
        return F.when(F.length(t) > 10, timed).otherwise(t)

    def parsed(t: Column) -> Column:
        out = F.lit(None).cast("date")
        for shape, layout, zoned in reversed(DATE_LAYOUTS):
            stamp = F.try_to_timestamp(t, F.lit(layout))
            if zoned:
                stamp = F.to_utc_timestamp(stamp, F.current_timezone())
            out = F.when(t.rlike(shape), F.to_date(stamp)).otherwise(out)
        return out

    return F.transform(F.transform(F.array(F.trim(c.cast("string"))), tidied), parsed)[0]


def canonical(df: DataFrame, default_source: Column | None = None) -> DataFrame:
    """Typed canonical columns of a standardised raw frame.

    Keeps the OHLCV columns that are there and the source label; rows without a
    readable date are dropped. Scratch columns (``_...``) and the symbol pass.
    """
    prices = [clean_number(F.col(c)).alias(c) for c in OHLCV if c in df.columns]
    label = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    if default_source is not None:
        label = F.coalesce(label, default_source)
    passed = [c for c in df.columns if c.startswith("_") or c == SYMBOL]
    # A filter on the date would move below an aggregate by date and parse all its raw rows.
    readable = F.explode(F.filter(F.array(parse_date(F.col(DATE))), lambda d: d.isNotNull()))
    return df.select(*passed, readable.alias(DATE), *prices, label.alias("source"))


def unreadable_dates(raw: DataFrame) -> DataFrame:
    """``date, rows``: the date texts of a standardised raw frame that no layout fits,
    which :func:`canonical` drops, and how often they occur."""
    lost = raw.filter(parse_date(F.col(DATE)).isNull())
    return lost.groupBy(DATE).agg(F.count("*").alias("rows"))


def file_stem(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def read_source(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame | None:
    """One CSV file or folder; None (with a warning) when there is nothing to read.

    The file is read as text without an inference pass. Files of one folder must have
    one header: another order of columns is an error, not a silent swap. The first row of a day
    in a file wins; position in the file is its block offset and the row's order
    inside the scan.
    """
    try:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as exc:
        log.warning("cannot read %s, skipping: %s", path, exc.getCondition() or exc)
        return None
    if not raw.columns:
        log.warning("empty file: %s", path)
        return None
    raw = standardise_columns(
        raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    )
    if DATE not in raw.columns:
        log.error("no date column in %s", path)
        return None
    df = canonical(raw, file_stem(F.col("_file")))
    if SYMBOL not in df.columns:
        df = df.withColumn(SYMBOL, F.lit(symbol or "series"))
    return first_in_file(df)


def first_in_file(df: DataFrame) -> DataFrame:
    """Keep the first row per file, symbol and date."""
    values = [c for c in (*OHLCV, "source") if c in df.columns]
    first = df.groupBy("_file", SYMBOL, DATE).agg(F.min_by(F.struct(*values), "_row").alias("_v"))
    return first.select(SYMBOL, DATE, *[F.col("_v")[c].alias(c) for c in values])


def source_rank(label: Column, priority: tuple[str, ...] = SOURCE_PRIORITY) -> Column:
    """Position of the first listed name the label contains; unknown labels last."""
    text = F.coalesce(label, F.lit(""))
    rank = F.lit(len(priority))
    for i in reversed(range(len(priority))):
        rank = F.when(text.contains(priority[i]), i).otherwise(rank)
    return rank


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources stacked, with the number of the source in ``_source_no``."""
    if not frames:
        raise RuntimeError("no data loaded: check the source paths")
    marked = [f.withColumn("_source_no", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def resolve_sources(df: DataFrame, priority: tuple[str, ...] = SOURCE_PRIORITY) -> DataFrame:
    """One row per (symbol, date): the best-ranked source, then the earlier one.

    Without a source column the first source wins. The winner is a grouped
    ``min_by``: copies of a day are combined before the shuffle.
    """
    rank = source_rank(F.col("source"), priority) if "source" in df.columns else F.lit(0)
    values = [c for c in df.columns if c not in (SYMBOL, DATE, "_source_no")]
    best = df.groupBy(SYMBOL, DATE).agg(
        F.min_by(F.struct(*values), F.struct(rank, F.col("_source_no"))).alias("_v")
    )
    return best.select(SYMBOL, DATE, *[F.col("_v")[c].alias(c) for c in values])


def fill_target(df: DataFrame) -> DataFrame:
    """Missing closes take the last known one, however far back."""
    return df.withColumn("close", F.last("close", ignorenulls=True).over(running()))


def missing_target(df: DataFrame) -> DataFrame:
    """Number of missing closes per symbol, before filling."""
    return df.groupBy(SYMBOL).agg(F.count_if(F.col("close").isNull()).alias("n_missing"))


def load_sources(spark: SparkSession, paths: dict[str, str], symbol: str | None = None) -> DataFrame:
    """All configured sources, reconciled to one bar per symbol and date."""
    frames = [read_source(spark, p, symbol) for p in paths.values()]
    return fill_target(resolve_sources(union_sources([f for f in frames if f is not None])))


def load_one(spark: SparkSession, paths: dict[str, str], name: str, symbol: str | None = None) -> DataFrame:
    """A single named source; an error when it cannot be read."""
    df = read_source(spark, paths[name], symbol) if name in paths else None
    if df is None:
        raise FileNotFoundError(f"source {name!r} not found at {paths.get(name)}")
    return df
