"""Source and sink queries. Text inputs are formatted from the bars themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketframe.functions.storage import shared_folder
from marketframe.sources import csv as src
from marketframe.sources import sinks

from . import check
from .bars import BARS, LINES, bars, lines, panel
from .cleaning import OHLCV_SPEC, PANEL
from .indicators import RUN


def scratch(spark, name: str) -> str:
    """A new folder for files a query writes, on the shared storage of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_text(df):
    """Bars as a provider would print them: odd headers, money signs, US dates."""
    return df.select(
        "symbol",
        F.date_format("date", "MM/dd/yyyy").alias(" Date "),
        F.concat(F.lit("$"), F.format_number("open", 10)).alias("OPEN"),
        F.format_number("high", 10).alias("High"),
        F.format_number("low", 10).alias("low "),
        F.concat(F.lit("$"), F.format_number("close", 10)).alias("Close"),
        F.format_number("volume", 0).alias("Volume"),
        F.lit("kept out").alias("Dividends"),
    )


FOUR = "symbol date:d " + " ".join(f"{c}:8" for c in ("open", "high", "low", "close", "volume"))
AS_READ = f"WITH {BARS}, result AS (SELECT * FROM bars)"


@check("S1_read_csv", FOUR + " source", f"WITH {BARS}, result AS (SELECT *, 'printed' AS source FROM bars)")
def read_csv(spark, sf):
    """Write the bars as provider text and read them back; a missing source is skipped."""
    path = scratch(spark, "csv")
    as_text(bars(spark, sf)).withColumn("Source", F.lit("printed")).write.option("header", True).csv(path)
    return src.load_sources(spark, {"gone": path + "/not-there", "bars": path})


@check("S2_standardise_columns", OHLCV_SPEC, AS_READ)
def standardise(spark, sf):
    df = bars(spark, sf)
    odd = df.select(
        "symbol", F.col("date").alias(" DATE"), F.col("open").alias("OPEN "), F.col("high").alias("High"),
        F.col("low").alias(" loW "), F.col("close").alias("Close"), F.col("volume").alias("VOLUME"),
    )
    return src.standardise_columns(odd)


@check(
    "S3_clean_number",
    "symbol date:d price:8 junk:4",
    f"WITH {LINES}, result AS (SELECT symbol, date, price, NULL::DOUBLE AS junk FROM lines)",
)
def clean_number(spark, sf):
    text = F.concat(F.lit(" $"), F.format_number("price", 10), F.lit(" "))
    return lines(spark, sf).select(
        "symbol", "date", src.clean_number(text).alias("price"), src.clean_number(F.concat(F.lit("n/a "), text)).alias("junk")
    )


@check(
    "S4_parse_date",
    "symbol date:d iso:d us:d stamp:d zoned:d junk:d",
    f"WITH {LINES}, result AS (SELECT symbol, date, date AS iso, date AS us, date AS stamp, date + 1 AS zoned, "
    "NULL::DATE AS junk FROM lines)",
)
def parse_date(spark, sf):
    d = F.col("date")
    forms = {
        "iso": F.date_format(d, "yyyy-MM-dd"),
        "us": F.date_format(d, "MM/dd/yyyy"),
        "stamp": F.date_format(d, "yyyy-MM-dd 23:59:59"),
        "zoned": F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T22:00:00-05:00")),
        "junk": F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd")),
    }
    return lines(spark, sf).select("symbol", "date", *[src.parse_date(x).alias(n) for n, x in forms.items()])


@check(
    "S5_default_label",
    "symbol source n:i",
    f"WITH {BARS}, result AS (SELECT symbol, 'quotes' AS source, count(*) AS n FROM bars GROUP BY symbol)",
)
def default_label(spark, sf):
    """Without a source column the label is the file's stem."""
    path = scratch(spark, "label")
    as_text(bars(spark, sf)).coalesce(1).write.option("header", True).csv(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    files.rename(part, hadoop.Path(path, "quotes.csv"))
    df = src.read_source(spark, f"{path}/quotes.csv")
    return df.groupBy("symbol", "source").agg(F.count("*").alias("n"))


@check("S6_canonical_projection", FOUR + " source", f"WITH {BARS}, result AS (SELECT *, NULL AS source FROM bars)")
def canonical(spark, sf):
    return src.canonical(src.standardise_columns(as_text(bars(spark, sf))))


# Two providers: finished and open lines of one symbol (the return flag).
PAIR = f"""{LINES},
pair AS (
  SELECT substr(symbol, 1, 1) AS symbol, date, CASE l_linestatus WHEN 'O' THEN 'feed NASDAQ' ELSE 'via Yahoo Finance' END AS source,
         arg_max(price, seq) AS close, sum(volume) AS volume
  FROM lines GROUP BY ALL)"""


def pair(spark, sf):
    df = lines(spark, sf).withColumn("symbol", F.substring("symbol", 1, 1))

    def one(status, label):
        rows = df.filter(F.col("l_linestatus") == status).groupBy("symbol", "date")
        return rows.agg(F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume")).withColumn(
            "source", F.lit(label)
        )

    return src.union_sources([one("O", "feed NASDAQ"), one("F", "via Yahoo Finance")])


@check("S7_union", "symbol date:d close:8 volume:6 source", f"WITH {PAIR}, result AS (SELECT * FROM pair)")
def union(spark, sf):
    return pair(spark, sf)


@check(
    "S8_priority_dedup",
    "symbol date:d close:8 volume:6 source",
    f"""WITH {PAIR}, result AS (
  SELECT * FROM pair QUALIFY row_number() OVER (
    PARTITION BY symbol, date ORDER BY CASE WHEN source LIKE '%Yahoo Finance%' THEN 0 WHEN source LIKE '%NASDAQ%' THEN 4 ELSE 5 END) = 1)""",
)
def priority(spark, sf):
    return src.resolve_sources(pair(spark, sf))


@check(
    "S9_first_in_file",
    "symbol date:d close:8",
    f"WITH {LINES}, result AS (SELECT symbol, date, arg_min(price, seq) AS close FROM lines GROUP BY symbol, date)",
)
def first_in_file(spark, sf):
    rows = lines(spark, sf).select(
        F.lit("one.csv").alias("_file"), F.col("seq").alias("_row"), "symbol", "date", F.col("price").alias("close")
    )
    return src.first_in_file(rows)


@check(
    "S10_fill_target",
    "symbol date:d close:8",
    f"""WITH {PANEL}, holes AS (SELECT symbol, date, CASE WHEN day(date) % 3 <> 0 THEN close END AS close FROM panel),
result AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER {RUN} AS close FROM holes)""",
)
def fill_target(spark, sf):
    holes = F.when(F.dayofmonth("date") % 3 != 0, F.col("close"))
    return src.fill_target(panel(spark, sf).withColumn("close", holes))


@check("S11_single_source", FOUR, AS_READ)
def single_source(spark, sf):
    path = scratch(spark, "single")
    as_text(bars(spark, sf)).write.option("header", True).csv(path)
    return src.load_one(spark, {"nasdaq": path}, "nasdaq")


@check(
    "S12_bars_sink",
    OHLCV_SPEC + " dividends:2 splits:2",
    f"""WITH {BARS}, result AS (
  SELECT symbol, date, open, high, low, close * CASE WHEN year(date) >= 2001 THEN 2 ELSE 1 END AS close, volume,
         0.0 AS dividends, 0.0 AS splits FROM bars)""",
)
def bars_sink(spark, sf):
    """Store the bars, merge a later batch in which closes of the last year changed."""
    path = scratch(spark, "bars")
    df = bars(spark, sf)
    sinks.write_bars(df, path)
    batch = df.filter(F.year("date") >= 2001).withColumn("close", F.col("close") * 2)
    return sinks.merge_bars(spark.read.parquet(path), batch)


@check(
    "S13_table_sink",
    "symbol n:i total:3",
    f"WITH {PANEL}, result AS (SELECT symbol, count(*) AS n, sum(close) AS total FROM panel GROUP BY symbol)",
)
def table_sink(spark, sf):
    path = scratch(spark, "table")
    table = panel(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total"))
    sinks.write_table(table, path)
    return spark.read.option("header", True).schema("symbol string, n bigint, total double").csv(path)
