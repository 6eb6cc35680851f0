"""Shape of the physical plans: shuffles, joins, pruning, skewed input."""

from __future__ import annotations

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
import catalog
from catalog.bars import bars, panel
from marketframe.functions.storage import materialise, shared_folder
from marketframe.operators.clean import clean, first_per_day
from marketframe.operators.features import make_model_frame
from marketframe.sources.csv import resolve_sources

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, operator: str) -> int:
    return len(re.findall(rf"(?<![A-Za-z]){operator}(?![A-Za-z])", plan(df)))


def test_cleaning_and_all_features_share_one_shuffle_by_symbol(spark):
    df = make_model_frame(clean(bars(spark, SF)))
    assert count(df, "FileScan") == 1
    assert count(df, "Exchange") == 2  # the bars' own aggregation, then by symbol
    assert count(df, "SortMergeJoin") + count(df, "BroadcastHashJoin") == 0
    assert count(df, "Sort") <= 4


# Queries that run jobs of their own (writes, fits) while they are built.
ACTIONS = ("S1_", "S5_", "S11_", "S12_", "S13_", "G", "L1_", "H1_", "H2_", "H4_", "H6_")


@pytest.mark.parametrize("family", sorted({n[0] for n in catalog.QUERIES}))
def test_no_query_needs_a_cross_or_nested_loop_join(spark, family):
    names = [n for n in catalog.QUERIES if n[0] == family and not n.startswith(ACTIONS)]
    for name in names:
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_the_columns_it_needs(spark):
    text = plan(bars(spark, SF).select("symbol", "date", "volume"))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"}


def test_last_rows_are_pruned_before_the_shuffle(spark):
    from marketframe.plans.forecast import last_rows

    assert count(last_rows(panel(spark, SF), 5), "WindowGroupLimit") >= 1


def test_copies_of_a_hot_day_are_combined_before_the_shuffle(spark):
    hot = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("symbol"),
        F.lit("2020-01-02").cast("date").alias("date"),
        F.col("id").alias("seq"),
        (F.col("id") % 97).cast("double").alias("close"),
    )
    got = first_per_day(hot, ["seq"])
    assert count(got, "HashAggregate") == 2 and count(got, "Window") == 0
    rows = {r.symbol: r for r in got.collect()}
    assert rows["HOT"].close == 0.0 and rows["HOT"]._dropped == 99_999
    both = resolve_sources(
        hot.select("symbol", "date", "close", F.lit("x").alias("source"), F.col("seq").cast("int").alias("_source_no"))
    )
    assert both.filter("symbol = 'HOT'").first().close == 0.0


def test_written_results_live_in_the_shared_folder(spark):
    df = materialise(spark.range(5).withColumn("x", F.lit(1.5)))
    assert df.count() == 5 and df.schema["x"].dataType.typeName() == "double"
    assert all(shared_folder(spark) in f.replace("file:", "").replace("///", "/") for f in df.inputFiles())


def test_a_repeated_day_does_not_break_the_calendar(spark):
    from marketframe.operators.clean import business_days

    days = pd.to_datetime(["2020-01-02", "2020-01-02", "2020-01-07"]).date
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": days, "close": [1.0, 2.0, 3.0]}))
    got = [str(r.date) for r in business_days(df).orderBy("date").collect()]
    assert got == ["2020-01-02", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"]
