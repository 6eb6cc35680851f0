"""CSV sources, sinks and the streaming update."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketframe.models import ar
from marketframe.sources import csv as src
from marketframe.sources import sinks
from marketframe.streaming.online import start_online_predictions


def put(path, text):
    path.write_text(text)
    return str(path)


def test_sources_are_reconciled(spark, tmp_path):
    paths = {
        "master": put(
            tmp_path / "master.csv",
            "Date,Open,High,Low,Close,Volume,Source\n"
            "2020-01-02,1,2,0.5,1.5,100,MarketWatch\n"
            "2020-01-02,9,9,9,9,9,MarketWatch\n"
            "2020-01-03,1,2,0.5,,100,MarketWatch\n",
        ),
        "yahoo": put(
            tmp_path / "quotes.csv",
            " date , CLOSE \n01/02/2020,\"$1,234.50\"\n01/06/2020,oops\nnot a date,5\n",
        ),
        "best": put(tmp_path / "b.csv", "Date,Close,Source\n2020-01-02,7,Yahoo Finance (adj)\n"),
        "empty": put(tmp_path / "empty.csv", ""),
        "dateless": put(tmp_path / "dateless.csv", "a,b\n1,2\n"),
        "gone": str(tmp_path / "gone.csv"),
    }
    got = {r.date: r for r in src.load_sources(spark, paths, "AAA").collect()}
    assert sorted(got) == [dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2020, 1, 6)]
    assert got[dt.date(2020, 1, 2)].close == 7.0 and got[dt.date(2020, 1, 2)].open is None
    assert got[dt.date(2020, 1, 3)].close == 7.0  # carried forward
    assert got[dt.date(2020, 1, 6)].source == "quotes" and got[dt.date(2020, 1, 6)].close == 7.0
    one = src.load_one(spark, paths, "yahoo").orderBy("date").collect()
    assert one[0].close == 1234.5 and len(one) == 2
    first = src.load_one(spark, paths, "master").orderBy("date").first()
    assert first.close == 1.5


@pytest.mark.parametrize("text", [
    "2020-03-09", "20200309", "2020-03-09 14:30", "2020-03-09T14:30:05", "2020-03-09 14:30:05.123456", "2020-03-09T14:30:05.5Z",
    "2020-03-09T14:30:05+0100", "2020-03-09 14:30:05 -05:00", "3/9/2020", "2020/3/9", "Mar 9, 2020", "March 9, 2020", "9 Mar 2020", "9-Mar-2020",
    "9 March 2020",
])
def test_date_layouts(spark, text):
    df = spark.createDataFrame([(text,)], "Date string")
    assert df.select(src.parse_date(F.col("Date")).alias("d")).first().d == dt.date(2020, 3, 9)


def test_unreadable_dates_are_counted(spark):
    raw = spark.createDataFrame([("soon", "1"), ("soon", "2"), ("2020-01-02", "3")], "date string, close string")
    assert [tuple(r) for r in src.unreadable_dates(raw).collect()] == [("soon", 2)]


def test_files_of_one_folder_must_share_a_header(spark, tmp_path):
    (tmp_path / "two").mkdir()
    put(tmp_path / "two" / "a.csv", "Date,Open,Close\n2020-01-02,1,2\n")
    put(tmp_path / "two" / "b.csv", "Date,Close,Open\n2020-01-03,2,1\n")
    with pytest.raises(Exception, match="header"):
        src.read_source(spark, str(tmp_path / "two"), "A").collect()


def test_missing_sources_are_errors(spark, tmp_path):
    with pytest.raises(RuntimeError):
        src.load_sources(spark, {"a": str(tmp_path / "a.csv")})
    with pytest.raises(FileNotFoundError):
        src.load_one(spark, {}, "master")


def test_offset_dates_are_utc_in_any_session_zone(spark):
    df = spark.createDataFrame([("2020-01-02T22:00:00-05:00", "2020-01-02")], "a string, b string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = df.select(*[src.parse_date(F.col(c)).cast("string").alias(c) for c in "ab"]).first()
            assert (got.a, got.b) == ("2020-01-03", "2020-01-02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_every_date_layout_is_read(spark):
    texts = {
        "2020-01-02": "2020-01-02", "2020-01-02 10:11:12": "2020-01-02", "2020-01-02T10:11:12": "2020-01-02",
        "2020-01-02 23:00:00-05:00": "2020-01-03", "2020-01-02T23:00:00Z": "2020-01-02",
        "1/2/2020": "2020-01-02", "12/31/2020": "2020-12-31", "01-02-2020": "2020-01-02",
        "2020/1/2": "2020-01-02", "Jan 2, 2020": "2020-01-02", " 2020-01-02 ": "2020-01-02",
        "13/01/2020": None, "2020-02-30": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r.t: r.d for r in df.select("t", src.parse_date(F.col("t")).cast("string").alias("d")).collect()}
    assert got == texts


def test_bars_round_trip_and_merge(spark, sample, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_bars(sample.withColumn("source", F.lit("s")), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 300 and {"dividends", "splits"} <= set(stored.columns)
    batch = sample.limit(1).withColumn("close", F.lit(-1.0)).withColumn("source", F.lit("t"))
    merged = sinks.merge_bars(stored, batch)
    assert merged.count() == 300 and merged.filter("close = -1").count() == 1
    sinks.write_bars(sample, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 300


def test_run_log_drops_non_finite(spark, tmp_path):
    rows = [("A", "m", 1.0, float("nan")), ("A", "n", None, 2.0)]
    metrics = spark.createDataFrame(rows, "symbol string, model string, MAE double, RMSE double")
    log = sinks.run_log(metrics, "r")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 4 and {r.metric for r in got.collect()} == {"m_MAE", "n_RMSE"}
    assert sinks.run_params(spark, "r", {"ratio": 0.7}).first().value == "0.7"


def test_stream_updates_state_and_predicts(spark, sample, tmp_path):
    params = ar.fit_log(sample, (1, 1, 0)).persist()
    days = [r.date for r in sample.select("date").orderBy("date").collect()]
    history = sample.filter(F.col("date") < days[298])
    feed = tmp_path / "feed"
    for i, d in enumerate(days[298:]):
        sample.filter(F.col("date") == d).select("symbol", "date", "close").coalesce(1).write.mode(
            "append"
        ).parquet(str(feed))
    stream = (
        spark.readStream.schema("symbol string, date date, close double")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(feed))
    )
    query = start_online_predictions(
        stream, history, params, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "chk"),
        replaceable=1, available_now=True,
    )
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    assert len(got) == 2
    whole = ar.one_step_predictions(sample, params, terms=1).filter(F.col("date") == days[299]).first()
    assert got[0].predicted == pytest.approx(whole.predicted) and got[0].date == days[299]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_text_is_tidied_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    assert optimized(df.select(src.parse_date(F.col("t")).alias("d"))).count("regexp_replace(") == 3


def test_dates_are_parsed_above_the_aggregate_they_come_from(spark):
    raw = spark.range(9).select(F.concat(F.lit("2020-03-0"), F.col("id") % 3 + 1).alias("date"), "id")
    got = src.canonical(raw.groupBy("date").agg(F.max("id").cast("string").alias("close")))
    assert "RLIKE" not in optimized(got).upper().split("AGGREGATE", 1)[1]
    assert sorted(r.close for r in got.collect()) == [6.0, 7.0, 8.0]
