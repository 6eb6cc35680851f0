"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.evaluation import STRATEGY
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize(
    "name", ["E10_max_drawdown", "E12_metric_bundle", "E13_compare_models", "E14_evaluate_split", "S14_run_log"]
)
def test_drawdowns_after_a_loss_of_more_than_all_match_sql(spark, tmp_path, name):
    # Day 72 loses 99.95 %, right after an entry that costs 0.1 %; so the curve of ``arima`` falls below zero.
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT d AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey,
        1::INTEGER AS l_linenumber, 1::DOUBLE AS l_quantity,
        CASE WHEN d = 72 THEN 0.05 ELSE 100 + 3 * sin(d * 2.5) + d / 50 END::DOUBLE AS l_extendedprice,
        'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '2020-01-06' + to_days(((d // 5) * 7 + d % 5)::INT) AS l_shipdate
        FROM range(80) t(d)""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert con.execute(f"WITH {STRATEGY} SELECT count(*) FROM strategy WHERE strategy_return < -1").fetchone()[0] > 0
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"symbol", "split", "RMSE"} <= set(df.columns)
    assert df.count() == 18
