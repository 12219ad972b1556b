"""The physical plans are the ones we want."""

import pytest
from data import random_bars

from tidemark.operators import backtest
from tidemark.operators.panel import arrange
from tidemark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_bars_need(spark):
    text = plan(QUERIES["daily_bars"](spark, SF))
    read = [line for line in text.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert read and all("l_extendedprice" not in line and "l_tax" not in line for line in read)


def test_a_sweep_of_21_pairs_shuffles_once_after_the_bars(spark):
    text = plan(backtest.sma_sweep(arrange(random_bars(spark))))
    assert text.count("Exchange hashpartitioning") == 1, text
    assert text.count("Sort [") == 1


def test_period_filter_reaches_the_scan(spark, tmp_path):
    from tidemark.sources.bars import slice_periods

    random_bars(spark).write.parquet(str(tmp_path / "bars"))
    df = slice_periods(spark.read.parquet(str(tmp_path / "bars")), [(1, "2020-01-01", "2020-02-01")])
    assert "GreaterThanOrEqual(ts,2020-01-01)" in plan(df) and "LessThan(ts,2020-02-01)" in plan(df)


@pytest.mark.parametrize("name", ["sma_pairs_long_flat", "rule_library", "monthly_switching", "price_histogram", "event_feature_profile", "period_batch"])
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["held_positions", "confirmed_ema_pairs"])
def test_held_positions_stay_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF)).split("== Initial Plan ==")[0]
    assert "Pandas" not in text and "Python" not in text and "Arrow" not in text
    assert text.count("Exchange hashpartitioning") <= 3, text


@pytest.mark.parametrize("name", ["hourly_event_bars", "daily_trade_bars", "first_event_per_hour"])
def test_ticks_are_not_sorted(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text, text


@pytest.mark.parametrize(("name", "scans"), [("price_histogram", 2), ("prediction_report", 2), ("event_feature_profile", 3), ("context_thresholds", 2)])
def test_inputs_are_not_read_again_and_again(spark, name, scans):
    assert plan(QUERIES[name](spark, SF)).split("== Initial Plan ==")[0].count("FileScan") <= scans


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]


def test_periods_of_a_table_prune_at_run_time(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources.bars import join_periods, slice_periods

    bars = random_bars(spark, (900, 300, 1), gap=0.6)
    bars.withColumn("year", F.year("ts")).write.partitionBy("year").parquet(f"{tmp_path}/bars")
    parts = [(1, "2020-01-01", "2020-03-01"), (2, "2020-02-01", "2022-01-01"), (3, "2022-05-05", "2022-05-05"), (4, "2023-01-01", "2022-01-01")]
    spark.createDataFrame([*parts, (5, None, "2021-01-01")], "period int, start string, end string").write.parquet(f"{tmp_path}/periods")
    stored, periods = spark.read.parquet(f"{tmp_path}/bars"), spark.read.parquet(f"{tmp_path}/periods")
    sliced = join_periods(stored, periods)
    assert "dynamicpruning" in plan(sliced)
    rows = lambda df: sorted(map(tuple, df.select("symbol", "ts", "close", "period").collect()))
    expected = rows(slice_periods(bars, parts[:2]))
    assert expected and rows(sliced) == expected
    assert join_periods(stored, periods.limit(0)).count() == 0


def test_first_rows_by_one_number_are_not_sorted(spark):
    from tidemark.sources.bars import first_per_key

    bars = random_bars(spark)
    text = plan(first_per_key(bars, ("symbol", "ts"), ("volume",)))
    assert "SortAggregate" not in text and "HashAggregate" in text
