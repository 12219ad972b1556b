"""Stored panels and loads that can be repeated."""

import datetime as dt
import uuid

import pytest
from data import random_bars

from tidemark.operators import backtest
from tidemark.operators.panel import arrange
from tidemark.sources import bars as S
from tidemark.sources.stored import ChunkTable, open_panel, store_panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    names = columns or tuple(sorted(df.columns))
    return sorted(tuple(map(str, r)) for r in df.select(*names).collect())


@pytest.mark.parametrize("segment", [4096, 128])
def test_a_stored_panel_is_the_panel(spark, tmp_path, segment):
    bars = random_bars(spark, (900, 300, 1))
    panel = arrange(bars, rows=segment)
    name = f"panel_{uuid.uuid4().hex}"
    stored = store_panel(panel, name, f"{tmp_path}/panel", buckets=8)
    assert (stored.keys, stored.order, stored.rows, stored.segments) == (panel.keys, panel.order, panel.rows, panel.segments)
    assert rows(stored.df) == rows(panel.df)
    rounded = lambda df: rows(df.selectExpr("symbol", "strategy", "n_obs", "round(final_value, 9) AS r"))
    assert rounded(backtest.sma_sweep(open_panel(spark, name))) == rounded(backtest.sma_sweep(panel))
    assert len([f for f in (tmp_path / "panel").iterdir() if f.name.startswith("part-")]) <= 8


def test_a_sweep_over_a_stored_panel_neither_shuffles_nor_sorts(spark, tmp_path):
    stored = store_panel(arrange(random_bars(spark)), f"panel_{uuid.uuid4().hex}", f"{tmp_path}/panel", buckets=4)
    text = plan(backtest.sma_sweep(stored))
    assert "Exchange" not in text and "Sort [" not in text, text


def test_storing_again_replaces(spark, tmp_path):
    name = f"panel_{uuid.uuid4().hex}"
    store_panel(arrange(random_bars(spark)), name, f"{tmp_path}/panel")
    again = arrange(random_bars(spark, (20, 5), seed=3))
    assert rows(store_panel(again, name, f"{tmp_path}/panel").df) == rows(again.df)
    assert store_panel(arrange(random_bars(spark).limit(0)), name, f"{tmp_path}/panel").df.count() == 0


def test_only_stored_panels_open(spark, tmp_path):
    name = f"plain_{uuid.uuid4().hex}"
    random_bars(spark).write.option("path", f"{tmp_path}/plain").saveAsTable(name)
    with pytest.raises(ValueError, match="no stored panel"):
        open_panel(spark, name)


START, UNTIL = "2020-01-01", "2022-12-31"


def loads_at(path, bars):
    return ChunkTable(path, bars.schema, START, days=60, min_rows=5, grain="day")


def test_chunks_in_any_order_one_twice(spark, tmp_path):
    bars = random_bars(spark, (300, 37, 1))
    expected = rows(S.ingest_chunks(bars, START, 60, 5, grain="day"))
    loads = loads_at(f"{tmp_path}/t", bars)
    assert loads.read(spark).count() == 0 and loads.mark(spark, UNTIL) == dt.date(2020, 1, 1)
    everything = loads.pending(spark, UNTIL)
    assert everything == list(range(19))
    loads.load(bars, everything[5:])
    assert loads.pending(spark, UNTIL) == everything[:5] and loads.mark(spark, UNTIL) == dt.date(2020, 1, 1)
    loads.load(bars, [4, 3, 2, 0, 0])
    assert loads.pending(spark, UNTIL) == [1] and loads.mark(spark, UNTIL) == dt.date(2020, 3, 1)
    loads.load(bars, [])
    loads.load(bars, [1])
    loads.load(bars, [2])
    assert loads.pending(spark, UNTIL) == [] and loads.mark(spark, UNTIL) >= dt.date(2022, 12, 31)
    assert rows(loads.read(spark)) == expected
    assert "SortAggregate" not in plan(loads.read(spark))


def test_a_chunk_loaded_again_replaces_itself_only(spark, tmp_path):
    bars = random_bars(spark, (300, 37, 1))
    loads = loads_at(f"{tmp_path}/t", bars)
    loads.load(bars, range(19))
    changed = bars.selectExpr("symbol", "ts", "open", "high + 1 AS high", "low", "close", "volume", "vix")
    loads.load(changed, [1])
    second = S.chunk_number(START, 60) == 1
    expected = S.ingest_chunks(changed.where(second), START, 60, 5, grain="day").unionByName(
        S.ingest_chunks(bars.where(~second), START, 60, 5, grain="day")
    )
    assert rows(loads.read(spark)) == rows(expected)
    # Nothing comes any more: the chunk is empty, and loaded.
    loads.load(bars.limit(0), [1])
    assert rows(loads.read(spark)) == rows(S.ingest_chunks(bars.where(~second), START, 60, 5, grain="day"))
    assert loads.pending(spark, UNTIL) == []


def test_a_load_that_broke_off_is_pending(spark, tmp_path):
    bars = random_bars(spark, (300, 37, 1))
    loads = loads_at(f"{tmp_path}/t", bars)
    loads.load(bars, range(19))
    twice = bars.unionByName(bars)
    with pytest.raises(Exception, match="two bars of a series"):
        loads.load(twice, [2])
    assert loads.pending(spark, UNTIL) == [2]
    assert loads.read(spark).where("chunk = 2").count() == 0
    loads.load(bars, loads.pending(spark, UNTIL))
    assert rows(loads.read(spark)) == rows(S.ingest_chunks(bars, START, 60, 5, grain="day"))


def test_the_dates_of_a_load_reach_the_scan(spark, tmp_path):
    import pyspark.sql.functions as F

    bars = random_bars(spark)
    bars.write.parquet(f"{tmp_path}/b")
    loads = loads_at(f"{tmp_path}/t", bars)
    near = spark.read.parquet(f"{tmp_path}/b").where((F.col("ts") >= F.lit(loads.begins(1))) & (F.col("ts") < F.lit(loads.begins(2))))
    assert "GreaterThanOrEqual(ts,2020-03-01)" in plan(near)
