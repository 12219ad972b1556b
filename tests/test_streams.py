"""Streams over tables of several files give what the batch job gives."""

import pandas as pd
import pytest
from data import random_bars
from pyspark.sql import functions as F

from tidemark.plans.queries import QUERIES
from tidemark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as a folder of part files, in no order of time."""
    path = tmp_path_factory.mktemp("tables")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(6, "event_id").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["streamed_bars", "streamed_unique_hours"])
def test_a_folder_table_gives_the_rows_of_a_file_table(spark, folder, name):
    one, many = (sorted(map(tuple, QUERIES[name](spark, place).collect()), key=str) for place in (SF, folder))
    assert one and one == many


def test_a_replay_in_many_batches_loses_no_tick(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    late = J.replay_lateness(events, "ts")
    hours = J.table_stream(spark, folder, "events", maxFilesPerTrigger="1")
    hours = hours.select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    got = J.run_to_table(J.stream_unique(hours, "event_type", "hour", late)).select("symbol", "ts").collect()
    expected = events.select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp"))).distinct().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


COLUMNS = ["symbol", "ts", "close", "ema", "rsi", "atr", "position"]


def indicators(spark, folder, files, out=None, checkpoint=None, **options):
    bars = spark.readStream.schema("symbol string, ts date, high double, low double, close double").option("maxFilesPerTrigger", files).parquet(folder)
    return J.run_to_table(J.stream_indicators(bars, **options), out, checkpoint)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def bars(spark):
    return random_bars(spark, (400, 37, 1)).select("symbol", "ts", "high", "low", "close")


def test_running_indicators_do_not_depend_on_batches_chunks_or_order(spark, bars, tmp_path):
    J.write_in_slices(bars.repartition(3), f"{tmp_path}/slices", 200)
    bars.orderBy(F.rand(3)).coalesce(1).write.parquet(f"{tmp_path}/whole")
    whole = rows_of(indicators(spark, f"{tmp_path}/whole", "1"))
    assert len(whole) == 438
    # One batch in no order, cut into stretches of a few days, and many batches.
    assert rows_of(indicators(spark, f"{tmp_path}/whole", "1", chunk_days=9)) == whole
    assert rows_of(indicators(spark, f"{tmp_path}/slices", "3")) == whole


def test_running_indicators_go_on_after_a_restart(spark, bars, tmp_path):
    half = F.lit("2020-12-01").cast("date")
    out, checkpoint, folder = (f"{tmp_path}/{n}" for n in ("out", "checkpoint", "bars"))
    bars.where(F.col("ts") < half).write.parquet(folder)
    first = indicators(spark, folder, "50", out, checkpoint).count()
    bars.where(F.col("ts") >= half).write.mode("append").parquet(folder)
    both = rows_of(indicators(spark, folder, "50", out, checkpoint))
    bars.coalesce(1).write.parquet(f"{tmp_path}/whole")
    assert 0 < first < len(both) and both == rows_of(indicators(spark, f"{tmp_path}/whole", "1"))


def test_a_bar_that_comes_after_a_later_one_is_an_error(spark, bars, tmp_path):
    late = bars.where("symbol = 's0'")
    late.where("ts >= date'2020-06-01'").coalesce(1).write.parquet(f"{tmp_path}/bars")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    indicators(spark, f"{tmp_path}/bars", "1", out, checkpoint)
    late.where("ts < date'2020-06-01'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    with pytest.raises(Exception, match="came after a later one"):
        indicators(spark, f"{tmp_path}/bars", "1", out, checkpoint)


TICKS = ("event_type", "ts", "value", "event_id")


def ticks(spark, folder, files):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def test_open_bars_survive_restarts_and_repeated_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1)
    folder, path, checkpoint = (f"{tmp_path}/{n}" for n in ("ticks", "bars", "checkpoint"))
    halves = [events.where(F.col("event_id") % 2 == i) for i in range(2)]
    late = J.replay_lateness(events, "ts")
    halves[0].write.parquet(folder)
    J.upsert_bars(ticks(spark, folder, "1"), path, checkpoint, TICKS, late=late)
    some = J.latest_bars(spark, path).agg(F.sum("volume")).first()[0]
    halves[1].write.mode("append").parquet(folder)
    J.upsert_bars(ticks(spark, folder, "1"), path, checkpoint, TICKS, late=late)
    expected = sorted(map(tuple, QUERIES["hourly_event_bars"](spark, SF).select("symbol", "ts", "open", "high", "low", "close", "volume").collect()), key=str)

    def bars(place):
        read = J.latest_bars(spark, place).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        return sorted(map(tuple, read.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()), key=str)

    assert 0 < some < sum(r[-1] for r in expected) and bars(path) == expected
    # The last batch once more, as after a failure between its write and its commit.
    (last,) = spark.read.parquet(path).agg(F.max("batch")).first()
    spark.read.parquet(f"{path}/batch={last}").cache().write.mode("append").parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").write.mode("overwrite").parquet(f"{path}/batch={last}")
    assert bars(path) == expected
    J.compact_bars(spark, path, f"{tmp_path}/one")
    assert bars(f"{tmp_path}/one") == expected


def test_every_row_of_the_unique_stream_is_accounted_for(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    middle = events.agg(F.expr("percentile_approx(hour, 0.5)")).first()[0]
    newer, older = events.where(F.col("hour") >= F.lit(middle)), events.where(F.col("hour") < F.lit(middle))
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("rows", "out", "checkpoint"))
    counted = []
    for part in (newer, older):  # the older half comes when the watermark has passed it
        part.coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(events.schema).parquet(folder)
        counted += [r.asDict() for r in J.count_unique(arriving, "event_type", "hour", out, checkpoint).collect()]
    total = {k: sum(r[k] for r in counted) for k in ("arrived", "kept", "late", "repeated")}
    assert total["arrived"] == events.count() == total["kept"] + total["late"] + total["repeated"]
    assert total["kept"] == spark.read.parquet(out).count() and total["late"] > 0
    assert counted[0]["kept"] == newer.distinct().count()


def test_bars_of_one_frame_do_not_wait_in_the_state_store(spark):
    """Each row of a map state is a way to the store and back; a symbol's bars of one frame need none."""

    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    frame = pd.DataFrame({"symbol": "x", "ts": pd.to_datetime(["2024-01-03", "2024-01-01", "2024-01-02"]), "high": 2.0, "low": 1.0, "close": [3.0, 1.0, 2.0]})
    step = J.RunningIndicators(12, 2, 5, 5, 60.0, 1)
    step.running, step.waiting = Kept(), None
    (out,) = step.handleInputRows(("x",), iter([frame]), None)
    assert out["close"].tolist() == [1.0, 2.0, 3.0] and out["rsi"].tolist()[1:] == [100.0, 100.0] and out["rsi"].isna()[0]
    with pytest.raises(ValueError, match="came after a later one"):
        list(step.handleInputRows(("x",), iter([frame]), None))
