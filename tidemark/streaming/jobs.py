"""The same work on streams: bars from ticks, de-duplication, running indicators, scoring.

Each job takes and returns a streaming DataFrame; ``run_to_table`` drains what is there into a table.
"""

from __future__ import annotations

import datetime as dt
import math
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.learning import score_direction
from tidemark.session import scratch_path
from tidemark.sources.bars import bar_aggregates, moment


def stream_bars(
    ticks: DataFrame, symbol: str, ts: str, price: str, tick_id: str, grain: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Bars per tumbling window. A bar is emitted once the watermark passes its end; ticks later
    than that are dropped. When an archive is replayed in several batches, ``late`` must cover the disorder of its
    files (``replay_lateness``), or ticks of a file that is read late would be dropped."""
    at = moment(F.col("_at"), F.col(tick_id))
    timed = ticks.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    windowed = timed.groupBy(F.window("_at", grain), F.col(symbol).alias("symbol")).agg(*bar_aggregates(price, None, at))
    return windowed.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def replay_lateness(archive: DataFrame, ts: str) -> str:
    """A watermark delay under which no tick of the archive is late, in whatever order its files are read."""
    span = archive.agg((F.unix_seconds(F.max(F.col(ts).cast("timestamp"))) - F.unix_seconds(F.min(F.col(ts).cast("timestamp")))).alias("s"))
    return f"{(span.first()['s'] or 0) + 1} seconds"


def table_stream(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """The table ``name``.parquet of a folder as a stream, be it one file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_unique(rows: DataFrame, symbol: str, ts: str, late: str = "1 hour") -> DataFrame:
    """First arrival per symbol and timestamp; state older than the watermark is let go."""
    timed = rows.withColumn("ts", F.col(ts).cast("timestamp")).withColumnRenamed(symbol, "symbol")
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


_STATE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("close", "ema", "up", "down", "ranges", "atr")],
        T.StructField("budget", T.LongType()),
        T.StructField("at", T.LongType()),
    ]
)
_START = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)

#: Days of bars that a task holds of one symbol; a symbol has at most one bar per calendar slot.
CHUNK_DAYS = 256


class RunningIndicators(StatefulProcessor):
    """EMA, RSI, ATR and a held position of a symbol, carried in a few numbers.

    Rows of a micro-batch come in no order. If they come in one frame, which is bounded, they are taken in order of time. Otherwise
    they wait in the state store by stretches of the calendar, whose rows are few whatever the batch holds, and are taken stretch by
    stretch, each in order of time.
    """

    def __init__(self, span: int, rsi_rows: int, atr_rows: int, hold: int, signal_above: float, chunk_days: int):
        self.alpha, self.rsi_rows, self.atr_rows = 2.0 / (span + 1), rsi_rows, atr_rows
        self.hold, self.signal_above, self.width = hold, signal_above, chunk_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", _STATE)
        self.waiting = handle.getMapState("waiting", "chunk long, part long", "bars binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carried = tuple(self.running.get()) if self.running.exists() else _START
        first = next(rows)
        second = next(rows, None)
        if second is None:
            out, carried = self.advance(key[0], first, carried)
            yield out
            self.running.update(carried)
            return
        places: dict[int, list[int]] = {}
        part = 0
        for frame in chain((first, second), rows):
            days = pd.to_datetime(frame["ts"]).astype("datetime64[s]").astype("int64") // 86_400
            for chunk, own in frame.groupby(days.to_numpy() // self.width):
                self.waiting.updateValue((int(chunk), part), (pickle.dumps(own),))
                places.setdefault(int(chunk), []).append(part)
                part += 1
        for chunk in sorted(places):
            own = pd.concat([pickle.loads(self.waiting.getValue((chunk, p))[0]) for p in places[chunk]])
            for p in places[chunk]:
                self.waiting.removeKey((chunk, p))
            out, carried = self.advance(key[0], own, carried)
            yield out
        self.running.update(carried)

    def advance(self, symbol, rows: pd.DataFrame, carried: tuple) -> tuple[pd.DataFrame, tuple]:
        """The bars of one stretch, taken in order."""
        n, last, ema, up, down, ranges, atr, budget, at = carried
        times = rows["ts"].to_numpy()
        seconds = times.astype("datetime64[s]").astype("int64")
        order = seconds.argsort(kind="stable")
        highs, lows, closes = (rows[c].to_numpy(dtype=float)[order].tolist() for c in ("high", "low", "close"))
        emas, rsis, atrs, held = [], [], [], []
        for second, high, low, close in zip(seconds[order].tolist(), highs, lows, closes):
            if n and second <= at:
                raise ValueError(f"a bar of {symbol} at {times[order][len(held)]} came after a later one")
            move = close - last if n else 0.0
            reach = max(high - low, abs(high - last), abs(low - last)) if n else high - low
            ema = self.alpha * close + (1 - self.alpha) * ema if n else close
            up = (up * (self.rsi_rows - 1) + max(move, 0.0)) / self.rsi_rows
            down = (down * (self.rsi_rows - 1) + max(-move, 0.0)) / self.rsi_rows
            n += 1
            if n <= self.atr_rows:
                ranges += reach
                atr = ranges / self.atr_rows if n == self.atr_rows else 0.0
            else:
                atr = (atr * (self.atr_rows - 1) + reach) / self.atr_rows
            rsi = math.nan if n < self.rsi_rows else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            signal = rsi > self.signal_above
            held.append(1 if signal or budget > 0 else 0)
            budget = (budget or self.hold) if signal else max(budget - 1, 0)
            last, at = close, second
            emas.append(ema)
            rsis.append(rsi)
            atrs.append(atr)
        columns = {"symbol": symbol, "ts": times[order], "close": closes, "ema": emas, "rsi": rsis, "atr": atrs}
        return pd.DataFrame({**columns, "position": np.array(held, "int32")}), (n, last, ema, up, down, ranges, atr, budget, at)

    def close(self) -> None:
        pass


def stream_indicators(
    bars: DataFrame,
    span: int = 12,
    rsi_rows: int = 14,
    atr_rows: int = 5,
    hold: int = 5,
    signal_above: float = 60.0,
    chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """EMA, RSI, ATR and a held position per symbol. Within a micro-batch bars may come in any order; a bar that is not
    later than those of earlier batches is an error. The signal is RSI above a level. The state store must be one that
    keeps several states of a key, see ``run_to_table``."""
    schema = T.StructType(
        [
            bars.schema["symbol"],
            bars.schema["ts"],
            *[T.StructField(c, T.DoubleType()) for c in ("close", "ema", "rsi", "atr")],
            T.StructField("position", T.IntegerType()),
        ]
    )
    step = RunningIndicators(span, rsi_rows, atr_rows, hold, signal_above, chunk_days)
    return bars.groupBy("symbol").transformWithStateInPandas(step, schema, "append", "none")


def write_in_slices(bars: DataFrame, path: str, days: int) -> None:
    """Files in order of time: every ``days`` of the calendar are written after those before them, so a stream that reads a few
    files at a time meets each symbol's bars in order."""
    low, high = bars.agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    while low is not None and low <= high:
        until = low + dt.timedelta(days=days)
        bars.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(until))).write.mode("append").parquet(path)
        low = until


def stream_signals(features: DataFrame, model: PipelineModel, threshold: float = 0.3) -> DataFrame:
    """Probability and signal for each arriving feature row."""
    return score_direction(features, model, threshold)


def upsert_bars(ticks: DataFrame, path: str, checkpoint: str, columns: tuple[str, str, str, str], grain: str = "1 hour", late: str = "10 minutes") -> None:
    """Keep a table of all bars up to date, open ones too. ``columns``: symbol, time, price and id of the ticks.

    Every micro-batch writes the bars that it changed to a folder of its own, so a batch that is repeated after a failure
    replaces itself. ``latest_bars`` reads each bar as the last batch left it."""
    changed = stream_bars(ticks, *columns, grain, late)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _drained(changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint))


def latest_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars of ``upsert_bars``: hash tables, as a bar has one row in each batch that changed it."""
    rows = spark.read.parquet(path)
    values = [F.max_by(c, "batch").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.groupBy("symbol", "ts").agg(*values)


def compact_bars(spark: SparkSession, path: str, compacted: str) -> None:
    """The same table as the one batch 0 of another folder, for readers of a long stream."""
    latest_bars(spark, path).write.mode("overwrite").parquet(f"{compacted}/batch=0")


def count_unique(rows: DataFrame, symbol: str, ts: str, path: str, checkpoint: str, late: str = "1 hour") -> DataFrame:
    """Run ``stream_unique`` into a table and tell what became of the rows that arrived: (batch, arrived, kept, late,
    repeated) for every micro-batch of this run that brought rows. ``late`` rows are older than the watermark."""
    spark = rows.sparkSession
    unique = stream_unique(rows.observe("arrived", F.count(F.lit(1)).alias("n")), symbol, ts, late).observe("kept", F.count(F.lit(1)).alias("n"))
    query = _drained(unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    counts = {}
    for progress in query.recentProgress:
        observed, states = progress["observedMetrics"], progress["stateOperators"]
        dropped = sum(s["numRowsDroppedByWatermark"] for s in states)
        repeated = sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for s in states)
        if observed.get("arrived") and observed["arrived"]["n"]:
            counts[progress["batchId"]] = (progress["batchId"], observed["arrived"]["n"], observed["kept"]["n"], dropped, repeated)
    return spark.createDataFrame(list(counts.values()), "batch long, arrived long, kept long, late long, repeated long")


def _drained(writer):
    """Run a stream until it has processed what its sources hold, with its state on disk."""
    spark = SparkSession.active()
    before, kept = spark.conf.get(_STORE, None), spark.conf.get(_PROGRESS, None)
    spark.conf.set(_STORE, _ON_DISK)
    spark.conf.set(_PROGRESS, "100000")
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        for key, value in ((_STORE, before), (_PROGRESS, kept)):
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    return query


_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what the sources hold now, append it to a table and read that table. Both folders
    are shared ones; with the same checkpoint a later run goes on where this one stopped. State is kept on disk, so that it may be
    larger than memory."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    _drained(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(path)
