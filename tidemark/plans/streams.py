"""Streaming jobs drained over the driver's tables; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learning as M
from tidemark.plans.base import bars_sql, daily, query, q6, recurrence_sql, rounded, wilder_step, ema_step
from tidemark.plans.base import ATR_STEP, NUMBERED_SQL, RANGED_SQL, RSI
from tidemark.plans.models import frame
from tidemark.session import cut, scratch_path
from tidemark.sources.tables import write_table
from tidemark.streaming import jobs as J


def _events(spark, sf_dir):
    return J.table_stream(spark, sf_dir, "events")


def _naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """WITH hourly AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT * FROM hourly WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def streamed_bars(spark, sf_dir):
    """Hourly bars from the event stream; bars the watermark has not closed are still open."""
    return _naive(J.run_to_table(J.stream_bars(_events(spark, sf_dir), "event_type", "ts", "value", "event_id")))


@query("SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events")
def streamed_unique_hours(spark, sf_dir):
    """One row per event type and hour of the stream."""
    hours = _events(spark, sf_dir).select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    return _naive(J.run_to_table(J.stream_unique(hours, "event_type", "hour").select("symbol", "ts")))


@query(
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""
)
def streamed_open_bars(spark, sf_dir):
    """Every hour's bar as the stream left it, also those that more ticks could still change."""
    path = scratch_path(spark, "open-bars")
    J.upsert_bars(_events(spark, sf_dir), path, scratch_path(spark, "stream-state"), ("event_type", "ts", "value", "event_id"))
    return _naive(J.latest_bars(spark, path))


@query(
    """SELECT count(*) AS arrived, count(DISTINCT (event_type, date_trunc('hour', ts))) AS kept,
count(*) - count(DISTINCT (event_type, date_trunc('hour', ts))) AS dropped FROM events"""
)
def streamed_hour_counts(spark, sf_dir):
    """What became of the rows of the stream's de-duplication."""
    hours = _events(spark, sf_dir).select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    counts = J.count_unique(hours, "event_type", "hour", scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))
    return counts.agg(F.sum("arrived").alias("arrived"), F.sum("kept").alias("kept"), F.sum(F.col("late") + F.col("repeated")).alias("dropped"))


def _bar_stream(spark, sf_dir):
    """The supplier panel as files of 512 days each, read a few at a time."""
    path = scratch_path(spark, "bars")
    bars = cut(daily(spark, sf_dir).select("symbol", "ts", "high", "low", "close"), "panel")
    J.write_in_slices(bars.coalesce(4), path, 512)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", "4").parquet(path)


_STEPS = {"ema": ema_step("ema", 12), "au": wilder_step("au", 14, "up"), "ad": wilder_step("ad", 14, "down"), "atr": ATR_STEP}


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {RANGED_SQL}, {recurrence_sql('states', 'ranged', _STEPS)},
rated AS MATERIALIZED (SELECT n.symbol, n.rn, n.ts, n.close, ema, atr, {RSI.replace('rn >=', 'n.rn >=')} AS rsi,
  CASE WHEN {RSI.replace('rn >=', 'n.rn >=')} > 60 THEN 1 ELSE 0 END AS s FROM ranged n JOIN states e ON e.symbol = n.symbol AND e.rn = n.rn),
{recurrence_sql('held', 'rated', {'p': ('n.s', 'CASE WHEN n.s = 1 OR e.b > 0 THEN 1 ELSE 0 END'),
    'b': ('CASE WHEN n.s = 1 THEN 5 ELSE 0 END', 'CASE WHEN n.s = 1 THEN (CASE WHEN e.b = 0 THEN 5 ELSE e.b END) ELSE greatest(e.b - 1, 0) END')})}
SELECT r.symbol, r.ts, close, {q6('ema')}, {q6('rsi')}, {q6('atr')}, p AS position FROM rated r JOIN held h ON h.symbol = r.symbol AND h.rn = r.rn"""
)
def streamed_indicators(spark, sf_dir):
    """EMA, RSI, ATR and a held position carried as state."""
    return rounded(J.run_to_table(J.stream_indicators(_bar_stream(spark, sf_dir))), "close")


@query()
def streamed_signals(spark, sf_dir):
    """A trained model on a stream of feature rows."""
    rows = frame(spark, sf_dir)
    model = M.train(rows.where("target IS NOT NULL"), M.DIRECTION_FEATURES, "target", M.DIRECTION)
    path = scratch_path(spark, "features")
    write_table(rows, path)
    arriving = spark.readStream.schema(rows.schema).parquet(path)
    return J.run_to_table(J.stream_signals(arriving, M.node_table(spark, model)).select("symbol", "ts", "proba", "signal"))


@query(
    f"""WITH {bars_sql()}, numbered AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)
SELECT symbol, ts, TRUE AS same_proba, TRUE AS same_signal FROM numbered WHERE rn >= 34"""
)
def streamed_signals_exact(spark, sf_dir):
    """Rows scored as they arrive, a few files at a time, against the batch scores of the library's own model."""
    rows = frame(spark, sf_dir)
    model = M.train(rows.where("target IS NOT NULL"), M.DIRECTION_FEATURES, "target", M.DIRECTION)
    path = scratch_path(spark, "features")
    write_table(rows, path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "4").parquet(path)
    streamed = J.run_to_table(J.stream_signals(arriving, M.node_table(spark, model)).select("symbol", "ts", "proba", "signal"))
    batch = M.score_direction(rows, model).select("symbol", "ts", F.col("proba").alias("p"), F.col("signal").alias("s"))
    joined = streamed.join(batch, ["symbol", "ts"])
    return joined.select("symbol", "ts", (F.col("proba") == F.col("p")).alias("same_proba"), (F.col("signal") == F.col("s")).alias("same_signal"))
