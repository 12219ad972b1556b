"""Bars from ticks, table tools, joins of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.indicators import add_atr, change
from tidemark.operators import analysis as A
from tidemark.operators import joins as J
from tidemark.operators.panel import arrange
from tidemark.plans.base import (
    ATR_STEP,
    FLAG,
    PERIODS,
    PREDICTIONS_SQL,
    STRATEGY_LABELS,
    VIX_SQL,
    bars_sql,
    daily,
    predictions,
    q6,
    query,
    rounded,
    table,
    w,
    with_context,
)
from tidemark.session import cut, scratch_path
from tidemark.sources import bars as S
from tidemark.sources.stored import ChunkTable
from tidemark.sources.tables import drop_nulls, flat_fill, normalize_schema, numeric_only, read_table, write_table

BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")
_BARS = "symbol, ts, open, high, low, close, volume"


@query(f"WITH {bars_sql()} SELECT {_BARS} FROM bars")
def daily_bars(spark, sf_dir):
    return daily(spark, sf_dir).select(*BAR_COLUMNS)


@query(f"WITH {bars_sql(FLAG)} SELECT {_BARS} FROM bars")
def long_daily_bars(spark, sf_dir):
    """Few symbols with long histories."""
    return daily(spark, sf_dir, FLAG).select(*BAR_COLUMNS)


def _hourly(spark, sf_dir, symbol: str = "event_type"):
    bars = S.build_bars(table(spark, sf_dir, "events"), symbol, "ts", "value", "event_id", "hour")
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _hourly_sql(symbol: str = "event_type", name: str = "hourly") -> str:
    return f"""
{name} AS (SELECT {symbol} AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


@query(f"WITH {_hourly_sql()} SELECT * FROM hourly")
def hourly_event_bars(spark, sf_dir):
    """Open, high, low, close and count per event type and hour."""
    return _hourly(spark, sf_dir)


@query(
    """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open,
max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close,
sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2"""
)
def daily_trade_bars(spark, sf_dir):
    """Bars with traded size; the order of lines is the order of trades in a day."""
    # An order has fewer than 1024 lines, so order and line make one number.
    lines = table(spark, sf_dir, "lineitem").withColumn("trade", F.col("l_orderkey").cast("long") * 1024 + F.col("l_linenumber"))
    return S.build_bars(lines, "l_returnflag", "l_shipdate", "l_extendedprice", "trade", "day", "l_quantity")


@query(f"WITH {bars_sql()}, {VIX_SQL} SELECT {_BARS}, vix FROM bars JOIN vix USING (ts)")
def bars_with_context(spark, sf_dir):
    return with_context(daily(spark, sf_dir), spark, sf_dir).select(*BAR_COLUMNS, "vix")


@query(
    f"""WITH {bars_sql()} SELECT symbol, ts AS "Date", close AS close_price, high AS high_price, low AS low_price FROM bars"""
)
def vendor_columns(spark, sf_dir):
    """A vendor's column names brought to ours; columns that are not numbers are kept by name."""
    vendor = daily(spark, sf_dir).df.selectExpr("symbol", "ts AS date", "close AS adjClose", "high AS adjHigh", "low AS adjLow")
    names = {"date": "Date", "adjClose": "close_price", "adjHigh": "high_price", "adjLow": "low_price"}
    return normalize_schema(vendor, names)


@query(f"WITH {bars_sql()} SELECT symbol, open, high, low, close, volume FROM bars")
def numeric_bar_columns(spark, sf_dir):
    return numeric_only(daily(spark, sf_dir).select(*BAR_COLUMNS))


@query(
    f"""WITH {bars_sql()} SELECT symbol, ts, close FROM bars WHERE ts < DATE '1999-01-01'
UNION ALL SELECT symbol, ts, close FROM bars WHERE ts >= DATE '1998-07-01' ORDER BY ts, symbol"""
)
def combined_samples(spark, sf_dir):
    """In-sample and out-of-sample rows together; the overlap stays twice."""
    bars = daily(spark, sf_dir).df
    early, late = bars.where("ts < DATE '1999-01-01'"), bars.where("ts >= DATE '1998-07-01'")
    return S.combine_samples(early, late, ("symbol", "ts", "close")).orderBy("ts", "symbol")


_CHUNKED_SQL = f"""WITH RECURSIVE {bars_sql()}, {VIX_SQL},
chunked AS (SELECT b.*, vix, date_diff('day', DATE '1995-01-01', ts) // 60 AS chunk FROM bars b
  LEFT JOIN (SELECT * FROM vix WHERE vix < 15.2) USING (ts)),
counted AS (SELECT *, count(*) OVER (PARTITION BY symbol, chunk) AS n, row_number() {w(by='symbol, chunk')} AS rn,
  greatest(high - low, abs(high - lag(close) {w(by='symbol, chunk')}), abs(low - lag(close) {w(by='symbol, chunk')})) AS tr FROM chunked),
kept AS MATERIALIZED (SELECT *, avg(tr) {w('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW', 'symbol, chunk')} AS tr5 FROM counted WHERE n >= 5),
states AS (SELECT symbol, chunk, rn, 0.0::DOUBLE AS atr FROM kept WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.chunk, n.rn, {ATR_STEP[1]} FROM states e JOIN kept n ON n.symbol = e.symbol AND n.chunk = e.chunk AND n.rn = e.rn + 1)
SELECT symbol, ts, close, high, low, vix, {q6('atr')} FROM kept JOIN states USING (symbol, chunk, rn)"""
_LOADED = ("symbol", "ts", "close", "high", "low", "vix")


def _context_bars(spark, sf_dir):
    bars = with_context(daily(spark, sf_dir), spark, sf_dir).df
    return bars.withColumn("vix", F.when(F.col("vix") < 15.2, F.col("vix"))).drop("_pos", "_seg")


@query(_CHUNKED_SQL)
def chunked_ingest(spark, sf_dir):
    """Loads of 60 days each: short loads are skipped, ATR restarts, missing context is let through."""
    loaded = S.ingest_chunks(_context_bars(spark, sf_dir), "1995-01-01", days=60, min_rows=5, grain="day")
    return rounded(loaded.select(*_LOADED, "atr"), "close", "high", "low", "vix")


@query(_CHUNKED_SQL)
def repeated_ingest(spark, sf_dir):
    """The same loads into a table, the later years first, what is pending then, and the later years once more."""
    bars = cut(_context_bars(spark, sf_dir).select(*_LOADED), "load-bars")
    chunk = S.chunk_number("1995-01-01", 60)
    first, last = bars.agg(F.min(chunk), F.max(chunk)).first()
    loads = ChunkTable(scratch_path(spark, "loads"), bars.schema, "1995-01-01", days=60, min_rows=5, grain="day")
    if last is not None:
        late = range((last + 1) // 2, last + 1)
        loads.load(bars, late)
        loads.load(bars, [*range(first, 0), *loads.pending(spark, loads.begins(last + 1).isoformat())])
        loads.load(bars, late)
    return rounded(loads.read(spark).select(*_LOADED, "atr"), "close", "high", "low", "vix")


@query(
    f"""WITH {_hourly_sql('user_id')}, kept AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM hourly)
SELECT * EXCLUDE (n) FROM kept WHERE n >= 20"""
)
def symbols_with_history(spark, sf_dir):
    """Bars of users with at least 20 active hours."""
    panel = arrange(_hourly(spark, sf_dir, "user_id"), grain="hour")
    return S.min_history(panel, 20).table()


_PERIODS = ", ".join(f"({p}, DATE '{s}', DATE '{e}')" for p, s, e in PERIODS)
PERIODS_SQL = f"periods AS (SELECT * FROM (VALUES {_PERIODS}) AS t(period, starts, ends))"


@query(
    f"""WITH {bars_sql()}, {PERIODS_SQL} SELECT symbol, period, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close FROM bars JOIN periods ON ts >= starts AND ts < ends GROUP BY 1, 2"""
)
def period_slices(spark, sf_dir):
    return _period_ends(S.slice_periods(daily(spark, sf_dir).df, PERIODS))


def _period_ends(sliced):
    return sliced.groupBy("symbol", "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("close", "ts").alias("first_close"),
        F.max_by("close", "ts").alias("last_close"),
    )


@query(
    f"""WITH {bars_sql()}, months AS (SELECT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS period, CAST(min(o_orderdate) AS DATE) AS starts,
CAST(max(o_orderdate) AS DATE) AS ends FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT symbol, period, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close
FROM bars JOIN months ON ts >= starts AND ts < ends GROUP BY 1, 2"""
)
def period_table_slices(spark, sf_dir):
    """Periods that only the data know: from the first to the last urgent order of every month."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    month = F.date_format("o_orderdate", "yyyyMM").cast("long").alias("period")
    periods = urgent.groupBy(month).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    path = scratch_path(spark, "bars")
    bars = daily(spark, sf_dir).select(*BAR_COLUMNS).withColumn("year", F.year("ts"))
    write_table(bars, path, partition_by=("year",))
    return _period_ends(S.join_periods(read_table(spark, path, bars.schema), cut(periods, "periods")))


@query(f"WITH {bars_sql(FLAG)} SELECT {_BARS} FROM bars")
def stored_bars(spark, sf_dir):
    """Bars written to a table, partitioned by year so that periods prune, and read back."""
    bars = daily(spark, sf_dir, FLAG).select(*BAR_COLUMNS).withColumn("year", F.year("ts"))
    path = scratch_path(spark, "bars")
    write_table(bars, path, partition_by=("year",))
    return read_table(spark, path, bars.schema).select(*BAR_COLUMNS)


_PROFILED = ("open", "high", "low", "close", "volume", "ret5")


def _profile_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM moved" for c in _PROFILED
    )
    return f"""WITH {bars_sql()}, moved AS (SELECT *, close / lag(close, 5) {w()} - 1 AS ret5 FROM bars), long AS ({parts})
SELECT feature, count(v) AS n, count(*) - count(v) AS nulls, {q6('avg(v)', 'mean')}, {q6('stddev_samp(v)', 'std')}, {q6('min(v)', 'min')},
{q6('quantile_cont(v, 0.25)', 'p25')}, {q6('quantile_cont(v, 0.5)', 'p50')}, {q6('quantile_cont(v, 0.75)', 'p75')}, {q6('max(v)', 'max')}
FROM long GROUP BY feature"""


@query(_profile_sql())
def table_profile(spark, sf_dir):
    panel = daily(spark, sf_dir).roll({"ret5": change("close", 5)})
    return rounded(A.profile(cut(panel.select(*_PROFILED), "profiled"), _PROFILED))


# Read more than once below, so kept.
_KEPT_BARS = bars_sql().replace("bars AS (", "bars AS MATERIALIZED (")

# Two tables that overlap in part: predictions to 2000, bars from 1996.
_OVERLAP = f"""{_KEPT_BARS}, {PREDICTIONS_SQL},
early AS (SELECT * FROM predictions WHERE ts < DATE '2000-01-01'), late AS (SELECT * FROM bars WHERE ts >= DATE '1996-01-01')"""


def _overlap(spark, sf_dir):
    panel = daily(spark, sf_dir)
    return predictions(panel).where("ts < DATE '2000-01-01'"), panel.table().where("ts >= DATE '1996-01-01'")


@query(
    f"""WITH {_OVERLAP} SELECT (SELECT min(ts) FROM early) AS a_first, (SELECT max(ts) FROM early) AS a_last,
(SELECT count(*) FROM early) AS a_rows, (SELECT min(ts) FROM late) AS b_first, (SELECT max(ts) FROM late) AS b_last,
(SELECT count(*) FROM late) AS b_rows, (SELECT count(*) FROM early JOIN late USING (symbol, ts)) AS overlap"""
)
def date_coverage(spark, sf_dir):
    return A.coverage(*_overlap(spark, sf_dir))


@query(f"WITH {_KEPT_BARS}, {PREDICTIONS_SQL} SELECT e.*, open, high, low, close, volume FROM predictions e JOIN bars b USING (symbol, ts)")
def predictions_with_bars(spark, sf_dir):
    panel = daily(spark, sf_dir)
    return J.join_on_ts(predictions(panel), panel.table())


@query(f"WITH {_OVERLAP} SELECT l.*, strategy, probability FROM late l LEFT JOIN early USING (symbol, ts) WHERE strategy IS NOT NULL")
def complete_joined_rows(spark, sf_dir):
    early, late = _overlap(spark, sf_dir)
    return J.join_complete(late, early)


@query(f"WITH {_OVERLAP} SELECT l.* FROM late l SEMI JOIN early USING (symbol, ts)")
def bars_on_common_dates(spark, sf_dir):
    early, late = _overlap(spark, sf_dir)
    return J.common_dates(early, late)[1]


@query(f"WITH {_OVERLAP} SELECT symbol, ts FROM early INTERSECT SELECT symbol, ts FROM late")
def shared_bar_keys(spark, sf_dir):
    return J.shared_keys(*_overlap(spark, sf_dir))


@query(
    f"""WITH {bars_sql()}, {PREDICTIONS_SQL} SELECT DISTINCT strategy FROM predictions
EXCEPT SELECT * FROM (VALUES ('ML_Strategy'), ('TCVS_Dynamic'))"""
)
def unmapped_strategies(spark, sf_dir):
    """Predicted names that a mapping with two entries misses."""
    known = {s: s for s in STRATEGY_LABELS if s in ("ML_Strategy", "TCVS_Dynamic")}
    return J.unmapped(predictions(daily(spark, sf_dir)), known)


@query(
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id,
arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2"""
)
def first_event_per_hour(spark, sf_dir):
    """Duplicate timestamps: the first row stays."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("ts").alias("at"),
        "event_id",
        "value",
    )
    return S.first_tick_per_key(events, ("symbol", "ts"), "at", "event_id", ("event_id", "value"))


@query(
    f"""WITH {bars_sql()}, moved AS (SELECT *, close / lag(close, 10) {w()} - 1 AS ret10, close / lag(close) {w()} - 1 AS ret FROM bars)
SELECT symbol, ts, close, {q6('ret10')}, {q6('ret')} FROM moved WHERE ret10 IS NOT NULL"""
)
def complete_rows(spark, sf_dir):
    panel = daily(spark, sf_dir).roll({"ret10": change("close", 10), "ret": change("close")})
    return rounded(drop_nulls(panel.select("symbol", "ts", "close", "ret10", "ret"), ["ret10"]), "close")


@query(f"WITH {bars_sql()} SELECT symbol, ts, {q6(f'coalesce(close / lag(close) {w()} - 1, 0)', 'ret')} FROM bars")
def flat_returns(spark, sf_dir):
    panel = daily(spark, sf_dir).roll({"ret": change("close")})
    return rounded(flat_fill(panel.select("symbol", "ts", "ret"), ["ret"]))


@query(
    f"""WITH {bars_sql()}, sig AS (SELECT symbol, ts, CAST(volume % 5 AS INTEGER) AS signal, CAST(volume % 7 AS DOUBLE) / 7 AS proba
  FROM bars WHERE ts >= DATE '1996-01-01' AND volume % 3 > 0)
SELECT b.symbol, b.ts, coalesce(signal, 0) AS signal, coalesce(proba, 0) AS proba FROM bars b LEFT JOIN sig USING (symbol, ts)"""
)
def aligned_signals(spark, sf_dir):
    """Signals exist for some rows only; the rest get 0."""
    bars = daily(spark, sf_dir).df
    signals = bars.where("ts >= DATE '1996-01-01' AND volume % 3 > 0").selectExpr(
        "symbol", "ts", "CAST(volume % 5 AS INT) AS signal", "CAST(volume % 7 AS DOUBLE) / 7 AS proba"
    )
    return J.align_signal(bars.select("symbol", "ts"), signals)


@query(
    f"""WITH RECURSIVE {bars_sql()}, {PERIODS_SQL},
sliced AS (SELECT b.*, period FROM bars b JOIN periods ON ts >= starts AND ts < ends),
numbered AS (SELECT *, row_number() {w(by='symbol, period')} AS rn, greatest(high - low, abs(high - lag(close) {w(by='symbol, period')}),
  abs(low - lag(close) {w(by='symbol, period')})) AS tr FROM sliced),
ranged AS MATERIALIZED (SELECT *, avg(tr) {w('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW', 'symbol, period')} AS tr5 FROM numbered),
states AS (SELECT symbol, period, rn, 0.0::DOUBLE AS atr FROM ranged WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.period, n.rn, {ATR_STEP[1]} FROM states e JOIN ranged n ON n.symbol = e.symbol AND n.period = e.period AND n.rn = e.rn + 1)
SELECT symbol, period, ts, {q6('atr')} FROM ranged JOIN states USING (symbol, period, rn)"""
)
def range_per_period(spark, sf_dir):
    """ATR that restarts in each period."""
    panel = daily(spark, sf_dir)
    panel = S.period_panel(panel.table(), PERIODS, slots=panel.rows * panel.segments)
    return rounded(add_atr(panel).select("symbol", "period", "ts", "atr"))
