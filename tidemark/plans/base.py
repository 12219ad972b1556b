"""The query pack's inputs: bar panels derived from the driver's tables, as DataFrames and as the
equivalent SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panel import Panel, Running, arrange, calendar_slots
from tidemark.sources.bars import align_context

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SUPPLIER, FLAG = "l_suppkey", "l_returnflag"

# Five half-open slices of the calendar.
PERIODS = [
    (1, "1995-01-01", "1996-06-01"),
    (2, "1996-06-01", "1997-06-01"),
    (3, "1997-06-01", "1998-09-01"),
    (4, "1998-09-01", "2000-01-01"),
    (5, "2000-01-01", "2001-12-31"),
]

# A context series of up to this many rows (16 MB) may be broadcast; beyond it the join shuffles.
BROADCAST_SLOTS = 1_000_000


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---------------------------------------------------------------------- DataFrames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """All double columns to six decimals but the ``exact`` ones, without a negative zero. Prices are multiples of
    1/128, so ratios often end exactly on a half; the nudge keeps the last bit of a double from deciding those. The
    SQL has it too."""
    doubles = [n for n, t in df.dtypes if t == "double" and n not in exact]
    return df.withColumns({c: F.expr(f"round(`{c}` + 3e-8D, 6) + 0D") for c in doubles}) if doubles else df


_SLOTS: dict[tuple[str, str], int] = {}


def shipping_days(spark: SparkSession, sf_dir: str) -> int:
    """The calendar of the price panels, measured once for each session and table."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _SLOTS:
        _SLOTS[at] = calendar_slots(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts")))
    return _SLOTS[at]


def daily(spark: SparkSession, sf_dir: str, key: str = SUPPLIER) -> Panel:
    """Daily bars per ``key``: each day's mean quantity moves the price by a number of ticks."""
    lines = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("date").alias("ts")
    days = lines.groupBy(F.col(key).alias("symbol"), ts).agg(
        F.avg("l_quantity").alias("aq"), F.max("l_quantity").alias("mq"), F.sum("l_quantity").cast("long").alias("volume")
    )
    days = days.withColumn("tick", F.floor(4 * F.col("aq")) - 102)
    panel = arrange(days, slots=shipping_days(spark, sf_dir)).scan({"_ticks": Running("sum", F.col("tick").cast("double"))})
    panel = panel.with_columns({"close": 100 + F.col("_ticks") / 128})
    panel = panel.with_columns({"open": F.col("close") - F.col("tick") / 128})
    panel = panel.with_columns(
        {
            "high": F.greatest("open", "close") + F.col("mq") / 64,
            "low": F.least("open", "close") - F.col("mq") / 64,
        }
    )
    return panel.with_df(panel.df.drop("aq", "mq", "tick", "_ticks"))


def with_context(panel: Panel, spark: SparkSession, sf_dir: str) -> Panel:
    """Add the context series ``vix``: one value per date over all rows."""
    context = vix(spark, sf_dir)
    if panel.rows * panel.segments <= BROADCAST_SLOTS:
        context = F.broadcast(context)
    return panel.with_df(align_context(panel.df, context))


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    points = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg((10 + points / F.count(F.lit(1))).alias("vix"))


def day_number() -> Column:
    return F.datediff(F.col("ts"), F.lit("1995-01-01").cast("date"))


def proba() -> Column:
    """Stand-in for a model's probability, the same integer arithmetic in any engine."""
    return ((F.col("volume") * 37 + day_number() * 11) % 100) / 100.0


def with_signal(panel: Panel) -> Panel:
    panel = panel.with_columns({"proba": proba()})
    return panel.with_columns({"signal": (F.col("proba") > 0.3).cast("int")})


STRATEGY_LABELS = ["ML_Strategy", "Conservative_Strategy", "TCVS_Dynamic", "MeanReversion"]


def predictions(panel: Panel) -> DataFrame:
    """Stand-in for predicted strategies: keys, ts, strategy, probability."""
    turn = (F.col("volume") + day_number()) % 4
    name = F.element_at(F.array(*[F.lit(s) for s in STRATEGY_LABELS]), (turn + 1).cast("int"))
    return panel.df.select("symbol", "ts", name.alias("strategy"), proba().alias("probability"))


# ---------------------------------------------------------------------- the same in SQL


def bars_sql(key: str = SUPPLIER) -> str:
    return f"""
raw AS (SELECT {key} AS symbol, CAST(l_shipdate AS DATE) AS ts, avg(l_quantity) AS aq, max(l_quantity) AS mq,
  CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2),
ticked AS (SELECT *, CAST(floor(4 * aq) AS BIGINT) - 102 AS tick FROM raw),
priced AS (SELECT *, 100 + CAST(sum(tick) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 128
  AS close FROM ticked),
opened AS (SELECT *, close - CAST(tick AS DOUBLE) / 128 AS open FROM priced),
bars AS (SELECT symbol, ts, volume, open, close, greatest(open, close) + mq / 64 AS high, least(open, close) - mq / 64 AS low
  FROM opened)"""


VIX_SQL = """
vix AS (SELECT CAST(l_shipdate AS DATE) AS ts,
  10 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS vix FROM lineitem GROUP BY 1)"""

_DAY = "date_diff('day', DATE '1995-01-01', ts)"
PROBA = f"CAST((volume * 37 + {_DAY} * 11) % 100 AS DOUBLE) / 100"
STRATEGY = (
    f"(['ML_Strategy', 'Conservative_Strategy', 'TCVS_Dynamic', 'MeanReversion'])[CAST((volume + {_DAY}) % 4 AS INTEGER) + 1]"
)

PREDICTIONS_SQL = f"predictions AS (SELECT symbol, ts, {STRATEGY} AS strategy, {PROBA} AS probability FROM bars)"


def w(extra: str = "", by: str = "symbol") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY ts {extra})"


def full(fn: str, x: str, n: int, by: str = "symbol") -> str:
    """Rolling aggregate, null until n values are there."""
    frame = w(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW", by)
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


def q6(x: str, alias: str | None = None) -> str:
    return f"round({x} + 3e-8::DOUBLE, 6) + 0.0 AS {alias or x}"


def market_sql(source: str = "bars", vol_rows: int = 10, by: str = "symbol", name: str = "market") -> str:
    """Returns, averages and flags, as `market`."""
    return f"""
{name}_1 AS (SELECT *, close / lag(close) {w(by=by)} - 1 AS ret, close / lag(close, 5) {w(by=by)} - 1 AS ret5,
  close / lag(close, 10) {w(by=by)} - 1 AS ret10, {full('avg', 'close', 5, by)} AS ma5, {full('avg', 'close', 20, by)} AS ma20,
  {PROBA} AS proba, CAST({PROBA} > 0.3 AS INTEGER) AS signal FROM {source}),
{name}_2 AS (SELECT *, ({full('stddev_samp', 'ret', vol_rows, by)}) * sqrt(252) AS rvol,
  CASE WHEN ma5 > ma20 THEN 1 ELSE 0 END AS trend_5_20 FROM {name}_1),
{name} AS (SELECT *, CASE WHEN rvol > ({full('avg', 'rvol', 20, by)}) THEN 1 ELSE 0 END AS high_vol FROM {name}_2)"""


def by_regime_sql(rising: str, falling: str, calm: str) -> str:
    return (
        f"(CASE WHEN high_vol = 1 AND trend_5_20 = 1 THEN {rising} WHEN high_vol = 1 AND trend_5_20 = 0 THEN {falling} "
        f"ELSE {calm} END)"
    )


RULES_SQL = {
    "ma_cross": "CAST(trend_5_20 AS DOUBLE)",
    "model": "CAST(signal AS DOUBLE)",
    "proportional": "signal * proba",
    "conservative": "signal * (CASE WHEN high_vol = 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END)",
    "trend_scaled": f"signal * {by_regime_sql('2.0::DOUBLE', '0.5::DOUBLE', '1.0::DOUBLE')}",
    "trend_scaled_open": "(CASE WHEN signal = 0 THEN 0.0::DOUBLE ELSE "
    + by_regime_sql("1 + proba", "greatest(0.1::DOUBLE, 1 - proba)", "1.0::DOUBLE")
    + " END)",
    "trend_scaled_proba": f"signal * {by_regime_sql('least(1.5::DOUBLE, 1 + 0.5::DOUBLE * proba)', '0.5::DOUBLE * proba', 'proba')}",
    "mean_reversion": f"signal * {by_regime_sql('0.5::DOUBLE', '1.5::DOUBLE', '1.0::DOUBLE')}",
    "mean_reversion_proba": by_regime_sql("0.2::DOUBLE * proba", "1 + 1.5::DOUBLE * (1 - proba)", "1.0::DOUBLE"),
    "regime_hybrid": "(CASE WHEN signal = 0 THEN 0.0::DOUBLE ELSE "
    + by_regime_sql("1 + proba", "1.5::DOUBLE - proba", "proba")
    + " END)",
}

COMPARED_SQL = {
    "MA Crossover": RULES_SQL["ma_cross"],
    "ML-Based": RULES_SQL["model"],
    "Conservative Vol-Scaled ML": RULES_SQL["conservative"],
    "Dynamic TCVS": RULES_SQL["trend_scaled_proba"],
    "Mean-Reversion": RULES_SQL["mean_reversion"],
}


def returns_sql(by: str = "symbol", source: str = "market") -> str:
    """Wide strategy returns under labels, as `rets` (bh, ma, ml, cv, tc, mr), plus positions."""
    names = ["ma", "ml", "cv", "tc", "mr"]
    positions = ", ".join(f"{x} AS p_{n}" for n, x in zip(names, COMPARED_SQL.values()))
    rets = ", ".join(f"lag(p_{n}) {w(by=by)} * ret AS {n}" for n in names)
    return f"""
positioned AS (SELECT *, {positions} FROM {source}),
rets AS (SELECT *, ret AS bh, {rets} FROM positioned)"""


def metrics_sql(long: str, ids: str, family: str, order: str = "ts", final: str = "metrics") -> str:
    """Metric families over a CTE with columns ids, ts, r, p (row order per ids), as `metrics`."""
    over = f"OVER (PARTITION BY {ids} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    if family in ("A", "A0"):
        growth, n_obs = f"product(1 + coalesce(r, 0)) {over}", "count(*)"
        std = "stddev_samp(r)" if family == "A" else "stddev_samp(coalesce(r, 0))"
    else:
        growth = f"CASE WHEN r IS NOT NULL THEN product(1 + r) {over} END"
        n_obs = "count(r)" if family != "C" else "count(r) - 1"
        std = "stddev_samp(r)" if family != "C" else "stddev_samp(r) FILTER (WHERE ordinal > 1)"
    return f"""
m_1 AS (SELECT *, {growth} AS g, CASE WHEN r IS NOT NULL THEN count(r) {over} END AS ordinal FROM {long}),
m_2 AS (SELECT *, max(g) {over} AS peak FROM m_1),
m_3 AS (SELECT {ids}, {n_obs} AS n_obs, count(*) AS n_rows, count(p) AS n_pos, max_by(g, {order}) FILTER (WHERE g IS NOT NULL) AS growth,
  ({std}) * sqrt(252) AS ann_vol, max(peak - g) AS fall,
  count(*) FILTER (WHERE p = 1) AS n_one, sum(p) AS sum_p, count(*) FILTER (WHERE p > 0) AS n_long,
  count(*) FILTER (WHERE p < 0) AS n_short, count(*) FILTER (WHERE p <> 0) AS n_held, count(*) FILTER (WHERE p > 1) AS n_lever,
  count(*) FILTER (WHERE r IS NULL OR r <> 0) AS n_active FROM m_2 GROUP BY {ids}),
m_4 AS (SELECT *, CASE WHEN n_obs > 0 THEN pow(growth, 252.0::DOUBLE / n_obs) - 1 END AS ann_return FROM m_3),
{final} AS (SELECT {ids}, n_obs, {q6('100 * growth', 'final_value')}, {q6('ann_return')}, {q6('ann_vol')},
  {q6('CASE WHEN ann_vol <> 0 THEN ann_return / ann_vol WHEN ann_vol = 0 THEN 0 END', 'sharpe')}, {q6('fall', 'max_drawdown')},
  {q6('100.0::DOUBLE * n_one / nullif(n_pos, 0)', 'pct_one')}, {q6('100.0::DOUBLE * sum_p / nullif(n_pos, 0)', 'pct_exposure')},
  {q6('100.0::DOUBLE * n_long / nullif(n_pos, 0)', 'pct_long')}, {q6('100.0::DOUBLE * n_short / nullif(n_pos, 0)', 'pct_short')},
  {q6('100.0::DOUBLE * n_held / nullif(n_pos, 0)', 'pct_held')}, {q6('100.0::DOUBLE * n_active / n_rows', 'pct_active')},
  n_lever AS leveraged_rows, {q6('100.0::DOUBLE * n_lever / nullif(n_pos, 0)', 'pct_leveraged')} FROM m_4)"""


def recurrence_sql(name: str, source: str, columns: dict[str, tuple[str, str]]) -> str:
    """Row-by-row recurrence over `source` (with `rn` from 1): per column the value on the first
    row (over n) and on later rows (over n and the previous row e)."""
    first = ", ".join(f"{init} AS {c}" for c, (init, _) in columns.items())
    later = ", ".join(step for _, step in columns.values())
    return f"""
{name} AS (SELECT n.symbol, n.rn, {first} FROM {source} n WHERE n.rn = 1
  UNION ALL SELECT n.symbol, n.rn, {later} FROM {name} e JOIN {source} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


def ema_step(column: str, span: int, x: str = "close") -> tuple[str, str]:
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"n.{x}", f"{a} * n.{x} + (1 - {a}) * e.{column}"


def wilder_step(column: str, n: int, x: str) -> tuple[str, str]:
    return f"n.{x} / {n}.0::DOUBLE", f"e.{column} * (1 - 1.0::DOUBLE / {n}) + n.{x} / {n}.0::DOUBLE"


NUMBERED_SQL = f"""
numbered AS MATERIALIZED (SELECT *, row_number() {w()} AS rn, lag(close) {w()} AS prev_close,
  coalesce(greatest(close - lag(close) {w()}, 0), 0) AS up, coalesce(greatest(lag(close) {w()} - close, 0), 0) AS down,
  greatest(high - low, abs(high - lag(close) {w()}), abs(low - lag(close) {w()})) AS tr FROM bars)"""

# Wilder's average of the true range over 5 rows: the mean of the first five, then a recurrence.
ATR_STEP = (
    "0.0::DOUBLE",
    "CASE WHEN n.rn < 5 THEN 0.0::DOUBLE WHEN n.rn = 5 THEN n.tr5 ELSE (e.atr * 4 + n.tr) / 5 END",
)
RANGED_SQL = f"ranged AS MATERIALIZED (SELECT *, avg(tr) {w('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS tr5 FROM numbered)"
RSI = "CASE WHEN rn >= 14 THEN CASE WHEN ad = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + au / ad) END END"
