"""Bars from raw ticks, and ways to cut, join and combine bar tables."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import add_atr
from tidemark.operators.panel import POS, SEG, Panel, arrange


def moment(ts: Column, tick_id: Column) -> Column:
    """Time and whole-number id as one number that orders like the pair. A fixed-width key lets Spark keep
    the first and last tick in a hash table; a struct would sort all ticks first. Micros up to the
    year 9999 times 2e19, and an id moved to be positive, below 2e19, stay within 38 digits."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    place = tick_id.cast("long").cast("decimal(19,0)") + F.lit(Decimal(2**63))
    return (micros * F.lit(Decimal(2 * 10**19)) + place).cast("decimal(38,0)")


def bar_aggregates(price: str, size: str | None, at: Column) -> list[Column]:
    """OHLCV of one bar. ``at`` orders ticks inside the bar and must be unique there (see ``moment``)."""
    columns = [
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
    ]
    columns.append((F.sum(size) if size else F.count(F.lit(1))).alias("volume"))
    return columns


def build_bars(
    ticks: DataFrame, symbol: str, ts: str, price: str, tick_id: str, grain: str = "hour", size: str | None = None
) -> DataFrame:
    """Ticks to bars in one aggregation. All parts merge map-side, so a symbol with a third of
    all ticks sends only its partial bars through the shuffle."""
    at = moment(F.col(ts), F.col(tick_id))
    slot = F.date_trunc(grain, F.col(ts))
    slot = slot.cast("date") if grain == "day" else slot
    return ticks.groupBy(F.col(symbol).alias("symbol"), slot.alias("ts")).agg(*bar_aggregates(price, size, at))


def align_context(bars: DataFrame, context: DataFrame, on: Sequence[str] = ("ts",), required: bool = True) -> DataFrame:
    """Add a context series. Bars without a context row are dropped when ``required``. The context
    has one row per date; Spark broadcasts it when its measured size allows."""
    return bars.join(context, list(on), "inner" if required else "left")


def combine_samples(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both samples with the common columns; rows in both stay twice. Sort at the sink."""
    return a.select(*columns).unionByName(b.select(*columns))


def min_history(panel: Panel, n: int = 20) -> Panel:
    """Series with at least ``n`` bars."""
    counted = panel.totals({"_bars": F.count(F.lit(1))})
    return counted.with_df(counted.df.where(F.col("_bars") >= n).drop("_bars"))


def slice_periods(bars: DataFrame, periods: Sequence[tuple[int, str, str]]) -> DataFrame:
    """One copy of a bar per period [start, end) that holds it, as column ``period``. Periods are a
    short parameter list, so they travel in the plan and the dates reach the scan as filters."""
    homes = F.array(
        *[
            F.when((F.col("ts") >= F.lit(s).cast("date")) & (F.col("ts") < F.lit(e).cast("date")), F.lit(p))
            for p, s, e in periods
        ]
    )
    first, last = min(s for _, s, _ in periods), max(e for _, _, e in periods)
    inside = bars.where((F.col("ts") >= F.lit(first).cast("date")) & (F.col("ts") < F.lit(last).cast("date")))
    return inside.withColumn("period", F.explode(F.array_compact(homes)))


#: A table of at most so many periods is broadcast, about 40 bytes each.
MAX_PERIODS = 100_000


def join_periods(bars: DataFrame, periods: DataFrame) -> DataFrame:
    """As ``slice_periods``, for periods in a table (period, start, end), of which nothing is known when the plan is made.

    ``bars`` are partitioned by their column ``year``: periods name the years that they touch, and the join by year prunes at run
    time what no period needs. Periods that end before they start, or have a null bound, hold nothing; those that
    overlap each get their copy. A bar outside all periods goes."""
    real = periods.select("period", F.col("start").cast("date").alias("_start"), F.col("end").cast("date").alias("_end")).where("_start < _end")
    years = real.select("*", F.explode(F.sequence(F.year("_start"), F.year(F.date_sub("_end", 1)))).alias("year"))
    if years.limit(MAX_PERIODS + 1).count() <= MAX_PERIODS:
        years = F.broadcast(years)
    return bars.join(years, "year").where("ts >= _start AND ts < _end").drop("_start", "_end")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``, merged map-side. With one number to order by, which must be the row's own within
    its key, columns of fixed width stay in hash tables and no row is sorted."""
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1:
        return df.groupBy(*keys).agg(*(F.min_by(c, order[0]).alias(c) for c in rest))
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def first_tick_per_key(df: DataFrame, keys: Sequence[str], ts: str, tick_id: str, columns: Sequence[str]) -> DataFrame:
    """The ``columns`` (of fixed width) of each key's first tick by (ts, id): hash tables, no sort of the ticks."""
    at = moment(F.col(ts), F.col(tick_id))
    return df.groupBy(*keys).agg(*(F.min_by(c, at).alias(c) for c in columns))


def chunk_number(start: str, days: int) -> Column:
    """The chunk of ``days`` from ``start`` that a bar's ``ts`` lies in."""
    return F.floor(F.datediff(F.col("ts"), F.lit(start).cast("date")) / days)


def loaded_chunks(
    bars: DataFrame,
    start: str,
    days: int = 60,
    min_rows: int = 5,
    atr_rows: int = 5,
    required: Sequence[str] = ("close", "high", "low"),
    grain: str = "hour",
    slots: int | None = None,
) -> DataFrame:
    """Every chunk's bars, with ``chunk`` and ``atr``: see ``ingest_chunks``. Chunks do not depend on each other."""
    rows = bars.dropna(subset=list(required)).select("*", chunk_number(start, days).alias("chunk"))
    per_hour = {"hour": 24, "minute": 1440, "day": 1}[grain]
    panel = arrange(rows, ("symbol", "chunk"), grain=grain, slots=slots or days * per_hour)
    panel = min_history(panel, min_rows)
    return add_atr(panel, atr_rows).df.drop(POS, SEG)


def ingest_chunks(
    bars: DataFrame,
    start: str,
    days: int = 60,
    min_rows: int = 5,
    atr_rows: int = 5,
    required: Sequence[str] = ("close", "high", "low"),
    grain: str = "hour",
    slots: int | None = None,
) -> DataFrame:
    """Intraday load in chunks of ``days`` from ``start``: incomplete rows go, chunks with too few
    rows go, ATR restarts in each chunk, and of duplicate timestamps the earliest chunk's stays.

    ``slots`` defaults to the length of a chunk, which bounds a group by the calendar.
    ``stored.ChunkTable`` keeps the same rows in a table, load by load.
    """
    full = loaded_chunks(bars, start, days, min_rows, atr_rows, required, grain, slots)
    return first_per_key(full, ("symbol", "ts"), ("chunk",))


def period_panel(bars: DataFrame, periods: Sequence[tuple[int, str, str]], grain: str = "day", slots: int | None = None) -> Panel:
    """Bars cut into periods, laid out so that every indicator restarts in each period."""
    return arrange(slice_periods(bars, periods), ("symbol", "period"), grain=grain, slots=slots)
