"""Performance of many strategies in one job.

Curves and peaks of all strategies are computed side by side in the same window pass, so bars are
sorted once and never multiplied by the number of strategies. Only then are the strategies turned
into rows, straight into an aggregate that merges map-side. Segments of a long series are summarised
on their own and the summaries are chained: growth multiplies, peaks and drawdowns scale with the
growth and peak before the segment.

Families differ in which rows count (``n_obs``) and in how missing returns enter:

=====  =====================================  ====================================
name   curve                                  n_obs and volatility
=====  =====================================  ====================================
A      missing return is no change            all rows; std of returns present
A0     missing return is no change            all rows; std with missing as 0
B      rows with a missing return dropped     rows left
B1     as B, drops add up over the legs       rows left
C      missing return skipped                 returns but the first
=====  =====================================  ====================================

Drawdown is in units of the starting capital. Sharpe is annual return / annual volatility, 0 when
the volatility is 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import TRADING_DAYS
from tidemark.operators.panel import POS, SEG, Panel

FAMILIES = ("A", "A0", "B", "B1", "C")


@dataclass(frozen=True)
class Leg:
    """One strategy to score: its return column, its position column if any, and constants
    (such as fast and slow) that identify it in the result."""

    name: str
    ret: str
    position: str | None = None
    tags: Mapping[str, int | float | str] = field(default_factory=dict)


def score(panel: Panel, legs: Sequence[Leg], family: str = "A") -> DataFrame:
    """One row per series and strategy."""
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    keys = list(panel.keys)
    parts = _segment_parts(panel, legs, family)
    ids = [*keys, "_leg"]
    whole = _chain(parts, ids) if panel.blocked else parts
    return _named(_finish(whole, ids, family), legs, keys)


def _segment_parts(panel: Panel, legs: Sequence[Leg], family: str) -> DataFrame:
    """Summary of each strategy over each window group."""
    w = panel.window().rowsBetween(Window.unboundedPreceding, 0)
    fill = family in ("A", "A0")
    returns = {}
    for i, leg in enumerate(legs):
        present = " AND ".join(f"`{before.ret}` IS NOT NULL" for before in legs[:i])
        drops = family == "B1" and present
        returns[f"_r{i}"] = F.expr(f"CASE WHEN {present} THEN `{leg.ret}` END" if drops else f"`{leg.ret}`")
    df = panel.df.withColumns(returns)
    df = df.withColumns(
        {f"_f{i}": F.expr(f"1 + coalesce(_r{i}, 0D)" if fill else f"1 + _r{i}") for i in range(len(legs))}
    )
    df = df.withColumns({f"_g{i}": F.product(f"_f{i}").over(w) for i in range(len(legs))})
    if not fill:
        df = df.withColumns({f"_g{i}": F.expr(f"CASE WHEN _r{i} IS NOT NULL THEN _g{i} END") for i in range(len(legs))})
    peaks = {f"_p{i}": F.max(f"_g{i}").over(w) for i in range(len(legs))}
    if panel.blocked:
        peaks |= {f"_t{i}": F.min(f"_g{i}").over(w) for i in range(len(legs))}
    df = df.withColumns(peaks)
    rows = []
    for i, leg in enumerate(legs):
        position = f"CAST(`{leg.position}` AS DOUBLE)" if leg.position else "CAST(NULL AS DOUBLE)"
        trough = f", 'trough', _t{i}" if panel.blocked else ""
        rows.append(f"named_struct('_leg', {i}, 'r', _r{i}, 'p', {position}, 'g', _g{i}, 'peak', _p{i}{trough})")
    long = df.select(*panel.group, POS, F.expr(f"inline(array({', '.join(rows)}))"))
    aggregates = dict(_PARTS)
    if panel.blocked:
        aggregates |= {"top": "max(peak)", "bottom": "min(trough)", "rise": "max(g - trough)"}
    return long.groupBy(*panel.group, "_leg").agg(*[F.expr(sql).alias(n) for n, sql in aggregates.items()])


# Aggregates over the rows of one strategy: r return, p position, g growth so far, peak of g.
_COUNTS = {
    "n_rows": "count(1)",
    "n_ret": "count(r)",
    "s1": "sum(r)",
    "s2": "sum(r * r)",
    "n_pos": "count(p)",
    "n_one": "count_if(p = 1)",
    "n_long": "count_if(p > 0)",
    "n_short": "count_if(p < 0)",
    "n_held": "count_if(p <> 0)",
    "n_lever": "count_if(p > 1)",
    "sum_p": "sum(p)",
    "n_active": "count_if(r IS NULL OR r <> 0)",
}
_PARTS = {
    **_COUNTS,
    "growth": f"max_by(g, CASE WHEN g IS NOT NULL THEN {POS} END)",
    "fall": "max(peak - g)",
    "first_at": f"min(CASE WHEN r IS NOT NULL THEN {POS} END)",
    "first": f"min_by(r, CASE WHEN r IS NOT NULL THEN {POS} END)",
}


def _chain(parts: DataFrame, ids: list[str]) -> DataFrame:
    """Join segment summaries: one row per segment and strategy is all that is ordered here."""
    w = Window.partitionBy(*ids).orderBy(SEG)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    df = parts.withColumn("_start", F.coalesce(F.product("growth").over(earlier), F.lit(1.0)))
    # A negative growth turns the segment upside down, so both ends are scaled.
    df = df.withColumns(
        {
            "_high": F.expr("greatest(_start * top, _start * bottom)"),
            "_low": F.expr("least(_start * top, _start * bottom)"),
            "_inner": F.expr("CASE WHEN _start >= 0 THEN _start * fall ELSE -_start * rise END"),
            "_end": F.expr("_start * growth"),
        }
    )
    df = df.withColumn("_before", F.max("_high").over(earlier))
    return df.groupBy(*ids).agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.expr(f"max_by(_end, CASE WHEN _end IS NOT NULL THEN {SEG} END)").alias("growth"),
        F.expr("max(greatest(_inner, _before - _low))").alias("fall"),
        F.expr("min_by(first, first_at)").alias("first"),
    )


def _std(n: str, s1: str, s2: str) -> str:
    """Sample standard deviation from count, sum and sum of squares; null below two values."""
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest(({s2} - ({s1}) * ({s1}) / ({n})) / ({n} - 1), 0D)) END"


_N_AND_STD = {
    "A": ("n_rows", _std("n_ret", "s1", "s2")),
    "A0": ("n_rows", _std("n_rows", "coalesce(s1, 0D)", "coalesce(s2, 0D)")),
    "B": ("n_ret", _std("n_ret", "s1", "s2")),
    "B1": ("n_ret", _std("n_ret", "s1", "s2")),
    "C": ("n_ret - 1", _std("(n_ret - 1)", "s1 - first", "s2 - first * first")),
}


def _finish(df: DataFrame, ids: list[str], family: str) -> DataFrame:
    n_obs, std = _N_AND_STD[family]
    df = df.withColumns({"n_obs": F.expr(n_obs), "ann_vol": F.expr(f"({std}) * sqrt({TRADING_DAYS}D)")})
    df = df.withColumn("ann_return", F.expr(f"CASE WHEN n_obs > 0 THEN pow(growth, {TRADING_DAYS}D / n_obs) - 1 END"))

    def share(c: str) -> str:
        return f"100D * try_divide(CAST({c} AS DOUBLE), CAST(n_pos AS DOUBLE))"

    return df.selectExpr(
        *ids,
        "n_obs",
        "100 * growth AS final_value",
        "ann_return",
        "ann_vol",
        "CASE WHEN ann_vol <> 0 THEN ann_return / ann_vol WHEN ann_vol = 0 THEN 0D END AS sharpe",
        "fall AS max_drawdown",
        f"{share('n_one')} AS pct_one",
        f"{share('sum_p')} AS pct_exposure",
        f"{share('n_long')} AS pct_long",
        f"{share('n_short')} AS pct_short",
        f"{share('n_held')} AS pct_held",
        "100D * n_active / n_rows AS pct_active",
        "n_lever AS leveraged_rows",
        f"{share('n_lever')} AS pct_leveraged",
    )


def _named(scored: DataFrame, legs: Sequence[Leg], keys: list[str]) -> DataFrame:
    """Leg numbers to names and tags: numbers keep the wide aggregate cheap."""

    def each(values: list) -> Column:
        return F.get(F.lit(values), F.col("_leg"))

    named = [each([leg.name for leg in legs]).alias("strategy")]
    named += [each([leg.tags[t] for leg in legs]).alias(t) for t in legs[0].tags]
    rest = [c for c in scored.columns if c not in (*keys, "_leg")]
    return scored.select(*keys, *named, *rest)


def monthly_metrics(curve: DataFrame, keys: Sequence[str], month: str = "month", equity: str = "equity") -> DataFrame:
    """Family M, for a curve with one row per month: the gain of the first month is not seen, the
    exponent is 12 / months, drawdown is relative to the peak, Sharpe is null at zero volatility.

    A series has one row per calendar month, which bounds its window group.
    """
    w = Window.partitionBy(*keys).orderBy(month)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = curve.withColumns(
        {"_r": F.col(equity) / F.lag(equity, 1).over(w) - 1, "_peak": F.max(equity).over(running)}
    )
    df = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max_by(equity, month).alias("final_value"),
        F.min_by(equity, month).alias("_first"),
        F.stddev_samp("_r").alias("_std"),
        F.max((F.col("_peak") - F.col(equity)) / F.col("_peak")).alias("max_drawdown"),
    )
    df = df.withColumns(
        {
            "ann_return": F.pow(F.col("final_value") / F.col("_first"), 12 / F.col("n_obs")) - 1,
            "ann_vol": F.col("_std") * F.sqrt(F.lit(12.0)),
        }
    )
    sharpe = F.when(F.col("ann_vol") != 0, F.col("ann_return") / F.col("ann_vol")).alias("sharpe")
    return df.select(*keys, "n_obs", "final_value", "ann_return", "ann_vol", sharpe, "max_drawdown")


def present(metrics: DataFrame) -> DataFrame:
    """Percent and rounding for display; nothing is rounded before."""
    percent = {c: F.round(100 * F.col(c), 2) for c in ("ann_return", "ann_vol", "max_drawdown") if c in metrics.columns}
    shares = {c: F.round(c, 2) for c in metrics.columns if c.startswith("pct_") or c == "final_value"}
    return metrics.withColumns({**percent, **shares, "sharpe": F.round("sharpe", 3)})
