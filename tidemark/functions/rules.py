"""Position rules: one column expression each, over the columns

``signal`` (0/1), ``proba``, ``trend_5_20`` (0/1), ``high_vol`` (0/1), moving averages and ``close``.

A user may add a rule with ``register``; every rule is scored by the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import confidence, flag
from tidemark.operators.panel import Rolling

# The windows of the parameter sweep and the exposures of the sweep over cuts.
MA_WINDOWS = (5, 10, 20, 30, 50, 100, 200)
EXPOSURES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

RULES: dict[str, Callable[[], Column]] = {}


def register(name: str):
    def keep(rule: Callable[[], Column]):
        RULES[name] = rule
        return rule

    return keep


def ma_pairs(windows: Sequence[int] = MA_WINDOWS) -> list[tuple[int, int]]:
    """Every (fast, slow) with fast < slow."""
    return list(combinations(sorted(windows), 2))


def _signal() -> Column:
    return F.col("signal").cast("double")


def by_regime(rising: Column | float, falling: Column | float, calm: Column | float) -> Column:
    """One value for a rising trend at high volatility, one for a falling trend at high
    volatility, one for everything else."""
    trend, high = F.col("trend_5_20"), F.col("high_vol")

    def value(x: Column | float) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    return (
        F.when((high == 1) & (trend == 1), value(rising))
        .when((high == 1) & (trend == 0), value(falling))
        .otherwise(value(calm))
    )


# ---------------------------------------------------------------------- moving averages


def long_flat(fast: str, slow: str) -> Column:
    return F.expr(f"CASE WHEN {fast} > {slow} THEN 1 ELSE 0 END")


def long_short(fast: str, slow: str) -> Column:
    return F.expr(f"CASE WHEN {fast} > {slow} THEN 1 ELSE -1 END")


def short_only(fast: str, slow: str) -> Column:
    return F.expr(f"CASE WHEN {fast} < {slow} THEN -1 ELSE 0 END")


def filtered_short(fast: str, slow: str, base: str = "ma200", rsi_above: float = 60) -> Column:
    return F.expr(f"CASE WHEN {fast} < {slow} AND close < {base} AND rsi > {rsi_above} THEN -1 ELSE 0 END")


def confirmed_signal(fast: str, slow: str, base: str = "ema200") -> Column:
    """EMA cross that price, RSI and range confirm."""
    confirmed = f"{fast} > {slow} AND close > {base} AND rsi > 50 AND atr / close > 0.015D"
    return F.expr(f"CASE WHEN {confirmed} THEN 1 ELSE 0 END")


def two_sided_ma() -> Column:
    down = (F.col("ma10") < F.col("ma20")) & (F.col("close") < F.col("ma200"))
    return F.when(F.col("ma5") > F.col("ma20"), 1).when(down, -1).otherwise(0)


# ---------------------------------------------------------------------- model signals


@register("ma_cross")
def ma_cross() -> Column:
    return flag(F.col("ma5") > F.col("ma20")).cast("double")


@register("model")
def model() -> Column:
    return _signal()


@register("proportional")
def proportional() -> Column:
    return _signal() * F.col("proba")


def volatility_cut(k: float) -> Column:
    """Exposure factor at high volatility."""
    return F.when(F.col("high_vol") == 1, F.lit(float(k))).otherwise(F.lit(1.0))


@register("conservative")
def conservative(k: float = 0.4) -> Column:
    return _signal() * volatility_cut(k)


def trend_scale() -> Column:
    return by_regime(2.0, 0.5, 1.0)


@register("trend_scaled")
def trend_scaled() -> Column:
    return _signal() * trend_scale()


@register("trend_scaled_open")
def trend_scaled_open() -> Column:
    """Probability raises the rising exposure without a lid."""
    p = F.col("proba")
    return F.when(F.col("signal") == 0, 0.0).otherwise(by_regime(1 + p, F.greatest(F.lit(0.1), 1 - p), 1.0))


@register("trend_scaled_proba")
def trend_scaled_proba() -> Column:
    p = F.col("proba")
    return _signal() * by_regime(F.least(F.lit(1.5), 1 + 0.5 * p), 0.5 * p, p)


@register("mean_reversion")
def mean_reversion() -> Column:
    return _signal() * by_regime(0.5, 1.5, 1.0)


@register("mean_reversion_proba")
def mean_reversion_proba() -> Column:
    p = F.col("proba")
    return by_regime(0.2 * p, 1 + 1.5 * (1 - p), 1.0)


@register("regime_hybrid")
def regime_hybrid() -> Column:
    p = F.col("proba")
    return F.when(F.col("signal") == 0, 0.0).otherwise(by_regime(1 + p, 1.5 - p, p))


def date_switched(start: str, end: str) -> Column:
    """Mean reversion inside [start, end], trend scaling outside."""
    inside = F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.when(inside, mean_reversion()).otherwise(trend_scaled())


def confident_pair(fast: str, slow: str, high: str = "high_vol") -> Column:
    """Confidence-sized position, doubled or halved by the pair's trend at high volatility."""
    scale = f"CASE WHEN {high} = 1 AND {fast} > {slow} THEN 2D WHEN {high} = 1 THEN 0.5D ELSE 1D END"
    return confidence(F.col("proba")) * F.expr(scale)


# ---------------------------------------------------------------------- timing


def earned(position: str, ret: str = "ret", timing: str = "lag_position", scale: Column | None = None) -> Rolling:
    """Return a position earns.

    ``lag_position``  yesterday's position, today's return
    ``same_bar``      today's position, today's return (sees the close it trades at)
    ``lag_signal``    yesterday's signal, today's ``scale``, today's return
    ``forward``       today's position, tomorrow's return
    """
    factor = F.lit(1.0) if scale is None else scale
    if timing == "lag_position":
        return Rolling(lambda w: F.lag(position, 1).over(w) * F.col(ret), back=1)
    if timing == "same_bar":
        return Rolling(lambda w: F.col(position) * F.col(ret))
    if timing == "lag_signal":
        return Rolling(lambda w: F.lag(position, 1).over(w) * factor * F.col(ret), back=1)
    if timing == "forward":
        return Rolling(lambda w: F.col(position) * F.lead(ret, 1).over(w), ahead=1)
    raise ValueError(f"unknown timing {timing}")
