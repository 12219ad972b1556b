"""From bars to scored strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.indicators import (
    above_rolling_mean,
    add_ema,
    add_rsi,
    atr_spec,
    change,
    ema_spec,
    finish_atr,
    finish_macd,
    finish_rsi,
    rolling_std,
    rsi_specs,
    sma,
    sma_ladder,
    true_range,
)
from tidemark.functions.scalars import flag, label
from tidemark.operators.holding import hold_positions
from tidemark.operators.panel import Panel, Rolling, Running
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.scoring import Leg, score

Layer = Mapping[str, Rolling | Column]


@dataclass(frozen=True)
class Rule:
    """A position and how it earns; ``scale`` only for ``lag_signal``."""

    position: Column
    timing: str = "lag_position"
    scale: Column | None = None


# The six strategies compared throughout, under the names of the exported table (fixed values).
COMPARED = {
    "Buy & Hold": None,
    "MA Crossover": "ma_cross",
    "ML-Based": "model",
    "Conservative Vol-Scaled ML": "conservative",
    "Dynamic TCVS": "trend_scaled_proba",
    "Mean-Reversion": "mean_reversion",
}

# Display name to label (fixed values), in the order that breaks ties.
LABEL_OF = {
    "ML-Based": "ML_Strategy",
    "Conservative Vol-Scaled ML": "Conservative_Strategy",
    "Dynamic TCVS": "TCVS_Dynamic",
    "Mean-Reversion": "MeanReversion",
}


def market_layers(vol_rows: int = 10, mean_rows: int = 20, vol_of: str = "rvol") -> list[Layer]:
    """Returns, averages and the trend and volatility flags that the rules read. ``vol_of`` names
    the column whose rise over its own rolling mean is high volatility: ``rvol`` or ``atr``."""
    return [
        {
            "ret": change("close"),
            "ret5": change("close", 5),
            "ret10": change("close", 10),
            "ma5": sma("close", 5),
            "ma20": sma("close", 20),
        },
        {
            "rvol": rolling_std("ret", vol_rows, annualise=True),
            "trend_5_20": flag(F.col("ma5") > F.col("ma20")),
        },
        {"high_vol": above_rolling_mean(vol_of, mean_rows)},
        {"trend_highvol": F.col("trend_5_20") * F.col("high_vol")},
    ]


def rule_layers(rules: Mapping[str, Rule], ret: str = "ret") -> tuple[list[Layer], list[Leg]]:
    """Layers that add ``pos_i`` and ``ret_i`` per rule, and the legs to score them."""
    positions: dict[str, Column] = {}
    returns: dict[str, Rolling] = {}
    legs = []
    for i, (name, rule) in enumerate(rules.items()):
        positions[f"pos_{i}"] = rule.position
        returns[f"ret_{i}"] = R.earned(f"pos_{i}", ret, rule.timing, rule.scale)
        legs.append(Leg(name, f"ret_{i}", f"pos_{i}"))
    return [positions, returns], legs


def compared_rules(names: Sequence[str] = tuple(COMPARED)) -> dict[str, Rule]:
    return {n: Rule(R.RULES[COMPARED[n]]()) for n in names if COMPARED[n]}


def compare(panel: Panel, names: Sequence[str] = tuple(COMPARED), layers: Sequence[Layer] | None = None) -> tuple[Panel, list[Leg]]:
    """Panel with the returns of the named strategies, and their legs in the order named."""
    more, ruled = rule_layers(compared_rules(names))
    panel = panel.roll(*(market_layers() if layers is None else layers), *more)
    by_name = {leg.name: leg for leg in ruled}
    return panel, [by_name.get(n, Leg(n, "ret")) for n in names]


def strategy_returns(panel: Panel, names: Sequence[str] = tuple(COMPARED), labels: bool = False) -> Panel:
    """Wide table: one return column per strategy, under display names or labels."""
    panel, legs = compare(panel, names)
    shown = [F.col(leg.ret).alias(LABEL_OF.get(leg.name, leg.name) if labels else leg.name) for leg in legs]
    kept = [c for c in panel.df.columns if not c.startswith(("pos_", "ret_"))]
    return panel.with_df(panel.df.select(*kept, *shown))


# ---------------------------------------------------------------------- sweeps


def _pair_legs(windows: Sequence[int]) -> list[tuple[int, int, str, str]]:
    return [(f, s, f"pos_{f}_{s}", f"ret_{f}_{s}") for f, s in R.ma_pairs(windows)]


def _pair_score(panel: Panel, windows: Sequence[int]) -> DataFrame:
    legs = [Leg(f"{f}/{s}", r, p, {"fast": f, "slow": s}) for f, s, p, r in _pair_legs(windows)]
    return score(panel, legs, "A")


def sma_sweep(
    panel: Panel, rule=R.long_flat, windows: Sequence[int] = R.MA_WINDOWS, with_rsi: bool = False
) -> DataFrame:
    """Score a rule of (fast, slow) for every pair of windows. Rows without the longest average
    are left out before positions are taken, as are rows without RSI when it is used."""
    longest = f"ma{max(windows)}"
    if with_rsi:
        panel = add_rsi(panel)
    valid = F.col(longest).isNotNull()
    if with_rsi:
        valid = valid & F.col("rsi").isNotNull()
    pairs = _pair_legs(windows)
    averages = sma_ladder("close", windows)
    averages[0]["ret"] = change("close")
    positions = {p: F.when(valid, rule(f"ma{f}", f"ma{s}")) for f, s, p, _ in pairs}
    returns = {r: R.earned(p) for _, _, p, r in pairs}
    panel = panel.roll(*averages, positions, returns).where(valid)
    return _pair_score(panel, windows)


def ema_sweep(panel: Panel, windows: Sequence[int] = R.MA_WINDOWS) -> DataFrame:
    """Long/flat on EMA pairs; an EMA has no warm-up, so every row counts."""
    panel = add_ema(panel, {f"ema{n}": ("close", n) for n in windows})
    pairs = _pair_legs(windows)
    positions = {p: R.long_flat(f"ema{f}", f"ema{s}") for f, s, p, _ in pairs}
    panel = panel.roll({"ret": change("close"), **positions}, {r: R.earned(p) for _, _, p, r in pairs})
    return _pair_score(panel, windows)


def confirmed_ema_sweep(panel: Panel, windows: Sequence[int] = R.MA_WINDOWS, hold: int = 5, rsi_rows: int = 14, atr_rows: int = 5) -> DataFrame:
    """EMA pairs confirmed by price, RSI and range, held at least ``hold`` quiet rows."""
    move = Rolling(lambda w: F.col("close") - F.lag("close", 1).over(w), back=1)
    panel = panel.roll({"ret": change("close"), "_move": move, "_range": true_range()}, {"_seed": sma("_range", atr_rows)})
    emas = {f"ema{n}": ema_spec("close", n) for n in windows}
    panel = panel.scan({**emas, **rsi_specs(rsi_rows), "_atr": atr_spec(atr_rows)})
    panel = finish_atr(finish_rsi(panel, rsi_rows, "rsi"), atr_rows, "atr")
    valid = F.col("rsi").isNotNull()
    pairs = _pair_legs(windows)
    base = f"ema{max(windows)}"
    # Rows before the RSI is there have no signal and an empty budget, as if they were not there.
    signals = {p: F.col("_valid") & (R.confirmed_signal(f"ema{f}", f"ema{s}", base) == 1) for f, s, p, _ in pairs}
    panel = panel.with_columns({"_valid": valid})
    panel = hold_positions(panel, signals, hold, keep=("ret", "_valid"))
    panel = panel.with_columns({p: F.when(F.col("_valid"), F.col(p)) for _, _, p, _ in pairs})
    panel = panel.roll({r: R.earned(p) for _, _, p, r in pairs}).where(F.col("_valid"))
    return _pair_score(panel, windows)


def confident_pair_sweep(panel: Panel, windows: Sequence[int] = R.MA_WINDOWS, q: float = 0.7, train_share: float = 0.8) -> DataFrame:
    """Confidence-sized positions for every pair on the last rows of each series, earning the
    next bar. High volatility is context above its quantile over those rows."""
    pairs = _pair_legs(windows)
    longest = f"ma{max(windows)}"
    averages = sma_ladder("close", windows)
    averages[0]["next_ret"] = Rolling(lambda w: F.lead("close", 1).over(w) / F.col("close") - 1, ahead=1)
    panel = panel.roll(*averages).where(F.col(longest).isNotNull())
    panel = chrono_split(panel, train_share).where(F.col("train") == 0)
    panel = add_high_vol_quantile(panel, "vix", q)
    panel = panel.with_columns({p: R.confident_pair(f"ma{f}", f"ma{s}") for f, s, p, _ in pairs})
    panel = panel.with_columns({r: F.col(p) * F.col("next_ret") for _, _, p, r in pairs})
    return _pair_score(panel, windows)


def exposure_sweep(panel: Panel, exposures: Sequence[float] = R.EXPOSURES) -> DataFrame:
    """The volatility cut at several depths, on yesterday's signal and today's volatility."""
    layers = [*market_layers(), {"pos_s": R.model()}]
    layers.append({f"ret_{i}": R.earned("pos_s", timing="lag_signal", scale=R.volatility_cut(k)) for i, k in enumerate(exposures)})
    legs = [Leg(f"cut {k}", f"ret_{i}", "pos_s", {"exposure": k}) for i, k in enumerate(exposures)]
    return score(panel.roll(*layers), legs, "B1")


def best_parameter(scored: DataFrame, keys: Sequence[str], parameter: str) -> DataFrame:
    """Parameter with the highest Sharpe; the smaller parameter wins a tie."""
    order = F.struct(F.col("sharpe"), -F.col(parameter))
    return scored.where(F.col("sharpe").isNotNull()).groupBy(*keys).agg(
        F.max_by(parameter, order).alias(parameter), F.max("sharpe").alias("sharpe")
    )


# ---------------------------------------------------------------------- features


def add_high_vol_quantile(panel: Panel, x: str, q: float = 0.7, name: str = "high_vol") -> Panel:
    """1 when ``x`` exceeds its quantile over the whole series, which looks ahead on purpose."""
    if panel.blocked:
        cut = exact_quantiles(panel.df, panel.keys, x, [q])
        panel = panel.attach(cut.select(*panel.keys, F.get("q", F.lit(0)).alias("_cut")))
    else:
        panel = panel.totals({"_cut": F.percentile(x, q)})
    return panel.with_df(panel.df.withColumn(name, flag(F.col(x) > F.col("_cut"))).drop("_cut"))


def features(panel: Panel, vol_rows: int = 10, high_vol: str = "context", q: float = 0.7) -> Panel:
    """The feature table. ``high_vol``: 'context' (VIX above its quantile) or 'rolling' (realised
    volatility above its own 20-row mean). All first recurrences share one scan."""
    move = Rolling(lambda w: F.col("close") - F.lag("close", 1).over(w), back=1)
    layers = market_layers(vol_rows)
    first = {**layers[0], "_move": move, "_range": true_range()}
    second = {**layers[1], "_seed": sma("_range", 5)}
    rest = layers[2:] if high_vol == "rolling" else []
    panel = panel.roll(first, second, *rest)
    panel = panel.scan({"_fast": ema_spec("close", 12), "_slow": ema_spec("close", 26), **rsi_specs(14), "_atr": atr_spec(5)})
    panel = finish_macd(finish_rsi(finish_atr(panel, 5, "atr"), 14, "rsi"), "macd")
    if high_vol == "context":
        panel = add_high_vol_quantile(panel, "vix", q)
        panel = panel.with_columns({"trend_highvol": F.col("trend_5_20") * F.col("high_vol")})
    return panel


def add_regimes(panel: Panel, x: str = "vix", q: float = 0.7) -> Panel:
    """Two-way labels. Unknown counts as the second label."""
    panel = add_high_vol_quantile(panel, x, q, "_high")
    df = panel.df.withColumns(
        {
            "trend": label(F.col("close") > F.col("ma5"), "Up", "Down"),
            "volatility_regime": label(F.col("_high") == 1, "High", "Normal"),
        }
    )
    return panel.with_df(df.drop("_high"))


def chrono_split(panel: Panel, share: float, name: str = "train", gap: int = 0) -> Panel:
    """1 on the first ``floor(share * n)`` rows of each series, 0 on the rest. Of the first rows, the last ``gap`` are null: labels
    that look ``gap`` rows ahead would know rows of the rest."""
    panel = panel.scan({"_i": Running("sum", F.lit(1.0))}).totals({"_n": F.count(F.lit(1))})
    cut = F.floor(F.lit(float(share)) * F.col("_n"))
    first = F.when(F.col("_i") <= cut - gap, 1).when(F.col("_i") > cut, 0)
    return panel.with_df(panel.df.withColumn(name, first).drop("_i", "_n"))
