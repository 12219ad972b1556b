"""Indicators as column builders (`Rolling`) and as steps on a `Panel`.

Every rolling value is null until its window is full. Comparisons that must not be null go through
``scalars.flag``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, ratio
from tidemark.operators.panel import POS, Affine, Panel, Rolling, Running

TRADING_DAYS = 252


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _full(aggregate, x: str | Column, n: int) -> Rolling:
    """``aggregate`` over the last ``n`` rows, null while fewer than ``n`` values are there."""

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(_col(x)).over(frame) == n, aggregate(_col(x)).over(frame))

    return Rolling(build, back=n - 1)


def sma(x: str | Column, n: int) -> Rolling:
    return _full(F.avg, x, n)


def sma_ladder(x: str, windows: Sequence[int], name: str = "ma{}") -> list[dict[str, Rolling | Column]]:
    """Layers for many averages of one column. A sliding frame costs its length per row; here a
    window that is the sum of two smaller ones adds two known sums instead, 200 = 100 + 100 rows
    earlier. Nothing is subtracted, so no precision is lost."""
    layers: list[dict[str, Rolling | Column]] = [{}]
    known: list[int] = []
    for n in sorted(windows):
        total = f"_sum{n}"
        first = next((a for a in reversed(known) if n - a in known), None)
        if first is None:
            layers[0][total] = rolling_sum(x, n)
        else:
            layers.append({total: _sum_of_two(f"_sum{first}", f"_sum{n - first}", first)})
        known.append(n)
    return [*layers, {name.format(n): F.col(f"_sum{n}") / n for n in windows}]


def _sum_of_two(recent: str, earlier: str, rows: int) -> Rolling:
    return Rolling(lambda w: F.col(recent) + F.lag(earlier, rows).over(w), back=rows)


def rolling_std(x: str | Column, n: int, annualise: bool = False) -> Rolling:
    plain = _full(F.stddev_samp, x, n)
    if not annualise:
        return plain
    return Rolling(lambda w: plain.build(w) * F.sqrt(F.lit(float(TRADING_DAYS))), plain.back)


def rolling_sum(x: str | Column, n: int) -> Rolling:
    return _full(F.sum, x, n)


def rolling_growth(r: str | Column, n: int) -> Rolling:
    """Growth of one unit over the last ``n`` returns."""
    return _full(F.product, 1 + _col(r), n)


def shift(x: str | Column, n: int = 1) -> Rolling:
    """Value ``n`` rows earlier; ``n`` rows later when negative."""
    if n >= 0:
        return Rolling(lambda w: F.lag(_col(x), n).over(w), back=n)
    return Rolling(lambda w: F.lead(_col(x), -n).over(w), ahead=-n)


def change(x: str | Column, k: int = 1) -> Rolling:
    """Simple return over ``k`` rows."""
    return Rolling(lambda w: F.try_divide(_col(x), F.lag(_col(x), k).over(w)) - 1, back=k)


def above_rolling_mean(x: str | Column, n: int = 20) -> Rolling:
    """1 when the value exceeds its own rolling mean, else 0 (also while the mean is null)."""
    mean = sma(x, n)
    return Rolling(lambda w: flag(_col(x) > mean.build(w)), mean.back)


def forward_growth(r: str | Column, h: int) -> Rolling:
    """Compounded return of rows t .. t+h-1; null unless row t+h exists."""

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(0, h - 1)
        return F.when(F.lead(F.lit(1), h).over(w) == 1, F.coalesce(F.product(1 + _col(r)).over(frame), F.lit(1.0)) - 1)

    return Rolling(build, ahead=h)


def true_range(high: str = "high", low: str = "low", close: str = "close") -> Rolling:
    def build(w: WindowSpec) -> Column:
        previous = F.lag(close, 1).over(w)
        return F.greatest(
            F.col(high) - F.col(low), F.abs(F.col(high) - previous), F.abs(F.col(low) - previous)
        )

    return Rolling(build, back=1)


def mean_deviation_index(n: int = 10, high: str = "high", low: str = "low", close: str = "close") -> Rolling:
    """CCI: typical price against its mean, in units of 0.015 mean absolute deviations."""

    def build(w: WindowSpec) -> Column:
        typical = (F.col(high) + F.col(low) + F.col(close)) / 3
        frame = w.rowsBetween(-(n - 1), 0)
        mean = F.avg(typical).over(frame)
        # Each row has its own mean, so the deviations are summed over n lagged values.
        spread = sum((F.abs(F.lag(typical, i).over(w) - mean) for i in range(1, n)), F.abs(typical - mean)) / n
        return F.when(F.count(typical).over(frame) == n, ratio(typical - mean, 0.015 * spread))

    return Rolling(build, back=n - 1)


# ---------------------------------------------------------------------- recurrences


def _first_row() -> Column:
    return F.col(POS) == 0


def ema_spec(x: str | Column, span: float) -> Affine:
    """EMA that starts at the first value."""
    alpha = 2.0 / (span + 1)
    return Affine(1 - alpha, F.when(_first_row(), _col(x)).otherwise(_col(x) * alpha))


def add_ema(panel: Panel, spans: Mapping[str, tuple[str, int]], min_periods: int = 0) -> Panel:
    """EMAs, ``{name: (column, span)}``, all in one scan."""
    panel = panel.scan({n: ema_spec(x, span) for n, (x, span) in spans.items()})
    if min_periods:
        panel = panel.with_columns({n: F.when(F.col(POS) >= min_periods - 1, F.col(n)) for n in spans})
    return panel


def add_weighted_ema(panel: Panel, name: str, x: str, span: int) -> Panel:
    """EMA with weights normalised over the rows seen so far."""
    keep = 1 - 2.0 / (span + 1)
    panel = panel.scan({"_num": Affine(keep, F.col(x)), "_den": Affine(keep, F.lit(1.0))})
    return panel.with_df(panel.df.withColumn(name, F.col("_num") / F.col("_den")).drop("_num", "_den"))


def add_rsi(panel: Panel, n: int = 14, x: str = "close", name: str = "rsi") -> Panel:
    panel = panel.roll({"_move": Rolling(lambda w: F.col(x) - F.lag(x, 1).over(w), back=1)})
    return finish_rsi(panel.scan(rsi_specs(n)), n, name)


def rsi_specs(n: int) -> dict[str, Affine]:
    """Wilder averages of the up and down moves in ``_move``; the first row counts as no move."""
    move = F.coalesce(F.col("_move"), F.lit(0.0))
    return {
        "_up": Affine(1 - 1.0 / n, F.greatest(move, F.lit(0.0)) / n),
        "_down": Affine(1 - 1.0 / n, F.greatest(-move, F.lit(0.0)) / n),
    }


def finish_rsi(panel: Panel, n: int, name: str) -> Panel:
    value = F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    df = panel.df.withColumn(name, F.when(F.col(POS) >= n - 1, value))
    return panel.with_df(df.drop("_up", "_down", "_move"))


def add_macd(panel: Panel, x: str = "close", name: str = "macd", fast: int = 12, slow: int = 26, sign: int = 9) -> Panel:
    """MACD histogram: fast EMA less slow EMA, less its own EMA."""
    panel = add_ema(panel, {"_fast": (x, fast), "_slow": (x, slow)})
    return finish_macd(panel, name, slow, sign)


def finish_macd(panel: Panel, name: str, slow: int = 26, sign: int = 9) -> Panel:
    # The line is null for slow-1 rows, so its EMA starts at row slow-1.
    line, start = F.col("_line"), slow - 1
    alpha = 2.0 / (sign + 1)
    drive = F.when(F.col(POS) < start, 0.0).when(F.col(POS) == start, line).otherwise(line * alpha)
    panel = panel.with_columns({"_line": F.col("_fast") - F.col("_slow")})
    panel = panel.scan({"_sign": Affine(1 - alpha, drive)})
    df = panel.df.withColumn(name, F.when(F.col(POS) >= slow + sign - 2, F.col("_line") - F.col("_sign")))
    return panel.with_df(df.drop("_fast", "_slow", "_line", "_sign"))


def add_atr(panel: Panel, n: int = 5, name: str = "atr", warmup: str = "zero") -> Panel:
    """Wilder's average true range. ``warmup``: rows before the first full window are 'zero' or 'null'."""
    panel = panel.roll({"_range": true_range()}, {"_seed": sma("_range", n)})
    return finish_atr(panel.scan({"_atr": atr_spec(n)}), n, name, warmup)


def atr_spec(n: int, ranges: str = "_range", seed: str = "_seed", start: int | None = None) -> Affine:
    """Wilder average of ``ranges``, starting from the plain mean in ``seed`` at row ``start``."""
    first = n - 1 if start is None else start
    drive = F.when(F.col(POS) < first, 0.0).when(F.col(POS) == first, F.col(seed)).otherwise(F.col(ranges) / n)
    return Affine(1 - 1.0 / n, drive)


def finish_atr(panel: Panel, n: int, name: str, warmup: str = "zero") -> Panel:
    if warmup not in ("zero", "null"):
        raise ValueError("warmup is 'zero' or 'null'")
    early = F.lit(0.0) if warmup == "zero" else F.lit(None).cast("double")
    df = panel.df.withColumn(name, F.when(F.col(POS) < n - 1, early).otherwise(F.col("_atr")))
    return panel.with_df(df.drop("_range", "_seed", "_atr"))


def add_adx(panel: Panel, n: int = 5) -> Panel:
    """Wilder's directional movement: ``adx``, ``di_pos``, ``di_neg``."""

    def moves(w: WindowSpec) -> tuple[Column, Column]:
        return F.col("high") - F.lag("high", 1).over(w), F.lag("low", 1).over(w) - F.col("low")

    def up_move(w: WindowSpec) -> Column:
        up, down = moves(w)
        return F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0)

    def down_move(w: WindowSpec) -> Column:
        up, down = moves(w)
        return F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0)

    def ranged(w: WindowSpec) -> Column:  # the first row has no previous bar and takes no part
        return F.when(F.lag("close", 1).over(w).isNotNull(), true_range().build(w))

    parts = {"_tr": ranged, "_up": up_move, "_dn": down_move}
    panel = panel.roll(
        {p: Rolling(build, back=1) for p, build in parts.items()}, {f"{p}_seed": sma(p, n) for p in parts}
    )
    panel = panel.scan({f"{p}_avg": atr_spec(n, p, f"{p}_seed", start=n) for p in parts})
    ready = F.col(POS) >= n
    panel = panel.with_columns(
        {
            "di_pos": F.when(ready, 100 * ratio(F.col("_up_avg"), F.col("_tr_avg"))),
            "di_neg": F.when(ready, 100 * ratio(F.col("_dn_avg"), F.col("_tr_avg"))),
        }
    )
    spread = ratio(F.abs(F.col("di_pos") - F.col("di_neg")), F.col("di_pos") + F.col("di_neg"))
    panel = panel.with_columns({"_dx": F.when(ready, 100 * F.coalesce(spread, F.lit(0.0)))})
    panel = panel.roll({"_dx_seed": sma("_dx", n)})
    panel = panel.scan({"_adx": atr_spec(n, "_dx", "_dx_seed", start=2 * n - 1)})
    df = panel.df.withColumn("adx", F.when(F.col(POS) >= 2 * n - 1, F.col("_adx")))
    helpers = [f"{p}{tail}" for p in (*parts, "_dx") for tail in ("", "_seed", "_avg")]
    return panel.with_df(df.drop(*helpers, "_adx"))


# ---------------------------------------------------------------------- curves


def add_equity(panel: Panel, curves: Mapping[str, str], base: float = 1.0, fill: bool = False) -> Panel:
    """Growth curves ``{name: return column}``. A null return leaves a null row and the curve goes
    on after it; with ``fill`` it counts as no change."""
    specs = {}
    for name, r in curves.items():
        value = F.coalesce(F.col(r), F.lit(0.0)) if fill else F.col(r)
        specs[name] = Running("prod", 1 + value)
    panel = panel.scan(specs)
    return panel if base == 1.0 else panel.with_columns({n: base * F.col(n) for n in curves})


def add_drawdown(panel: Panel, curve: str, name: str = "drawdown", relative: bool = False) -> Panel:
    """Distance below the running peak, in curve units or as a share of the peak."""
    panel = panel.scan({"_peak": Running("max", F.col(curve))})
    gap = F.col("_peak") - F.col(curve)
    return panel.with_df(panel.df.withColumn(name, ratio(gap, F.col("_peak")) if relative else gap).drop("_peak"))


def add_rebased(panel: Panel, curve: str, name: str) -> Panel:
    """Percent change of a curve since its first value."""
    start = F.min_by(curve, F.when(F.col(curve).isNotNull(), F.col(POS)))
    panel = panel.totals({"_start": start})
    return panel.with_df(
        panel.df.withColumn(name, 100 * (ratio(F.col(curve), F.col("_start")) - 1)).drop("_start")
    )
