"""A series cut into segments gives the same values as a series in one group."""

import datetime as dt
import math

import pytest
from data import random_bars
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import rules as R
from tidemark.operators import analysis, backtest, labels
from tidemark.operators.holding import hold_positions
from tidemark.operators.panel import POS, Running, arrange
from tidemark.operators.scoring import FAMILIES, score


def both(spark, build, rows=64, sizes=(300, 37, 1)):
    bars = random_bars(spark, sizes).withColumn("proba", ((F.col("volume") * 37) % 100) / 100.0)
    bars = bars.withColumn("signal", (F.col("proba") > 0.3).cast("int"))
    plain, cut = arrange(bars, slots=4000), arrange(bars, rows=rows)
    assert not plain.blocked and cut.blocked
    return build(plain), build(cut)


def same(a, b, keys):
    columns = sorted(c for c in a.columns if c != "_seg")
    left = sorted((tuple(r[c] for c in [*keys, *columns]) for r in a.select(*columns).collect()), key=str)
    right = sorted((tuple(r[c] for c in [*keys, *columns]) for r in b.select(*columns).collect()), key=str)
    assert len(left) == len(right) and left
    for x, y in zip(left, right):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (x, y)
            else:
                assert u == v, (x, y)


BUILDS = {
    "sma": lambda p: p.roll({"x": I.sma("close", 20), "y": I.rolling_std("close", 7), "z": I.change("close", 5)}),
    "ladder": lambda p: p.roll(*I.sma_ladder("close", (5, 10, 11, 20, 30))),
    "lead": lambda p: p.roll({"x": I.shift("close", -9), "y": I.shift("close", 3), "z": I.forward_growth(F.col("close") / 1e4, 12)}),
    "layers": lambda p: p.roll(*backtest.market_layers(5, 10)),
    "running": lambda p: p.scan(
        {
            "a": Running("sum", F.col("close")),
            "b": Running("max", F.col("close")),
            "c": Running("min", F.col("close")),
            "d": Running("prod", 1 + F.when(F.col("volume") % 3 > 0, F.col("close") / 1e5)),
        }
    ),
    "ema": lambda p: I.add_ema(p, {"a": ("close", 3), "b": ("close", 26), "c": ("close", 200)}),
    "weighted_ema": lambda p: I.add_weighted_ema(p, "a", "high", 5),
    "rsi": I.add_rsi,
    "macd": I.add_macd,
    "atr": I.add_atr,
    "adx": I.add_adx,
    "cci": lambda p: p.roll({"cci": I.mean_deviation_index(10)}),
    "hold": lambda p: hold_positions(p, {"on": F.col("volume") % 7 == 0, "on3": F.col("volume") % 3 == 0}),
    "totals": lambda p: p.totals({"n": F.count(F.lit(1)), "v": F.sum("volume")}),
    "quantile": lambda p: backtest.add_high_vol_quantile(p, "vix"),
    "features": backtest.features,
    "drawdown": lambda p: I.add_drawdown(I.add_equity(p.roll({"r": I.change("close")}), {"eq": "r"}), "eq", relative=True),
    "rebased": lambda p: I.add_rebased(p, "close", "x"),
    "split": lambda p: backtest.chrono_split(p, 0.8),
    "dominance": lambda p: labels.dominance(p.roll({"a": I.change("close"), "b": I.change("high"), "c": I.change("low")}), "a", ["b", "c"], 10),
    "events": lambda p: analysis.crossover_events(p.roll({"a": I.change("close"), "b": I.change("high")}), "a", "b"),
}


@pytest.mark.parametrize("name", BUILDS)
def test_segments_do_not_change_values(spark, name):
    a, b = both(spark, BUILDS[name])
    same(a.df, b.df, ["symbol", POS])


@pytest.mark.parametrize("family", FAMILIES)
def test_scores_do_not_depend_on_segments(spark, family):
    def build(p):
        # A short position of up to 40 times makes some growth factors negative.
        p, legs = backtest.compare(p)
        p = p.with_columns({"ret_x": -40 * F.col("ret_0")})
        from tidemark.operators.scoring import Leg

        return score(p, [*legs, Leg("wild", "ret_x")], family)

    a, b = both(spark, build)
    columns = [c for c in a.columns if c not in ("ann_return", "sharpe")]
    same(a.select(columns), b.select(columns), ["symbol", "strategy"])


def test_sweeps_do_not_depend_on_segments(spark):
    windows = (3, 7, 20)
    for sweep in (backtest.sma_sweep, backtest.ema_sweep, backtest.confirmed_ema_sweep, backtest.confident_pair_sweep):
        a, b = both(spark, lambda p: sweep(p, windows=windows))
        same(a, b, ["symbol", "strategy"])


def test_frame_longer_than_a_segment(spark):
    def build(p):
        return p.roll({"x": I.sma("close", 50), "y": I.shift("close", -41), "z": I.shift("close", 33), "f": I.forward_growth(F.col("close") / 1e4, 20)})

    a, b = both(spark, build, rows=16)
    same(a.df, b.df, ["symbol", POS])


def loop(closes, start, step):
    out = []
    for t, x in enumerate(closes):
        out.append(start(x) if t == 0 else step(out[-1], x, closes[t - 1]))
    return out


def wilder_rsi(closes, n):
    up = loop(closes, lambda x: 0.0, lambda y, x, last: (y * (n - 1) + max(x - last, 0)) / n)
    down = loop(closes, lambda x: 0.0, lambda y, x, last: (y * (n - 1) + max(last - x, 0)) / n)
    # As long as both averages are ordinary doubles.
    return [100 - 100 / (1 + u / d) if t >= n - 1 and d > 1e-290 else None for t, (u, d) in enumerate(zip(up, down))]


@pytest.mark.parametrize("layout", [{"slots": 4000}, {"slots": 1400}, {"slots": 60_000}, {"rows": 256}, {"rows": 700}])
def test_recurrences_of_a_series_that_comes_to_rest(spark, layout):
    moving = [100 + (7 * i * i % 11) / 8 for i in range(20)]
    closes = moving + [moving[-1]] * 1300
    bars = spark.createDataFrame([("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(closes)], "symbol string, ts date, close double")
    panel = I.add_rsi(I.add_ema(arrange(bars, **layout), {"ema": ("close", 3), "slow": ("close", 26)}), 3, name="rsi3")
    rows = I.add_rsi(panel, 14).select(POS, "ema", "slow", "rsi3", "rsi").orderBy(POS).collect()
    expected = {"ema": loop(closes, lambda x: x, lambda y, x, _: (y + x) / 2), "slow": loop(closes, lambda x: x, lambda y, x, _: y + (x - y) * 2 / 27)}
    expected |= {"rsi3": wilder_rsi(closes, 3), "rsi": wilder_rsi(closes, 14)}
    for name, values in expected.items():
        for row, value in zip(rows, values, strict=True):
            if value is not None:
                assert math.isclose(row[name], value, rel_tol=1e-9), (name, row[POS], row[name], value)
    assert len({round(r["rsi3"], 9) for r in rows[20:]}) == 1 and rows[1319]["rsi3"] < 99


@pytest.mark.parametrize("rows", [4096, 1000])
def test_intraday_bars(spark, rows):
    closes = [100 + math.sin(i) for i in range(4800)]
    stamped = [("a", dt.datetime(2000, 1, 1) + dt.timedelta(hours=i), x) for i, x in enumerate(closes)]
    bars = spark.createDataFrame(stamped, "symbol string, ts timestamp, close double")
    with pytest.raises(ValueError):
        arrange(bars)
    got = I.add_ema(arrange(bars, grain="hour", rows=rows), {"ema": ("close", 5)}).select(POS, "ema").orderBy(POS).collect()
    for row, value in zip(got, loop(closes, lambda x: x, lambda y, x, _: y + (x - y) / 3), strict=True):
        assert math.isclose(row["ema"], value, rel_tol=1e-9)
    with pytest.raises(Exception, match="calendar slot"):
        I.add_ema(arrange(bars, grain="day", rows=rows), {"ema": ("close", 5)}).df.collect()


def test_repeated_bars_are_an_error(spark):
    bars = random_bars(spark, (30,))
    for layout in ({}, {"rows": 8}):
        with pytest.raises(Exception, match="calendar slot"):
            arrange(bars.union(bars.limit(3)), **layout).df.collect()


def test_more_signals_than_a_long_has_bits(spark):
    panel = arrange(random_bars(spark, (120, 5)), slots=4000)
    signals = {f"s{i}": (F.col("volume") + i) % 7 == 0 for i in range(70)}
    rows = hold_positions(panel, signals, 5, keep=("volume",)).df.orderBy("symbol", POS).collect()
    for i in (0, 61, 62, 69):
        for symbol in ("s0", "s1"):
            budget = 0
            for r in (r for r in rows if r["symbol"] == symbol):
                signal = (r["volume"] + i) % 7 == 0
                assert r[f"s{i}"] == int(signal or budget > 0)
                budget = (budget or 5) if signal else max(budget - 1, 0)


def test_screen_does_not_depend_on_segments(spark):
    def build(p):
        p = I.add_adx(I.add_rsi(I.add_weighted_ema(p, "ema_high", "high", 5)))
        p = p.roll({"cci": I.mean_deviation_index(10)})
        return p.last_rows("ts", "rsi", "cci", "adx", "di_pos", "ema_high")

    a, b = both(spark, build)
    same(a, b, ["symbol"])


def test_min_hold_rule_name(spark):
    assert "mean_reversion" in R.RULES


def test_ladder_equals_plain_frames(spark):
    windows = (3, 6, 7, 13, 20)
    panel = arrange(random_bars(spark), slots=4000)
    a = panel.roll(*I.sma_ladder("close", windows)).select("symbol", POS, *[f"ma{n}" for n in windows])
    b = panel.roll({f"ma{n}": I.sma("close", n) for n in windows}).select("symbol", POS, *[f"ma{n}" for n in windows])
    same(a, b, ["symbol", POS])
