"""Properties that hold for any input, and brute-force comparisons."""

import datetime as dt
import random

import numpy as np
import pytest
from data import random_bars
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import backtest as B
from tidemark.operators import learning as M
from tidemark.operators import quantiles
from tidemark.operators.holding import hold_positions
from tidemark.operators.panel import POS, arrange
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.scoring import score
from tidemark.session import cut, scratch_path
from tidemark.sources import bars as S
from tidemark.sources.tables import BARS, read_table, write_table
from tidemark.streaming import jobs


def naive_hold(signal, hold):
    out, left = [], 0
    for s in signal:
        out.append(1 if s or left else 0)
        if s:
            left = left or hold
        elif left:
            left -= 1
    return out


@pytest.mark.parametrize("layout", [{"slots": 4000}, {"rows": 50}])
@pytest.mark.parametrize("hold", [1, 3, 5, 8])
def test_held_positions_equal_a_loop(spark, hold, layout):
    rng = random.Random(hold)
    signals = [[int(rng.random() < p) for _ in range(400)] for p in (0.02, 0.1, 0.5, 0.9, 0.0, 1.0)]
    start = dt.date(2020, 1, 1)
    rows = [("a", start + dt.timedelta(days=t), [s[t] for s in signals]) for t in range(400)]
    panel = arrange(spark.createDataFrame(rows, "symbol string, ts date, s array<int>"), **layout)
    named = {f"on{i}": F.col("s")[i] == 1 for i in range(len(signals))}
    got = hold_positions(panel, named, hold, keep=()).df.orderBy(POS).collect()
    for i, s in enumerate(signals):
        assert [r[f"on{i}"] for r in got] == naive_hold(s, hold)


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    values = {"hot": np.round(rng.exponential(3, 40000), 3), "ties": np.repeat([1.0, 2.0, 5.0], 4000), "few": rng.normal(size=7)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = [0.0, 0.25, 0.5, 0.7, 0.999, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", qs, accuracy=500).collect()}
    for k, vs in values.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, qs), atol=1e-12)


def test_brackets_are_narrowed(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=60_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame([("hot", float(x)) for x in values], "k string, v double")
    written = []
    monkeypatch.setattr(quantiles, "cut", lambda d, label: written.append(label) or cut(d, label))
    qs = (0.0, 0.1, 0.5, 0.73, 1.0)
    got = exact_quantiles(df, ["k"], "v", qs, accuracy=100, bound=1000).first()["q"]
    np.testing.assert_allclose(got, np.quantile(values, qs), atol=1e-12)
    assert written.count("brackets") >= 2


def test_symbols_do_not_touch_each_other(spark):
    bars = random_bars(spark, (120, 80)).withColumn("proba", F.lit(0.9)).withColumn("signal", F.lit(1))
    legs = B.compare(arrange(bars))
    both = {(r["symbol"], r["strategy"]): r["final_value"] for r in score(*legs, "C").collect()}
    for symbol in ("s0", "s1"):
        alone = score(*B.compare(arrange(bars.where(F.col("symbol") == symbol))), "C").collect()
        for r in alone:
            assert both[symbol, r["strategy"]] == pytest.approx(r["final_value"], rel=1e-12)


def test_timing_sees_no_future(spark):
    """Changing a close leaves returns of lagged positions before it alone; same-bar ones may move."""
    bars = random_bars(spark, (60,)).withColumn("proba", F.lit(0.9)).withColumn("signal", F.lit(1))
    day = sorted(r["ts"] for r in bars.collect())[40]
    bent = bars.withColumn("close", F.when(F.col("ts") == day, F.col("close") * 1.5).otherwise(F.col("close")))

    def earned(df, timing):
        more, _ = B.rule_layers({"x": B.Rule(R.ma_cross(), timing)})
        panel = arrange(df).roll(*B.market_layers(5, 5), *more)
        return {r["ts"]: (r["ret"], r["ret_0"]) for r in panel.select("ts", "ret", "ret_0").collect()}

    a, b = earned(bars, "lag_position"), earned(bent, "lag_position")
    assert all(a[t] == b[t] for t in a if t < day)
    ratio_a, ratio_b = a[day][1] / a[day][0], b[day][1] / b[day][0]
    assert ratio_a == pytest.approx(ratio_b)  # the position of that day was set the day before


def test_shares_add_up(spark):
    row = B.sma_sweep(arrange(random_bars(spark, (200,))), R.long_short, (3, 8, 20)).first()
    assert row["pct_long"] + row["pct_short"] == pytest.approx(100.0)


def test_chunks_restart_and_short_ones_go(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 9)] + [dt.date(2024, 3, 5)]
    rows = [("x", d, 1.0, 2.0, 1.0, 1.5, 1) for d in days]
    bars = spark.createDataFrame(rows, BARS)
    loaded = S.ingest_chunks(bars, "2024-01-01", grain="day").orderBy("ts").collect()
    assert [r["ts"] for r in loaded] == days[:8]
    assert [r["atr"] for r in loaded] == pytest.approx([0.0] * 4 + [1.0] * 4)
    doubled = bars.unionByName(bars.withColumn("ts", F.col("ts")))
    assert S.first_per_key(doubled, ("symbol", "ts"), ("close",)).count() == 9


def test_csv_round_trip_turns_nan_into_null(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("x", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, float("nan"), 7)], BARS)
    write_table(df, path, "csv")
    row = read_table(spark, path, BARS, "csv").first()
    assert row["close"] is None and row["ts"] == dt.date(2024, 1, 1) and row["volume"] == 7


def test_stream_goes_on_where_it_stopped(spark):
    """Two arrivals with one checkpoint equal one batch computation."""
    from tidemark.functions import indicators as I

    bars = random_bars(spark, (90, 40), gap=0.0).select("symbol", "ts", "high", "low", "close")
    source, path, checkpoint = (scratch_path(spark, n) for n in ("src", "out", "chk"))
    middle = dt.date(2020, 1, 31)
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        write_table(bars.where(part).coalesce(1), source, mode="append")
        arriving = spark.readStream.schema(bars.schema).parquet(source)
        out = jobs.run_to_table(jobs.stream_indicators(arriving), path, checkpoint)
    panel = I.add_atr(I.add_rsi(I.add_ema(arrange(bars), {"ema": ("close", 12)})))
    panel = hold_positions(panel, {"position": F.col("rsi") > 60})
    expected = {(r["symbol"], r["ts"]): r for r in panel.df.collect()}
    got = out.collect()
    assert len(got) == 130
    for r in got:
        e = expected[r["symbol"], r["ts"]]
        assert r["position"] == e["position"]
        for c in ("ema", "rsi", "atr"):
            assert (r[c] is None and e[c] is None) or r[c] == pytest.approx(e[c], rel=1e-9), c


@pytest.fixture(scope="module")
def planted(spark):
    """The winner follows the sign of one feature in nine rows of ten."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        up = (x > 0) if rng.random() < 0.9 else (x <= 0)
        rows.append((f"s{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), x, y, "up" if up else "down", int(up)))
    return cut(spark.createDataFrame(rows, "symbol string, ts date, x double, y double, label string, target int"))


def test_forest_finds_a_planted_signal_and_survives_saving(spark, planted):
    early = M.hashed_split(planted, ["symbol", "ts"])
    model = M.train(planted.where(early), ["x", "y"], "label", M.Forest(20, 4))
    test = planted.where(~early)
    scored = M.predict_strategy(test, model)
    hits = scored.where("strategy = label").count() / scored.count()
    assert hits > 0.8 and scored.where("probability < 0.5 OR probability > 1").count() == 0
    path = scratch_path(spark, "model")
    M.save_model(model, path)
    again = M.predict_strategy(test.drop("label"), M.load_model(path))
    assert again.exceptAll(scored.drop("label")).count() == 0
    ranked = M.importances(spark, model).collect()
    assert ranked[0]["feature"] == "x" and sum(r["importance"] for r in ranked) == pytest.approx(1.0)


def test_split_is_repeatable_and_near_its_share(spark, planted):
    split = M.hashed_split(planted, ["symbol", "ts"])
    first = {(r[0], r[1]) for r in planted.where(split).select("symbol", "ts").collect()}
    second = {(r[0], r[1]) for r in planted.repartition(5).where(split).select("symbol", "ts").collect()}
    assert first == second and 0.7 < len(first) / 600 < 0.9


def test_report_and_thresholds(spark):
    rows = [("a", "a", 1, 0.9)] * 3 + [("a", "b", 1, 0.2)] + [("b", "b", 0, 0.4)] * 2 + [("c", "a", 0, 0.7)]
    df = spark.createDataFrame(rows, "actual string, guess string, y int, p double")
    report = {r["class"]: r for r in M.classification_report(df, "actual", "guess").collect()}
    assert report["a"]["precision"] == 0.75 and report["a"]["recall"] == 0.75 and report["c"]["f1"] == 0.0
    assert report["accuracy"]["f1"] == pytest.approx(5 / 7) and report["macro avg"]["support"] == 7
    swept = {r["threshold"]: r for r in M.threshold_sweep(df, "y", "p", [0.3, 0.7, 0.95]).collect()}
    assert swept[0.7]["precision"] == 1.0 and swept[0.7]["recall"] == 0.75 and swept[0.95]["f1"] == 0.0
    matrix = {r["actual"]: r for r in M.confusion_matrix(df, "actual", "guess", ["a", "b", "c"]).collect()}
    assert matrix["c"]["a"] == 1 and matrix["c"]["c"] == 0


def test_user_rule_is_scored(spark):
    R.register("half")(lambda: F.lit(0.5))
    try:
        bars = random_bars(spark, (60,)).withColumn("proba", F.lit(0.9)).withColumn("signal", F.lit(1))
        more, legs = B.rule_layers({"half": B.Rule(R.RULES["half"]())})
        row = score(arrange(bars).roll(*B.market_layers(), *more), legs, "C").first()
        assert row["pct_exposure"] == 50.0
    finally:
        del R.RULES["half"]


def test_layout_refuses_nothing_and_numbers_from_zero(spark):
    panel = arrange(random_bars(spark, (50, 3)), rows=16)
    got = {(r["symbol"], r[POS]) for r in panel.df.select("symbol", POS).collect()}
    assert got == {("s0", i) for i in range(50)} | {("s1", i) for i in range(3)}
