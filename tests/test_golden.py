"""Small vectors computed by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators.analysis import frequency, monthly_mode
from tidemark.operators.backtest import best_parameter
from tidemark.operators.holding import hold_positions
from tidemark.operators.panel import POS, arrange
from tidemark.operators.scoring import Leg, monthly_metrics, present, score
from tidemark.operators.switching import first_in_month, switch_monthly

DAY = dt.date(2024, 1, 1)


def series(spark, name, values, kind="double"):
    rows = [("x", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return arrange(spark.createDataFrame(rows, f"symbol string, ts date, {name} {kind}"))


def column(panel, name):
    return [r[0] for r in panel.df.orderBy(POS).select(name).collect()]


def close_to(got, expected, tol=1e-9):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (g is None and e is None) or math.isclose(g, e, abs_tol=tol), (got, expected)


def test_ema(spark):
    panel = series(spark, "close", [1.0, 2.0, 4.0, 5.0, 6.0])
    close_to(column(I.add_ema(panel, {"e": ("close", 3)}), "e"), [1, 1.5, 2.75, 3.875, 4.9375])
    close_to(column(I.add_weighted_ema(panel, "e", "close", 3), "e"), [1, 1.6666666667, 3, 4.0666666667, 5.0645161290])


def test_rsi(spark):
    panel = series(spark, "close", [10.0, 11.0, 10.5, 10.5, 12.0, 11.0])
    expected = [None, None, 57.1428571429, 57.1428571429, 88.9908256881, 51.0526315789]
    close_to(column(I.add_rsi(panel, 3), "rsi"), expected)


def test_quantile(spark):
    panel = series(spark, "x", [1.0, 2.0, 4.0, 5.0, 6.0]).totals({"q": F.percentile("x", 0.7)})
    assert math.isclose(column(panel, "q")[0], 4.8)


def test_hold(spark):
    signal = [0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0]
    expected = [0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1]
    panel = hold_positions(series(spark, "s", signal, "int"), {"on": F.col("s") == 1}, 5)
    assert column(panel, "on") == expected


RETURNS = [None, 0.10, -0.20, 0.05, 0.0, 0.10]
FAMILIES = {
    "A": (6, 0.9802296909, 1.9763602910),
    "A0": (6, 0.9802296909, 1.7688979620),
    "B": (5, 1.2701715746, 1.9763602910),
    "C": (4, 1.7865917810, 2.0874625746),
}


@pytest.mark.parametrize("family", FAMILIES)
def test_families(spark, family):
    row = score(series(spark, "r", RETURNS), [Leg("x", "r")], family).first()
    n, ann, vol = FAMILIES[family]
    assert row["n_obs"] == n
    close_to([row["ann_return"], row["ann_vol"], row["final_value"], row["max_drawdown"]], [ann, vol, 101.64, 0.22])


def test_drawdown(spark):
    panel = I.add_equity(series(spark, "r", RETURNS), {"eq": "r"})
    for relative, worst in ((False, 0.22), (True, 0.20)):
        made = I.add_drawdown(panel, "eq", "dd", relative)
        assert math.isclose(max(x for x in column(made, "dd") if x is not None), worst)
        assert column(made, "dd")[0] is None


def test_no_volatility_means_no_sharpe(spark):
    flat = series(spark, "r", [None, 0.0, 0.0, 0.0])
    assert score(flat, [Leg("x", "r")], "A").first()["sharpe"] == 0.0
    assert present(score(flat, [Leg("x", "r")], "A")).first()["final_value"] == 100.0


def test_monthly_metrics(spark):
    rows = [("x", dt.date(2024, m, 1), e) for m, e in ((1, 100.0), (2, 110.0), (3, 99.0), (4, 120.0))]
    row = monthly_metrics(spark.createDataFrame(rows, "symbol string, month date, equity double"), ["symbol"]).first()
    changes = [0.1, -0.1, 120 / 99 - 1]
    mean = sum(changes) / 3
    vol = math.sqrt(sum((c - mean) ** 2 for c in changes) / 2) * math.sqrt(12)
    close_to([row["ann_return"], row["ann_vol"], row["max_drawdown"]], [1.2 ** (12 / 4) - 1, vol, 0.1])
    one = monthly_metrics(spark.createDataFrame(rows[:1], "symbol string, month date, equity double"), ["symbol"]).first()
    assert one["sharpe"] is None and one["n_obs"] == 1


def test_switching_skips_unknown_names_and_doubtful_months(spark):
    days = [dt.date(2024, m, d) for m in (1, 2, 3) for d in (2, 3)]
    predicted = spark.createDataFrame(
        [("x", days[0], "a", 0.5), ("x", days[1], "b", 0.9), ("x", days[2], "z", 0.9), ("x", days[3], "a", 0.9),
         ("x", days[4], "a", 0.6), ("x", days[5], "b", 0.61)],
        "symbol string, ts date, strategy string, probability double",
    )
    returns = spark.createDataFrame([("x", d, 0.1, 0.2 if i else None) for i, d in enumerate(days)], "symbol string, ts date, a double, b double")
    got = {r["month"].month: (r["strategy"], round(r["equity"], 9)) for r in switch_monthly(predicted, returns, ["a", "b"]).collect()}
    assert got == {1: ("b", 120.0), 3: ("b", 172.8)}


def test_month_end_must_be_a_session(spark):
    rows = [("x", dt.date(2024, 1, 3), "a"), ("x", dt.date(2024, 1, 31), "b"), ("x", dt.date(2024, 2, 1), "c"), ("x", dt.date(2024, 2, 28), "d")]
    df = spark.createDataFrame(rows, "symbol string, ts date, s string")
    assert [tuple(r) for r in first_in_month(df, ["symbol"], "s", "end").collect()] == [("x", dt.date(2024, 1, 31), "a")]
    assert first_in_month(df, ["symbol"], "s").count() == 2


def test_mode_ties_go_to_the_first_seen(spark):
    rows = [("x", dt.date(2024, 1, d), s) for d, s in ((1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c"))]
    df = spark.createDataFrame(rows, "symbol string, ts date, s string")
    assert monthly_mode(df, "s").first()["s"] == "b"
    assert sum(r["percent"] for r in frequency(df, "s").collect()) == 100.0


def test_best_parameter_prefers_the_smaller_on_a_tie(spark):
    df = spark.createDataFrame([("x", 0.2, 1.0), ("x", 0.1, 1.0), ("x", 0.3, None)], "symbol string, k double, sharpe double")
    assert best_parameter(df, ["symbol"], "k").first()["k"] == 0.1


def test_monthly_metrics_of_an_eleven_month_curve(spark):
    equity = [100.0, 102.630783, 100.882689, 102.595710, 104.520574, 102.005808, 103.742347, 101.304918, 100.179878, 101.159543, 102.947275]
    rows = [("a", dt.date(2024, 1 + i, 1), x) for i, x in enumerate(equity)]
    row = monthly_metrics(spark.createDataFrame(rows, "symbol string, month date, equity double"), ["symbol"]).first()
    assert row["ann_return"] == pytest.approx(0.0322, abs=5e-5) and row["ann_vol"] == pytest.approx(0.0681, abs=5e-5)
    assert row["sharpe"] == pytest.approx(0.473, abs=5e-4) and row["max_drawdown"] == pytest.approx(0.0415, abs=5e-5)
