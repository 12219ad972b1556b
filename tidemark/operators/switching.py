"""Backtests that follow predicted strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import add_equity
from tidemark.functions.scalars import month_start
from tidemark.operators.panel import Panel


def pick(strategy: str, values: dict[str, Column]) -> Column:
    """Value of the strategy named in the row; null for an unknown name."""
    chosen = F.lit(None).cast("double")
    for name, value in values.items():
        chosen = F.when(F.col(strategy) == name, value).otherwise(chosen)
    return chosen


def dispatch_return(df: DataFrame, strategy: str, columns: Sequence[str], name: str = "predicted_return") -> DataFrame:
    """Return of the strategy named in the row; unknown or missing is 0."""
    values = {c: F.col(f"`{c}`") for c in columns}
    return df.withColumn(name, F.coalesce(pick(strategy, values), F.lit(0.0)))


def first_in_month(
    df: DataFrame, keys: Sequence[str], value: str, month_label: str = "start", ts: str = "ts"
) -> DataFrame:
    """First value of each month that is there at all. With ``month_label='end'`` the month carries
    its last day and stays only when that day is a session."""
    keys = list(keys)
    months = df.groupBy(*keys, month_start(F.col(ts)).alias("month")).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias(value),
        F.max(ts).alias("_last"),
    )
    months = months.where(F.col(value).isNotNull())
    if month_label == "start":
        return months.drop("_last")
    if month_label != "end":
        raise ValueError("month_label is 'start' or 'end'")
    # The last day of the month is a session exactly when it is the latest session of the month.
    at_end = months.where(F.col("_last") == F.last_day("month"))
    return at_end.select(*keys, F.col("_last").alias("month"), value)


def switch_monthly(
    predictions: DataFrame,
    returns: DataFrame,
    columns: Sequence[str],
    threshold: float = 0.6,
    keys: Sequence[str] = ("symbol",),
    start: float = 100.0,
) -> DataFrame:
    """Each month follow its first prediction above ``threshold`` for the whole month.

    ``predictions``: keys, ts, strategy, probability. ``returns``: keys, ts and one column per
    strategy. The month's growth of every strategy and the month's choice come from the same
    aggregation, so the chosen month needs no second join. The running product is over months,
    of which a series has as many as the calendar.
    """
    keys = list(keys)
    common = predictions.select(*keys, "ts", "strategy", "probability").join(returns, [*keys, "ts"])
    confident = F.when(F.col("probability") > threshold, F.col("ts"))
    growth = [
        F.product(1 + F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(f"_g{i}") for i, c in enumerate(columns)
    ]
    months = common.groupBy(*keys, month_start(F.col("ts")).alias("month")).agg(
        F.min_by("strategy", confident).alias("strategy"), *growth
    )
    chosen = pick("strategy", {c: F.col(f"_g{i}") for i, c in enumerate(columns)})
    months = months.withColumn("growth", chosen).where(F.col("growth").isNotNull())
    running = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    equity = start * F.product("growth").over(running)
    return months.select(*keys, "month", "strategy", equity.alias("equity"))


def switch_daily(panel: Panel, strategy: str, columns: dict[str, str]) -> Panel:
    """Growth of following each day's predicted strategy beside the strategies themselves.
    ``columns``: strategy name to the name of its curve."""
    df = dispatch_return(panel.df, strategy, list(columns))
    panel = add_equity(panel.with_df(df), {"predicted_curve": "predicted_return"}, fill=True)
    return add_equity(panel, {curve: f"`{c}`" for c, curve in columns.items()})
