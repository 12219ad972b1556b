"""Which strategy wins: labels for training and for switching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import rolling_growth, rolling_sum, shift
from tidemark.functions.scalars import flag, label
from tidemark.operators.panel import Panel, Rolling


def winner(columns: Sequence[str]) -> Column:
    """Name of the largest column; the first one listed wins a tie."""
    best = F.greatest(*[F.col(f"`{c}`") for c in columns])
    pick = F.when(F.col(f"`{columns[0]}`") == best, F.lit(columns[0]))
    for c in columns[1:]:
        pick = pick.when(F.col(f"`{c}`") == best, F.lit(c))
    return pick


def label_daily_winner(returns: DataFrame, columns: Sequence[str], name: str = "best_strategy") -> DataFrame:
    """Best return of the day, a missing return being 0."""
    return returns.fillna(0.0, subset=list(columns)).withColumn(name, winner(columns))


def label_rolling_winner(panel: Panel, first: str, second: str, n: int = 21, names: tuple[str, str] = ("MR", "ML")) -> Panel:
    """First name where its growth over ``n`` rows is larger, else the second (also in warm-up)."""
    panel = panel.roll({"_first": rolling_growth(first, n), "_second": rolling_growth(second, n)})
    df = panel.df.withColumn("best_strategy", label(F.col("_first") > F.col("_second"), *names))
    return panel.with_df(df.drop("_first", "_second"))


def dominance(panel: Panel, target: str, others: Sequence[str], n: int = 30, name: str = "dominates") -> Panel:
    """1 when the target's rolling sum of returns beats every other one, missing returns being 0."""
    sums = {f"_s{i}": rolling_sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), n) for i, c in enumerate([target, *others])}
    panel = panel.roll(sums)
    ahead = F.lit(True)
    for i in range(1, len(sums)):
        ahead = ahead & (F.col("_s0") > F.col(f"_s{i}"))
    return panel.with_df(panel.df.withColumn(name, flag(ahead)).drop(*sums))


def label_ahead(panel: Panel, column: str, k: int = 21, name: str = "next_label") -> Panel:
    """Label ``k`` rows later; the tail without one is cut off."""
    return panel.roll({name: shift(column, -k)}).where(F.col(name).isNotNull())


def label_direction(panel: Panel, close: str = "close", name: str = "target") -> Panel:
    """1 when the next bar closes higher; the last row, which has no next bar, is dropped."""
    panel = panel.roll({"next_ret": Rolling(lambda w: F.lead(close, 1).over(w) / F.col(close) - 1, ahead=1)})
    return panel.with_columns({name: flag(F.col("next_ret") > 0)}).where(F.col("next_ret").isNotNull())
