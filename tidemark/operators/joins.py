"""Joins between bar-keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("symbol", "ts")


def join_on_ts(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return a.join(b, list(keys), "inner")


def join_complete(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Left join, then only rows without any null."""
    return a.join(b, list(keys), "left").dropna()


def common_dates(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys they share."""
    keys = list(keys)
    return a.join(b.select(*keys), keys, "left_semi"), b.join(a.select(*keys), keys, "left_semi")


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def offset_lookup(events: DataFrame, table: DataFrame, days: int, columns: Sequence[str]) -> DataFrame:
    """Rows exactly ``days`` calendar days before and after each event, as ``pre_*`` and ``post_*``;
    events that miss either one are left out. Two equi-joins, no range join."""

    def moved(prefix: str, by: int) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}_{c}") for c in columns]
        return table.select("symbol", F.date_add("ts", by).alias("ts"), *named)

    return events.join(moved("pre", days), list(KEY)).join(moved("post", -days), list(KEY))


def align_signal(rows: DataFrame, signals: DataFrame, columns: Sequence[str] = ("signal", "proba")) -> DataFrame:
    """Signals on all rows; a row without one gets 0."""
    joined = rows.join(signals.select(*KEY, *columns), list(KEY), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(joined.schema[c].dataType)) for c in columns})


def mapping_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "name string, label string")


def rename_strategies(long: DataFrame, mapping: Mapping[str, str], column: str = "strategy") -> DataFrame:
    """Display names to labels, a name without a label stays. The mapping is a short parameter."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return long.withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def unmapped(predictions: DataFrame, mapping: Mapping[str, str], column: str = "strategy") -> DataFrame:
    """Predicted names that the mapping does not know."""
    known = mapping_table(predictions.sparkSession, mapping).select(F.col("name").alias(column))
    return predictions.select(column).distinct().join(F.broadcast(known), column, "left_anti")


def unpivot_returns(wide: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One row per strategy instead of one column."""
    return wide.unpivot(list(keys), list(columns), "strategy", "ret")


def pivot_returns(long: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One column per strategy instead of one row."""
    return long.groupBy(*keys).pivot("strategy", list(columns)).agg(F.first("ret"))
