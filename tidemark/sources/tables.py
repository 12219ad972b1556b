"""Typed tables in and out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import to_null


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _D, _I, _DAY, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType(), T.TimestampType()

BARS = _schema(symbol=_S, ts=_DAY, open=_D, high=_D, low=_D, close=_D, volume=T.LongType())
INTRADAY_BARS = _schema(symbol=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=T.LongType())
CONTEXT = _schema(ts=_DAY, vix=_D)
SIGNALS = _schema(symbol=_S, ts=_DAY, signal=_I, proba=_D)
STRATEGY_RETURNS = _schema(symbol=_S, ts=_DAY, strategy=_S, ret=_D, position=_D)
LABELS = _schema(symbol=_S, ts=_DAY, best_strategy=_S)
PREDICTIONS = _schema(symbol=_S, ts=_DAY, strategy=_S, probability=_D)
PERIODS = _schema(period=_I, start=_DAY, end=_DAY)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", nan_as_null: bool = True
) -> DataFrame:
    """Read with a stated schema: no inference pass, dates parsed as asked. NaN becomes null,
    since Spark orders NaN above every number."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(path)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not (nan_as_null and doubles):
        return df
    return df.withColumns({c: to_null(F.col(f"`{c}`")) for c in doubles})


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def normalize_schema(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename vendor columns; other columns pass through."""
    return df.withColumnsRenamed(dict(mapping))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


def flat_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """A missing return means no position."""
    return df.fillna(0.0, subset=columns)
