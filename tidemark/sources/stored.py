"""Panels and loads that are kept: bucketed, sorted bars that need no further shuffle, and loads that can be repeated."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.panel import POS, SEG, Panel
from tidemark.sources.bars import chunk_number, loaded_chunks
from tidemark.sources.tables import read_table

#: With this set, Spark trusts the order inside a bucket that is one file.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_LAYOUT = "tidemark.panel"


def store_panel(panel: Panel, name: str, path: str, buckets: int | None = None) -> Panel:
    """Write ``panel`` as the table ``name`` at ``path``, replacing one of that name, and open it.

    Rows are bucketed by the panel's window group and sorted by it and the order inside each bucket, so what is computed from the
    table starts without a shuffle and without a sort. A group is a series, or a segment of one where the calendar is long, and is
    bounded either way; a symbol with a third of all bars is then in many buckets. Every bucket is one file. ``buckets`` defaults to
    the number of shuffle partitions; choose it so that a bucket is a task's work. An empty panel gives an empty table.
    """
    spark = panel.df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = {"keys": list(panel.keys), "order": panel.order, "rows": panel.rows, "segments": panel.segments}
    df = panel.df.withColumn(POS, F.col(POS).alias(POS, metadata={_LAYOUT: layout}))
    # Buckets are hashed like shuffle partitions, so each task holds one bucket and writes one file.
    placed = df.repartition(buckets, *panel.group)
    writer = placed.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *panel.group).sortBy(*panel.group, panel.order).saveAsTable(name)
    return open_panel(spark, name)


def open_panel(spark: SparkSession, name: str) -> Panel:
    """The panel that ``store_panel`` wrote as ``name``, as ``arrange`` had laid it out.

    Sets the session's ``SORTED_BUCKETS``. Should the table have got more files in a bucket since, Spark sorts again; the rows
    are the same.
    """
    spark.conf.set(SORTED_BUCKETS, "true")
    df = spark.table(name)
    layout = df.schema[POS].metadata.get(_LAYOUT) if POS in df.columns else None
    if layout is None:
        raise ValueError(f"{name} is no stored panel")
    missing = [c for c in (*layout["keys"], layout["order"], *([SEG] if layout["segments"] > 1 else [])) if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has no columns {missing}")
    return Panel(df, tuple(layout["keys"]), layout["order"], layout["rows"], layout["segments"])


# ---------------------------------------------------------------------- loads that can be repeated


class ChunkTable:
    """Bars at ``path``, loaded in chunks of ``days`` from ``start``, in any order and as often as wanted.

    ``bars`` has one folder for each chunk; a load replaces the folders of its chunks and no other. ``loads`` names, for each chunk,
    the load that its bars must be from. It is emptied before the bars are written and filled after: a load that broke off
    leaves its chunks pending, and a chunk that comes back empty, or with too few rows, hides what an earlier load had left.
    Loads of different chunks may run at a time, loads of one chunk may not.
    """

    def __init__(
        self,
        path: str,
        schema: T.StructType,
        start: str,
        days: int = 60,
        min_rows: int = 5,
        atr_rows: int = 5,
        required: Sequence[str] = ("close", "high", "low"),
        grain: str = "hour",
    ):
        """``schema``: symbol, ts and the columns of the bars that are kept; ``atr`` comes with them."""
        self.path, self.columns, self.start, self.days = path, schema.names, start, days
        self.rules = {"min_rows": min_rows, "atr_rows": atr_rows, "required": tuple(required), "grain": grain}
        added = [T.StructField("atr", T.DoubleType()), T.StructField("load", T.StringType()), T.StructField("chunk", T.LongType())]
        self.bars, self.loads = T.StructType([*schema.fields, *added]), T.StructType(added[1:])

    def load(self, bars: DataFrame, chunks: Sequence[int]) -> None:
        """Load ``chunks`` from ``bars`` as ``ingest_chunks`` does; bars of other chunks are left alone, and the dates of the chunks
        reach the scan of ``bars``. A chunk named twice is loaded once, and one without bars counts as loaded."""
        chunks = sorted(set(map(int, chunks)))
        if not chunks:
            return
        spark, name = bars.sparkSession, uuid.uuid4().hex
        self._log(spark, chunks, None)
        first, after = (F.lit(self.begins(c)) for c in (chunks[0], chunks[-1] + 1))
        near = bars.where((F.col("ts") >= first) & (F.col("ts") < after)).select(*self.columns)
        mine = near.where(chunk_number(self.start, self.days).isin(chunks))
        full = loaded_chunks(mine, self.start, self.days, **self.rules)
        self._replace(full.withColumn("load", F.lit(name)).select(*self.bars.names), "bars")
        self._log(spark, chunks, name)

    def read(self, spark: SparkSession) -> DataFrame:
        """All loaded bars, with ``atr`` and ``chunk``. A time has one chunk, so no key comes twice."""
        self._make(spark)
        stored = read_table(spark, f"{self.path}/bars", self.bars, nan_as_null=False)
        # One row for each chunk of the calendar.
        named = F.broadcast(self._loaded(spark))
        return stored.join(named, ["chunk", "load"], "left_semi").drop("load")

    def pending(self, spark: SparkSession, until: str) -> list[int]:
        """The chunks that begin before ``until`` and are still to be loaded: none of the calendar is forgotten."""
        done = {row["chunk"] for row in self._loaded(spark).select("chunk").collect()}
        days = (dt.date.fromisoformat(until) - dt.date.fromisoformat(self.start)).days
        return [c for c in range(-(-days // self.days)) if c not in done]

    def mark(self, spark: SparkSession, until: str) -> dt.date:
        """The high-water mark: all chunks that begin before it (and before ``until``) are loaded."""
        return self.begins(min(self.pending(spark, until), default=-(-(dt.date.fromisoformat(until) - self.begins(0)).days // self.days)))

    def begins(self, chunk: int) -> dt.date:
        return dt.date.fromisoformat(self.start) + dt.timedelta(days=chunk * self.days)

    def _loaded(self, spark: SparkSession) -> DataFrame:
        self._make(spark)
        return read_table(spark, f"{self.path}/loads", self.loads).where("load IS NOT NULL")

    def _log(self, spark: SparkSession, chunks: list[int], load: str | None) -> None:
        self._replace(spark.createDataFrame([(load, c) for c in chunks], self.loads).coalesce(1), "loads")

    def _replace(self, df: DataFrame, part: str) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk")
        writer.parquet(f"{self.path}/{part}")

    def _make(self, spark: SparkSession) -> None:
        for part, schema in (("bars", self.bars), ("loads", self.loads)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("chunk").parquet(f"{self.path}/{part}")
