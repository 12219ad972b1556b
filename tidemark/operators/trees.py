"""Forests as rows: a table of nodes that is grown in batches of trees and scored a bounded part at a time.

A forest of many deep trees does not fit one driver or one task. Here the driver holds the trees of one batch while they are
trained; then they are rows (tree, node, feature, threshold, left, right, votes) in the shared folder. Scoring adds up votes in a
column, a broadcast of at most ``MAX_NODES`` nodes at a time, on tables and on streams alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Nodes that are broadcast together, about 50 bytes each and 8 for every class.
MAX_NODES = 500_000
#: Rows whose ways through the trees a task follows together.
ROWS = 2048

ABOUT = "features array<string>, names array<string>, classes int, trees int"


@dataclass(frozen=True)
class Trees:
    """Where the node table of a forest is, and what its columns mean. ``names`` are the labels' texts, if they are texts."""

    path: str
    features: tuple[str, ...]
    names: tuple[str, ...] | None
    classes: int
    trees: int

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/nodes")


def append_trees(spark: SparkSession, model: RandomForestClassificationModel, path: str, first: int) -> None:
    """Write a trained model's nodes to the table of ``path``, its trees numbered from ``first`` on."""
    saved = scratch_path(spark, "forest")
    model.write().save(saved)
    append_nodes(spark.read.parquet(f"{saved}/data"), path, first)


def append_nodes(data: DataFrame, path: str, first: int) -> None:
    """The same for nodes in the format in which the library saves them."""
    data = data.select("treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    leaf = F.col("leftChild") < 0
    votes = F.when(total > 0, F.transform("impurityStats", lambda x: x / total)).otherwise(F.transform("impurityStats", lambda x: F.lit(0.0)))
    rows = data.select(
        (F.col("treeID") + first).alias("tree"),
        F.col("id").alias("node"),
        F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(leaf, votes).alias("votes"),
    )
    # A batch has a folder of its own, so one that is written again replaces itself.
    rows.write.mode("overwrite").parquet(f"{path}/nodes/batch={first}")


def write_about(spark: SparkSession, trees: Trees) -> Trees:
    row = (list(trees.features), list(trees.names) if trees.names else None, trees.classes, trees.trees)
    spark.createDataFrame([row], ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{trees.path}/about")
    return trees


def load_trees(spark: SparkSession, path: str) -> Trees:
    row = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    return Trees(path, tuple(row["features"]), tuple(row["names"]) if row["names"] else None, row["classes"], row["trees"])


def is_trees(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def save_trees(spark: SparkSession, trees: Trees, path: str) -> Trees:
    trees.nodes(spark).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/nodes")
    return write_about(spark, Trees(path, trees.features, trees.names, trees.classes, trees.trees))


# ---------------------------------------------------------------------- scoring


@dataclass
class Part:
    """Some trees of a forest in arrays; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    #: By node, where a row goes that is not below the threshold, and where one that is.
    child: np.ndarray
    inner: np.ndarray
    votes: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, classes: int) -> Part:
        table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree = table["tree"].to_numpy()
        roots = np.flatnonzero(np.diff(tree, prepend=-1))
        base = np.repeat(roots, np.diff(roots, append=len(tree)))
        own = np.arange(len(tree))
        inner = np.asarray(table["feature"].is_valid())
        number = lambda name, kind: table[name].fill_null(0).to_numpy().astype(kind)
        votes = np.zeros((len(tree), classes))
        leaves = table["votes"].combine_chunks().filter(pa.array(~inner))
        votes[~inner] = leaves.flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
        child = np.empty((len(tree), 2), np.intp)
        child[:, 0] = np.where(inner, base + number("right", np.int64), own)
        child[:, 1] = np.where(inner, base + number("left", np.int64), own)
        return cls(roots, number("feature", np.intp), number("threshold", np.float64), child.ravel(), inner, votes)

    def add(self, rows: np.ndarray, votes: np.ndarray) -> None:
        """Add every tree's votes, one tree after another, as the library does."""
        values, wide = np.ascontiguousarray(rows).ravel(), rows.shape[1]
        ends = np.empty((len(self.roots), len(rows)), np.intp)
        flat = ends.ravel()
        # Rows by trees that are not in a leaf yet: where they are, where their values begin, and whose they are.
        at = np.repeat(self.roots, len(rows))
        start = np.tile(np.arange(len(rows)) * wide, len(self.roots))
        whose = np.arange(len(at))
        while True:
            on = self.inner.take(at)
            if 4 * np.count_nonzero(on) < 3 * len(at):
                done = ~on
                flat[whose[done]] = at[done]
                at, start, whose = at[on], start[on], whose[on]
            if not len(at):
                break
            at = self.child.take(2 * at + (values.take(start + self.feature.take(at)) <= self.threshold.take(at)))
        for tree in ends:
            votes += self.votes.take(tree, axis=0)


def rounds(spark: SparkSession, trees: Trees, max_nodes: int) -> list[tuple[int, int]]:
    """Ranges of trees that have at most ``max_nodes`` nodes together, or are a single tree."""
    sizes = sorted(map(tuple, trees.nodes(spark).groupBy("tree").count().collect()))  # as many rows as trees
    out: list[list[int]] = []
    size = 0
    for tree, nodes in sizes:
        if not out or size + nodes > max_nodes:
            out.append([tree, tree])
            size = 0
        out[-1][1], size = tree, size + nodes
    return [(low, high) for low, high in out]


def add_votes(df: DataFrame, trees: Trees, max_nodes: int = MAX_NODES) -> DataFrame:
    """``df`` with ``votes``, the sum over all trees by class; rows with unknown features are left out. ``df`` may be a stream."""
    spark = df.sparkSession
    scored = df.dropna(subset=list(trees.features)).withColumn("votes", F.array(*[F.lit(0.0)] * trees.classes))
    names, schema, features = scored.columns, scored.schema, list(trees.features)
    for low, high in rounds(spark, trees, max_nodes):
        table = trees.nodes(spark).where(F.col("tree").between(low, high)).drop("batch").toArrow()
        part = spark.sparkContext.broadcast(Part.of(table, trees.classes))
        scored = scored.mapInArrow(_voting(part, names, features, trees.classes), schema)
    return scored


def _voting(part, names: Sequence[str], features: Sequence[str], classes: int):
    at = [names.index(f) for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                values = np.column_stack([rows.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at])
                votes = rows.column(len(names) - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes).copy()
                part.value.add(values, votes)
                column = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, classes, dtype=np.int32), pa.array(votes.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], column.cast(rows.schema.field(len(names) - 1).type)], names=list(names))

    return run


def probabilities(votes: Column) -> Column:
    total = F.aggregate(votes, F.lit(0.0), lambda s, x: s + x)
    return F.transform(votes, lambda x: x / total)


def predicted(trees: Trees) -> Column:
    """The class with the most votes, the first of several, by name if classes have names."""
    place = F.array_position("votes", F.array_max("votes")).cast("int")
    if trees.names:
        return F.element_at(F.array(*map(F.lit, trees.names)), place)
    return (place - 1).cast("double")

