"""Forests over many rows, a few trees to a task.

The library's trainer keeps a count for every row and tree and looks up each row's node anew, level by level. Here a row is
written once, a small number for each feature: its bin and its class. A task grows ``TOGETHER`` trees. For each level it
streams the blocks of that table and sums classes by node and bin, so it holds one block and the sums of at most ``CELLS``; the
rows' nodes and counts wait in a file of the task, two or three bytes for a row and tree. No row is left out, and no task needs
another one's sums.

The rules are the library's: Poisson counts of rows for each tree, as many features for a node as the root of all, 32 bins, Gini
impurity, a least number of rows in a leaf, and leaves under one node that predict the same are merged. Nodes are rows in the
library's own format, so they can be loaded as its model. The table of bins is read by the tasks themselves: the shared folder must
be one that pyarrow opens (a file system's or an object store's).
"""

from __future__ import annotations

import json
import math
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

BINS = 32
#: Rows of a block, few enough for a processor's cache.
BLOCK = 1 << 15
#: Quantiles that a task tells of a feature.
MARKS = 512
#: Trees that a task grows side by side.
TOGETHER = 3
#: Sums by class, bin, feature and node that a task holds of a tree; wider levels take several passes.
CELLS = 1 << 22
#: Blocks are looked at one at a time, so that the writer holds few of them.
_WRITTEN = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = pa.struct(
    [
        ("id", pa.int32()),
        ("prediction", pa.float64()),
        ("impurity", pa.float64()),
        ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()),
        ("gain", pa.float64()),
        ("leftChild", pa.int32()),
        ("rightChild", pa.int32()),
        ("split", _SPLIT),
    ]
)
_ROWS = pa.schema([("treeID", pa.int32()), ("nodeData", _NODE)])


@dataclass(frozen=True)
class Plan:
    """What every task of a forest knows. ``cuts``: by feature, the values at which bins end."""

    path: str
    cuts: tuple[tuple[float, ...], ...]
    classes: int
    rows: int
    trees: int
    depth: int
    leaf: int
    seed: int
    cells: int = CELLS

    @property
    def features(self) -> int:
        return len(self.cuts)

    @property
    def tried(self) -> int:
        """Features that a node may split on."""
        return self.features if self.trees == 1 else math.ceil(math.sqrt(self.features))

    @property
    def codes(self) -> np.dtype:
        return np.min_scalar_type(BINS * self.classes - 1)

    @property
    def places(self) -> np.dtype:
        """Numbers of the nodes of a level that may be split, and one for none: each has two leaves' rows, and a tree has about as
        many rows as the table."""
        return np.min_scalar_type(min(2**self.depth, 2 * self.rows // self.leaf) + 1)


# ---------------------------------------------------------------------- bins


def prepare(rows: DataFrame, features: Sequence[str], target: str, trees: int, depth: int, leaf: int, seed: int) -> Plan:
    """Write the table of bins. ``rows`` have no nulls; ``target`` counts classes from 0."""
    path = scratch_path(rows.sparkSession, "bins")
    values = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    narrow = rows.select(*values, F.col(target).cast("double").alias("target"))
    marks = narrow.mapInArrow(_marking, "n long, top double, marks array<array<double>>").toArrow()  # one short row for each task
    sizes = np.array(marks["n"].to_pylist())
    columns = [np.array(m) for m in zip(*marks["marks"].to_pylist())]
    cuts = tuple(_cuts(column, sizes) for column in columns)
    plan = Plan(path, cuts, int(max(marks["top"].to_pylist())) + 1, int(sizes.sum()), trees, depth, leaf, seed)
    narrow.mapInArrow(_binning(plan), "codes binary").write.options(**_WRITTEN).parquet(path)
    return plan


def _marked(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``MARKS`` values, the least and the greatest and between them the weighted quantiles."""
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weights[order])
    return values[order[np.searchsorted(share, np.linspace(0, share[-1], MARKS)).clip(0, len(values) - 1)]]


def _marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quantiles of a task's rows: of every ``8 * BLOCK`` rows, and now and then of those."""
    held, size, parts, top = [], 0, [], 0.0

    def reduced() -> None:
        table = np.concatenate(held)
        places = np.linspace(0, len(table) - 1, MARKS).round().astype(int)
        parts.append((len(table), [np.sort(column)[places] for column in table.T]))

    def merged() -> None:
        n = np.array([p[0] for p in parts])
        columns = [_marked(np.concatenate(c), np.repeat(n / MARKS, MARKS)) for c in zip(*[p[1] for p in parts])]
        parts[:] = [(int(n.sum()), columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        *columns, target = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held.append(np.column_stack(columns))
        size, top = size + batch.num_rows, max(top, target.max())
        if size >= 8 * BLOCK:
            reduced()
            held, size = [], 0
            if len(parts) >= 64:
                merged()
    if size:
        reduced()
    if parts:
        merged()
        yield pa.RecordBatch.from_pydict({"n": [parts[0][0]], "top": [float(top)], "marks": [[c.tolist() for c in parts[0][1]]]})


def _cuts(marks: np.ndarray, sizes: np.ndarray) -> tuple[float, ...]:
    """Where a feature's bins end, of the marks of all tasks. The least value ends a bin, so a rare one can be told from the rest."""
    values, weights = marks.ravel(), np.repeat(sizes / MARKS, MARKS)
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weights[order])
    probes = np.searchsorted(share, share[-1] * np.arange(1, BINS - 1) / (BINS - 1)).clip(0, len(order) - 1)
    found = {float(values.min()), *values[order[probes]].tolist()}
    return tuple(sorted(c for c in found if c < values.max()))


def _binning(plan: Plan):
    edges = [np.array(c) for c in plan.cuts]

    def coded(batch: pa.RecordBatch) -> np.ndarray:
        own = np.empty((batch.num_rows, len(edges)), plan.codes)
        target = batch.column(len(edges)).to_numpy(zero_copy_only=False)
        for i, edge in enumerate(edges):
            own[:, i] = np.searchsorted(edge, batch.column(i).to_numpy(zero_copy_only=False)) * plan.classes + target
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(coded(batch))
            size += batch.num_rows
            while size >= BLOCK:
                whole = np.concatenate(held)
                yield pa.RecordBatch.from_pydict({"codes": pa.array([whole[:BLOCK].tobytes()], pa.binary())})
                held, size = [whole[BLOCK:]], size - BLOCK
        if size:
            yield pa.RecordBatch.from_pydict({"codes": pa.array([np.concatenate(held).tobytes()], pa.binary())})

    return run


def _blocks(plan: Plan) -> Iterator[np.ndarray]:
    """The codes of one block after another, row by row."""
    system, folder = pa.fs.FileSystem.from_uri(plan.path)
    names = sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    for name in names:
        with system.open_input_file(name) as file:
            table = pq.ParquetFile(file)
            for group in range(table.num_row_groups):
                for chunk in table.read_row_group(group, use_threads=False).column("codes").chunks:
                    for i in range(len(chunk)):
                        yield np.frombuffer(chunk[i].as_buffer(), plan.codes)


# ---------------------------------------------------------------------- trees


def _bag_sizes() -> np.ndarray:
    """How often a row is in a tree, by a number of 16 bits: Poisson with mean 1."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(shares, (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


_BAG = _bag_sizes()


class Tree:
    """A tree that grows: its nodes so far, and those of its last level that may be split (its places)."""

    def __init__(self, number: int, plan: Plan):
        self.number, self.plan = number, plan
        self.random = np.random.default_rng([plan.seed, number])
        self.feature, self.cut, self.gain, self.left, self.right = [-1], [0], [-1.0], [-1], [-1]
        self.counts: list[np.ndarray] = [np.zeros(plan.classes)]
        self.open = [0]
        # How rows of the last level's places go on.
        self.by, self.limit, self.child = None, None, None
        self.choose()

    def choose(self) -> None:
        """The features that each place tries, and room for its sums."""
        n, some = len(self.open), self.plan.tried
        everything = np.tile(np.arange(self.plan.features), (n, 1))
        tried = self.random.permuted(everything, axis=1)[:, :some] if some < self.plan.features else everything
        self.tried = np.ascontiguousarray(tried.T)

    def bag(self, block: int, rows: int) -> np.ndarray:
        if self.plan.trees == 1:
            return np.ones(rows, np.uint8)
        return _BAG.take(np.random.default_rng([self.plan.seed, self.number, block]).integers(0, 65536, rows, np.uint16))

    def onward(self, codes: np.ndarray, base: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Each row's place on the next level, -1 in a leaf."""
        code = codes.take(base + self.by.take(places))
        return self.child.take(2 * places + (code > self.limit.take(places)))

    def add(self, sums: np.ndarray, codes: np.ndarray, base: np.ndarray, places: np.ndarray, weights: np.ndarray, low: int) -> None:
        """Add the rows to ``sums`` (feature, place from ``low`` on, bin and class)."""
        wide = BINS * self.plan.classes
        start = (places - low) * wide
        for own, tried in zip(sums, self.tried):
            np.add.at(own, start + codes.take(base + tried.take(places)), weights)

    def split(self, sums: np.ndarray, low: int, high: int, level: int) -> None:
        """Split the places from ``low`` to ``high`` where that gains most; ``finish`` ends the level."""
        plan, n = self.plan, high - low
        sums = sums.reshape(plan.tried, n, BINS, plan.classes).swapaxes(0, 1)
        total = sums[:, 0].sum(axis=1)
        left = sums.cumsum(axis=2)[:, :, :-1]
        right = total[:, None, None] - left
        rows = np.maximum(total.sum(axis=1), 1)
        lefts, rights = left.sum(axis=3), right.sum(axis=3)
        within = lambda x, size: 1 - (x * x).sum(axis=-1) / np.maximum(size, 1) ** 2
        inner = (lefts * within(left, lefts) + rights * within(right, rights)) / rows[:, None, None]
        gains = np.where((lefts >= plan.leaf) & (rights >= plan.leaf), within(total, rows)[:, None, None] - inner, -1.0)
        best = gains.reshape(n, -1).argmax(axis=1)
        which, at = np.divmod(best, BINS - 1)
        gain = gains.reshape(n, -1)[np.arange(n), best]
        for i in range(n):
            node = self.open[low + i]
            self.counts[node] = total[i]
            if gain[i] <= 0:
                continue
            feature, cut = int(self.tried[which[i], low + i]), int(at[i])
            self.feature[node], self.cut[node], self.gain[node] = feature, cut, float(gain[i])
            self.next_by[low + i], self.next_limit[low + i] = feature, (cut + 1) * plan.classes - 1
            for side, counts in enumerate((left[i, which[i], cut], right[i, which[i], cut])):
                child = len(self.feature)
                self.feature.append(-1), self.cut.append(0), self.gain.append(-1.0), self.left.append(-1), self.right.append(-1)
                self.counts.append(counts.copy())
                (self.right if side else self.left)[node] = child
                if level + 1 < plan.depth and counts.sum() >= 2 * plan.leaf and np.count_nonzero(counts) > 1:
                    self.next_child[2 * (low + i) + side] = len(self.next_open)
                    self.next_open.append(child)

    def begin(self) -> None:
        n = len(self.open)
        self.next_by, self.next_limit = np.zeros(n, np.intp), np.zeros(n, self.plan.codes)
        self.next_child, self.next_open = np.full(2 * n, -1, np.intp), []

    def finish(self) -> None:
        self.by, self.limit, self.child, self.open = self.next_by, self.next_limit, self.next_child, self.next_open
        self.choose()

    def rows(self) -> list[dict]:
        """The nodes in the library's format and order, leaves that agree merged."""
        leaf = [f < 0 for f in self.feature]
        says = [int(c.argmax()) for c in self.counts]
        for i in reversed(range(len(leaf))):  # children come after their parents
            if not leaf[i]:
                a, b = self.left[i], self.right[i]
                leaf[i] = leaf[a] and leaf[b] and says[a] == says[b]
        order, stack = {}, [0]
        while stack:
            node = stack.pop()
            order[node] = len(order)
            if not leaf[node]:
                stack += [self.right[node], self.left[node]]
        out = []
        for node, number in order.items():
            counts, inner = self.counts[node], not leaf[node]
            size = counts.sum()
            cut = [self.plan.cuts[self.feature[node]][self.cut[node]]] if inner else []
            out.append(
                {
                    "id": number,
                    "prediction": float(says[node]),
                    "impurity": float(1 - (counts * counts).sum() / max(size, 1) ** 2),
                    "impurityStats": counts.tolist(),
                    "rawCount": int(size),
                    "gain": self.gain[node] if inner else -1.0,
                    "leftChild": order[self.left[node]] if inner else -1,
                    "rightChild": order[self.right[node]] if inner else -1,
                    "split": {"featureIndex": self.feature[node] if inner else -1, "leftCategoriesOrThreshold": cut, "numCategories": -1},
                }
            )
        return out


def grow_trees(plan: Plan, numbers: Sequence[int]) -> list[Tree]:
    """Trees of these numbers, level by level over all blocks."""
    trees = [Tree(number, plan) for number in numbers]
    kind, wide = plan.places, BINS * plan.classes
    none = np.iinfo(kind).max
    most = max(1, plan.cells // (plan.tried * wide))
    with tempfile.TemporaryFile() as state:
        for level in range(plan.depth):
            for tree in trees:
                tree.begin()
            for low in range(0, max(len(t.open) for t in trees), most):
                _pass(plan, trees, state, level, low, most, kind, none)
            for tree in trees:
                tree.finish()
            if not any(t.open for t in trees):
                break
    return trees


def _pass(plan: Plan, trees: Sequence[Tree], state, level: int, low: int, most: int, kind: np.dtype, none: int) -> None:
    """One pass over the blocks: rows move to their places of this level if that was not done, and those at the places from ``low`` on
    are summed."""
    wide = BINS * plan.classes
    ranges = [(tree, min(len(tree.open), low + most)) for tree in trees]
    sums = [np.zeros((plan.tried, max(high - low, 0) * wide)) for _, high in ranges]
    state.seek(0)
    for number, codes in enumerate(_blocks(plan)):
        n = len(codes) // plan.features
        for (tree, high), own in zip(ranges, sums):
            at = state.tell()
            if level == 0 and low == 0:
                counts = tree.bag(number, n)
                state.write(np.where(counts > 0, 0, none).astype(kind).tobytes())
                state.write(counts.tobytes())
            if low >= high:  # none of this tree
                state.seek(at + n * (kind.itemsize + 1))
                continue
            if level or low:
                places = np.frombuffer(state.read(n * kind.itemsize), kind)
                counts = np.frombuffer(state.read(n), np.uint8)
            else:
                places = np.where(counts > 0, 0, none).astype(kind)
            rows = np.flatnonzero(places != none)
            places = places.take(rows).astype(np.intp)
            base = rows * plan.features
            if level and not low:
                places = tree.onward(codes, base, places)
                if (places < 0).any():
                    kept = np.flatnonzero(places >= 0)
                    rows, places, base = rows.take(kept), places.take(kept), base.take(kept)
                moved = np.full(n, none, kind)
                moved[rows] = places
                state.seek(at)
                state.write(moved.tobytes())
            if low or high < len(tree.open):
                within = (places >= low) & (places < high)
                rows, places, base = rows[within], places[within], base[within]
            if len(rows):
                tree.add(own, codes, base, places, counts.take(rows).astype(float), low)
            state.seek(at + n * (kind.itemsize + 1))
    for (tree, high), own in zip(ranges, sums):
        if low < high:
            tree.split(own, low, high, level)


def _growing(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in grow_trees(plan, batch.column(0).to_pylist()):
                rows = [{"treeID": tree.number, "nodeData": node} for node in tree.rows()]
                yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return run


def grown(spark: SparkSession, plan: Plan) -> DataFrame:
    """The nodes of all trees, ``TOGETHER`` trees to a task, in the library's format."""
    return spark.range(0, plan.trees, 1, -(-plan.trees // TOGETHER)).mapInArrow(_growing(plan), NODES)


def as_model(spark: SparkSession, plan: Plan, target: str) -> RandomForestClassificationModel:
    """The forest as the library's model: its files are written and loaded."""
    path, now = scratch_path(spark, "forest"), int(time.time() * 1000)
    about = {"timestamp": now, "sparkVersion": spark.version, "defaultParamMap": {}}
    params = {"featuresCol": "features", "labelCol": target, "impurity": "gini", "maxDepth": plan.depth, "minInstancesPerNode": plan.leaf, "seed": plan.seed}
    name = "org.apache.spark.ml.classification.{}ClassificationModel"

    def described(kind: str, **more) -> str:
        return json.dumps({"class": name.format(kind), "uid": f"{kind}_{uuid.uuid4().hex[:12]}", **about, **more})

    grown(spark, plan).write.parquet(f"{path}/data")
    each = [(tree, described("DecisionTree", paramMap=params), 1.0) for tree in range(plan.trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = described("RandomForest", paramMap={**params, "numTrees": plan.trees}, numFeatures=plan.features, numClasses=plan.classes, numTrees=plan.trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
