"""Classifiers for direction and for the best strategy, and their evaluation.

Training frames should be tables (see ``session.cut``): a forest reads its input several times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ratio
from tidemark.operators import growing as G
from tidemark.operators.trees import Trees, add_votes, append_nodes, append_trees, is_trees, load_trees, predicted, probabilities, save_trees, write_about
from tidemark.session import cut, scratch_path, shared_dir

SELECTOR_FEATURES = ("rsi", "macd", "ret", "ret5", "ret10", "rvol", "vix", "high_vol", "trend_5_20", "trend_highvol")
DIRECTION_FEATURES = ("rsi", "macd", "rvol", "vix", "close", "trend_5_20", "high_vol", "ret", "ret5", "ret10", "trend_highvol")
SHORT_FEATURES = ("rsi", "macd", "rvol", "vix", "close")


@dataclass(frozen=True)
class Forest:
    """``depth`` beyond 10 makes a deep forest. It is grown ``batch`` trees at a time, each with about ``leaves`` leaves at most:
    a leaf has at least one in so many of the rows, so neither a batch nor the node table grows with the data."""

    trees: int = 100
    depth: int = 5
    seed: int = 42
    batch: int = 50
    leaves: int = 1000

    @property
    def deep(self) -> bool:
        return self.depth > 10


#: Rows times trees up to which the library trains. Its trainer keeps a count for each of them, and what does not fit in memory it writes
#: and reads again for every level; beyond, ``operators/growing.py`` does the same work in blocks.
LIBRARY_PAIRS = 20_000_000

# The sizes of the reported models. A model meant to grow without limit uses the greatest
# depth that the library has.
DIRECTION = Forest(100, 5)
SELECTOR = Forest(100, 30)
BEST_STRATEGY = Forest(200, 30)
DOMINANCE = Forest(150, 5)
NEXT_MONTH = Forest(300, 6)


def train(df: DataFrame, features: Sequence[str], label: str, forest: Forest) -> PipelineModel | Trees:
    """Fit a forest. Text labels are indexed by name; scores carry the names again. What is returned knows the feature
    list, so scoring needs only the columns. A deep forest becomes a table of nodes. Many rows (``LIBRARY_PAIRS``) are learnt from by
    the same rules, but with other random numbers than the library's."""
    if forest.deep:
        return grow(df, features, label, forest)
    assembler, rows, target, names = _prepared(df, features, label)
    if rows.count() * forest.trees > LIBRARY_PAIRS:
        model = G.as_model(df.sparkSession, _plan(rows, features, target, forest), target)
    else:
        model = _classifier(forest, target, forest.trees, forest.seed).fit(assembler.transform(rows))
    stages: list = [assembler, model]
    if names:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=names))
    return PipelineModel(stages)


def _prepared(df: DataFrame, features: Sequence[str], label: str):
    """(assembler, rows without nulls, label column, label names if they are texts)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    rows = df.dropna(subset=[*features, label])
    if not isinstance(df.schema[label].dataType, T.StringType):
        return assembler, rows, label, None
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    return assembler, indexer.transform(rows), "_label", indexer.labels


def _classifier(forest: Forest, target: str, trees: int, seed: int, leaf: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=target,
        numTrees=trees,
        maxDepth=forest.depth,
        seed=seed,
        minInstancesPerNode=leaf,
        # Deep trees: keep each row's node instead of walking the tree again, and split more
        # nodes per pass over the data.
        cacheNodeIds=forest.deep,
        checkpointInterval=10,
        maxMemoryInMB=512 if forest.deep else 256,
    )


def _plan(rows: DataFrame, features: Sequence[str], target: str, forest: Forest, leaf: int = 1) -> G.Plan:
    return G.prepare(rows, features, target, forest.trees, forest.depth, leaf, forest.seed)


def grow(df: DataFrame, features: Sequence[str], label: str, forest: Forest) -> Trees:
    """A forest as a table of nodes, trained and written ``forest.batch`` trees at a time: batch k has the seed
    ``forest.seed + k``, so the same batches are the same forest, however they are held. Many rows need no batches."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "trees")
    assembler, rows, target, names = _prepared(df, features, label)
    size = rows.count()
    leaf = max(1, size // forest.leaves)
    if size * forest.trees > LIBRARY_PAIRS:
        plan = _plan(rows, features, target, forest, leaf)
        append_nodes(G.grown(spark, plan), path, 0)
        return write_about(spark, Trees(path, tuple(features), tuple(names) if names else None, plan.classes, forest.trees))
    # Cached node ids are checkpointed there, which keeps the lineage of many deep trees short.
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows = assembler.transform(rows).select("features", F.col(target).alias("_target"))
    classes = 0
    for k, first in enumerate(range(0, forest.trees, forest.batch)):
        count = min(forest.batch, forest.trees - first)
        model = _classifier(forest, "_target", count, forest.seed + k, leaf).fit(rows)
        append_trees(spark, model, path, first)
        classes = model.numClasses
    return write_about(spark, Trees(path, tuple(features), tuple(names) if names else None, classes, forest.trees))


def node_table(spark: SparkSession, model: PipelineModel) -> Trees:
    """A trained pipeline's forest as a table of nodes."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    names = next((tuple(s.getLabels()) for s in model.stages if isinstance(s, IndexToString)), None)
    path = scratch_path(spark, "trees")
    append_trees(spark, forest, path, 0)
    return write_about(spark, Trees(path, tuple(assembler.getInputCols()), names, forest.numClasses, forest.getNumTrees))


def save_model(model: PipelineModel | Trees, path: str) -> None:
    if isinstance(model, Trees):
        save_trees(SparkSession.active(), model, path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Trees:
    spark = SparkSession.active()
    return load_trees(spark, path) if is_trees(spark, path) else PipelineModel.load(path)


def score_direction(df: DataFrame, model: PipelineModel | Trees, threshold: float = 0.3) -> DataFrame:
    """Adds ``proba`` of an up move and ``signal``; rows with unknown features are left out."""
    if isinstance(model, Trees):
        scored = add_votes(df, model).withColumn("proba", F.get(probabilities(F.col("votes")), F.lit(1))).drop("votes")
    else:
        scored = model.transform(df).withColumn("proba", F.get(vector_to_array("probability"), F.lit(1)))
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("signal", (F.col("proba") > threshold).cast("int"))


def predict_strategy(df: DataFrame, model: PipelineModel | Trees) -> DataFrame:
    """Adds the predicted ``strategy`` and the ``probability`` of the prediction."""
    if isinstance(model, Trees):
        scored = add_votes(df, model).withColumn("strategy", predicted(model))
        return scored.withColumn("probability", F.array_max(probabilities(F.col("votes")))).drop("votes")
    scored = model.transform(df).withColumn("_top", F.array_max(vector_to_array("probability")))
    scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumnsRenamed({"_top": "probability", "predicted": "strategy"})


def hashed_split(df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 42) -> Column:
    """True for about ``share`` of the rows, the same rows on every run and layout."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < int(10_000 * share)


def pooled_split(df: DataFrame, share: float = 0.8, order: str = "ts", gap: int = 0) -> Column:
    """1 for rows before the date that ends the first ``share`` of the distinct dates, else 0. All series are cut at one
    date, so nothing is learnt from the time that is scored. The last ``gap`` dates before the cut are null, for labels that
    look as far ahead. The dates are one array of calendar length."""
    dates = pooled_dates(df, share, order, gap)
    first_late = dates.select("first_late").scalar()
    if not gap:
        return (F.col(order) < first_late).cast("int")
    return F.when(F.col(order) < dates.select("first_gap").scalar(), 1).when(F.col(order) >= first_late, 0)


def pooled_dates(df: DataFrame, share: float = 0.8, order: str = "ts", gap: int = 0) -> DataFrame:
    """The one row of dates at which ``pooled_split`` cuts: ``first_late`` of the rest, ``first_gap`` of the gap before it."""
    dates = df.agg(F.array_sort(F.collect_set(order)).alias("d"))
    cut = F.floor(F.size("d") * share).cast("int")
    return dates.select(F.get("d", cut).alias("first_late"), F.get("d", F.greatest(cut - gap, F.lit(0))).alias("first_gap"))


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Features by importance. The list is as short as the feature list."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = [(n, float(v)) for n, v in zip(assembler.getInputCols(), forest.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---------------------------------------------------------------------- evaluation


def confusion_counts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    wide = df.groupBy(F.col(label).alias("actual")).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=[str(c) for c in classes])


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages. A
    ratio over nothing is 0. Everything after the first aggregation is as small as the classes."""
    pairs = confusion_counts(df, label, predicted)
    sides = F.expr(
        "inline(array(named_struct('class', CAST(actual AS STRING), 'support', n, 'chosen', 0L, 'hits', if(actual = predicted, n, 0L)), "
        "named_struct('class', CAST(predicted AS STRING), 'support', 0L, 'chosen', n, 'hits', 0L)))"
    )
    classes = pairs.select(sides).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])

    def part(of: str) -> Column:
        return F.coalesce(ratio(F.col("hits").cast("double"), F.col(of).cast("double")), F.lit(0.0))

    classes = classes.select("class", part("chosen").alias("precision"), part("support").alias("recall"), "support", "hits")
    # As many rows as classes; written, so that both parts below read them instead of the input.
    classes = cut(classes.withColumn("f1", _f1(F.col("precision"), F.col("recall"))), "report")
    rows = classes.selectExpr("sum(hits) / sum(support) AS a", "sum(support) AS n", *_averages("avg({})"), *_averages("sum({} * support) / sum(support)", "w"))
    summary = rows.selectExpr(
        "inline(array(named_struct('class', 'accuracy', 'precision', a, 'recall', a, 'f1', a, 'support', n), "
        "named_struct('class', 'macro avg', 'precision', m_precision, 'recall', m_recall, 'f1', m_f1, 'support', n), "
        "named_struct('class', 'weighted avg', 'precision', w_precision, 'recall', w_recall, 'f1', w_f1, 'support', n)))"
    )
    return classes.select("class", "precision", "recall", "f1", "support").unionByName(summary)


def _averages(form: str, prefix: str = "m") -> list[str]:
    return [f"{form.format(c)} AS {prefix}_{c}" for c in ("precision", "recall", "f1")]


def threshold_sweep(df: DataFrame, label: str, proba: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 of class 1 at each threshold (strictly above), in one pass."""
    up = F.col(label) == 1
    sums = [F.count_if(up).alias("positives")]
    for i, t in enumerate(thresholds):
        sums += [F.count_if(F.col(proba) > t).alias(f"c{i}"), F.count_if(up & (F.col(proba) > t)).alias(f"h{i}")]
    counted = df.agg(*sums)
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("chosen"), F.col(f"h{i}").alias("hits"), F.col("positives"))
        for i, t in enumerate(thresholds)
    ]
    swept = counted.select(F.inline(F.array(*rows)))

    def part(of: str) -> Column:
        return F.coalesce(ratio(F.col("hits").cast("double"), F.col(of).cast("double")), F.lit(0.0))

    swept = swept.select("threshold", part("chosen").alias("precision"), part("positives").alias("recall"))
    return swept.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
