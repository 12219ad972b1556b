"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of each sees the document's words and the probabilities of the
categories before it; while training, those are out-of-fold predictions, so a later model learns from probabilities as
they will be on new documents. Words are chosen by a significance test on the labelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, texts
from tidemark.llm.tokens import release

#: The bound on labelled rows that are learnt from.
SAMPLE = 20_000
#: Words that the models see, and the chi-square value of one degree of freedom that a word needs. At 33, one in 10^8
#: unrelated words passes.
FEATURES = 256
CHI_SQUARE = 33.0
FOLDS = 3
RIDGE = 1.0
ROWS = 256

_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; the intercept is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - shrink * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(bend, slope)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def design(found: list[np.ndarray], width: int, before: np.ndarray) -> np.ndarray:
    """Which words each document has, then the probabilities of the categories before."""
    x = np.zeros((len(found), width + before.shape[1]))
    for row, places in enumerate(found):
        x[row, places] = 1
    x[:, width:] = before
    return x


@dataclass
class Chain:
    """The words in their order, and for each category its weights: words, earlier categories, intercept."""

    words: list[str]
    categories: list[str]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.places = {w: i for i, w in enumerate(self.words)}

    def probabilities(self, batch: list[str]) -> np.ndarray:
        found = [np.array(sorted(self.places[w] for w in word_set(t) & self.places.keys()), dtype=np.int64) for t in batch]
        before = np.zeros((len(batch), 0))
        for w in self.weights:
            p = sigmoid(design(found, len(self.words), before) @ w[:-1] + w[-1])
            before = np.column_stack([before, p])
        return before


def choose_words(sample: DataFrame, count: int = FEATURES, least: float = CHI_SQUARE) -> list[str]:
    """The words whose presence goes with a category beyond chance, most telling first."""
    categories = [c for c in sample.columns if c.startswith("y_")]
    total = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    each = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"), *categories)
    counts = each.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories))

    def chi_square(c: str) -> Column:
        n, positive = F.lit(float(total["n"])), F.lit(float(total[c] or 0))
        a, b = F.col(c).cast("double"), (F.col("n") - F.col(c)).cast("double")
        cross = a * (n - positive - b) - b * (positive - a)
        below = (a + b) * (n - a - b) * positive * (n - positive)
        return F.when(below > 0, n * cross * cross / below).otherwise(0.0)

    best = F.greatest(*map(chi_square, categories)) if len(categories) > 1 else chi_square(categories[0])
    rows = counts.where("n >= 3").select("word", best.alias("value")).where(F.col("value") >= least)
    return [r["word"] for r in rows.orderBy(F.desc("value"), "word").limit(count).collect()]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit the chain. ``categories`` maps names, in the order of the chain, to SQL conditions on ``labels``.

    At most ``sample`` labelled rows are used, those with the smallest hash of their id; rows with a null label in a
    condition or a null id are left out, of labels that repeat an id one is used. Where no word tells a category from
    chance (few labels, none, or labels of one kind) nothing can be said of a text, and every probability is near 0.
    """
    names = list(categories)
    marks = {f"y_{i}": F.expr(f"cast(({sql}) as int)") for i, sql in enumerate(categories.values())}
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in marks.items())).dropna()
    once = marked.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in marks))
    scratch = Scratch(docs.sparkSession)
    chosen = scratch(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxicity-labels")
    # At most ``sample`` rows of numbers.
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = scratch(labelled, "toxicity-sample")
    words = choose_words(rows)
    if not words:
        scratch.clear()
        return Chain([], names, [np.full(1 + i, 0.0) - np.eye(1 + i)[-1] * 9 for i in range(len(names))])
    places = {w: i for i, w in enumerate(words)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [sorted(places[w] for w in word_set(t) & places.keys()) for t in batch.column(1).to_pylist()]
            yield batch.set_column(1, "found", pa.array(found, pa.list_(pa.int32())))

    y = ", ".join(f"{c} int" for c in marks)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds)).cast("int")
    learnt = rows.select("doc_id", "text", *marks).mapInArrow(present, f"doc_id long, found array<int>, {y}")
    table = scratch(learnt.withColumn("fold", fold).withColumn("p", F.array().cast("array<double>")), "toxicity-rows")

    def fit_category(index: int):
        def fit(held: pd.DataFrame) -> pd.DataFrame:
            """One model: without its own fold, which it predicts, or (the last) on all rows."""
            held = held.sort_values("doc_id")
            number, other = int(held["held"].iloc[0]), (held["fold"] != held["held"]).to_numpy()
            before = np.array(held["p"].tolist(), dtype=float).reshape(len(held), index)
            x = design([np.asarray(f, dtype=np.int64) for f in held["found"]], len(words), before)
            w = logistic(x[other], held[f"y_{index}"].to_numpy(float)[other])
            if number == folds:
                return pd.DataFrame({"doc_id": [-1], "held": [number], "values": [w.tolist()]})
            p = sigmoid(x[~other] @ w[:-1] + w[-1])
            values = pd.Series([[v] for v in p], dtype=object)
            return pd.DataFrame({"doc_id": held["doc_id"].to_numpy()[~other], "held": number, "values": values})

        return fit

    weights = []
    for index in range(len(names)):
        # Each group is the bounded sample.
        models = table.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        out = scratch(models.groupBy("held").applyInPandas(fit_category(index), "doc_id long, held int, values array<double>"), "toxicity-fit")
        weights.append(np.array(out.where(F.col("held") == folds).first()["values"]))
        unseen = out.where(F.col("held") < folds).select("doc_id", F.col("values").alias("fresh"))
        table = scratch(table.join(unseen, "doc_id").withColumn("p", F.concat("p", "fresh")).drop("fresh"), "toxicity-rows")
    scratch.clear()
    return Chain(words, names, weights)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, probabilities array<double> in the chain's order) of every whole text. Null and empty texts have no words.
    Every row gives one row, repeated ones too; an empty table gives none. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                p = chain.probabilities(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "probabilities"])

    return texts(docs).mapInArrow(run, "doc_id long, probabilities array<double>")


#: The toxicity categories that the labels tell apart: abuse in sound prose, abuse in junk, abuse of any kind.
CATEGORIES = {
    "toxic_prose": "toxic = 1 and quality = 1",
    "toxic_junk": "toxic = 1 and quality = 0",
    "toxic": "toxic = 1",
}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_toxic_prose, p_toxic_junk, p_toxic, toxic): ``toxic`` is the verdict of the chain's last model."""
    chain = train(docs, labels, CATEGORIES)
    scored = score(docs, chain)
    named = [F.get("probabilities", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return scored.select("doc_id", *named, (F.element_at("probabilities", -1) >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is toxic; all columns stay, null texts too."""
    chain = train(docs, labels, CATEGORIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            place = batch.schema.get_field_index("_text")
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                kept = chain.probabilities([x or "" for x in part.column(place).to_pylist()])[:, -1] < threshold
                yield part.filter(pa.array(kept))

    named = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    return named.mapInArrow(run, named.schema).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
