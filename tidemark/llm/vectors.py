"""Approximate nearest neighbours by inner product: inverted lists scanned dimension by dimension.

Vectors get one more component, which makes them equally long, and queries a zero, so that the largest inner product is
the smallest distance; both are rotated at random. A query probes the lists of its nearest centroids. Within a list it reads columns block by block; after each block a
hypothesis test on the partial distance abandons the candidates that are, but for a small chance, too far. Scores of the
survivors are exact. A long list is many blocks of rows, and many queries of a list are many blocks too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: The bound on vectors that the centroids are fitted on, and on centroids.
SAMPLE = 20_000
MAX_LISTS = 4096
#: The share of true neighbours that probed lists must hold, measured with so many queries within the sample.
RECALL = 0.96
CALIBRATION = 256
#: Rows and queries that one task compares at a time.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
#: Columns read between two tests, and the width of the test in standard errors.
COLUMNS = 16
WIDTH = 2.1
SEED = 17


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector array<double>): no null, zero or non-finite ones, all of the length that most have (of equally
    many, the longer)."""
    vectors = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    size = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return vectors.where(F.size("vector") == (size["size"] if size else 0))


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


@dataclass
class Index:
    """Centroids of the lengthened vectors (MAX_LISTS at most), the rotation, the greatest length, how many lists a query
    probes, and how many vectors of the sample each list holds."""

    centroids: np.ndarray
    rotation: np.ndarray
    longest: float
    probes: int = 1
    held: np.ndarray | None = None

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    @staticmethod
    def as_queries(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))])

    def lists(self, x: np.ndarray) -> np.ndarray:
        """All lists for each row, nearest centroid first."""
        return np.argsort((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, axis=1, kind="stable")

    def home(self, x: np.ndarray) -> np.ndarray:
        return ((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T).argmin(axis=1)

    def probed(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query probes: as many as were found to do, and more until k others are there for sure."""
        order = self.lists(x)
        enough = (np.cumsum(self.held[order], axis=1) <= k).sum(axis=1) + 1
        return [row[: max(self.probes, n)] for row, n in zip(order, enough, strict=True)]


def probes_needed(index: Index, points: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that hold ``recall`` of the true neighbours of a few points among these. All vectors lie closer
    together than a sample of them, and closer neighbours share lists more often, so this errs on the safe side."""
    count = len(index.centroids)
    if len(points) <= 2 * k:
        return count
    asked = np.arange(min(CALIBRATION, len(points)))
    queries = index.as_queries(points[asked, :-1])
    far = -queries @ points.T
    far[asked, asked] = np.inf
    true = np.argpartition(far, k, axis=1)[:, :k]
    place = np.argsort(index.lists(queries), axis=1)
    needed = np.sort(np.take_along_axis(place, index.home(points)[true], axis=1).ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def build_index(
    vectors: DataFrame, k: int, recall: float, sample: int = SAMPLE, max_lists: int = MAX_LISTS, seed: int = SEED
) -> Index | None:
    """Fit centroids and the number of probes on the ``sample`` vectors with the smallest hash of their id. The number of
    lists follows the square root of the number of all vectors. None for an empty table."""
    facts = vectors.agg(F.count("*").alias("n"), F.max(_square(F.col("vector"))).alias("longest")).first()
    if not facts["n"]:
        return None
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    rest = F.sqrt(F.greatest(F.lit(facts["longest"]) - _square(F.col("vector")), F.lit(0.0)))
    points = stage(chosen.select(F.concat("vector", F.array(rest)).alias("point")), "vectors-sample")
    # ``sample`` rows at most.
    known = np.array(points.toPandas()["point"].tolist(), dtype=float)
    count, size = int(min(max_lists, max(1, round(facts["n"] ** 0.5 / 4)))), known.shape[1]
    centroids = np.zeros((1, size))
    if count > 1:
        features = points.select(array_to_vector("point").alias("features"))
        centroids = np.array(KMeans(k=count, maxIter=8, seed=seed, initSteps=1).fit(features).clusterCenters())
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]
    index = Index(centroids, rotation, facts["longest"])
    index.probes = probes_needed(index, known, k, recall)
    index.held = np.bincount(index.home(known), minlength=count)
    return index


def scan_list(query: np.ndarray, rows: np.ndarray, k: int, columns: int = COLUMNS, width: float = WIDTH) -> np.ndarray:
    """Places of the rows that may be among the k nearest: rotated query and rows, columns in blocks.

    After d of D columns, partial * D / d estimates a squared distance with a relative error of about 1 / sqrt(d). A row
    is abandoned when it exceeds the k-th nearest full distance known, widened by ``width`` such errors.
    """
    alive, size = np.arange(len(rows)), rows.shape[1]
    if len(rows) <= 2 * k:
        return alive
    partial, bound = np.zeros(len(rows)), np.inf
    for at in range(0, size, columns):
        difference = rows[alive, at : at + columns] - query[at : at + columns]
        partial[alive] += np.einsum("ij,ij->i", difference, difference)
        seen = min(at + columns, size)
        if len(alive) > k:
            # The most promising so far keep the bound tight: it is the k-th of distances that exist.
            near = alive[np.argpartition(partial[alive], k)[: k + 1]]
            bound = min(bound, np.partition(((rows[near] - query) ** 2).sum(axis=1), k - 1)[k - 1])
        limit = bound * (1 + width / seen**0.5) ** 2 * seen / size if seen < size else bound * (1 + 1e-9)
        alive = alive[partial[alive] <= limit]
    return alive


def nearest(
    rows: DataFrame,
    queries: str,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of every query, by inner product in double precision.

    ``queries`` is an SQL condition on vec_id; candidates are all rows but the query's own. Ties go to the smaller vec_id.
    Vectors null, zero, holding null or non-finite components, or of another length than most, take no part. Of rows
    that repeat an id the largest vector counts. A query with fewer than k candidates gets them all. An empty table gives no rows; other columns are ignored.
    """
    vectors = usable_vectors(rows, id_column, vector_column).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    vectors = stage(vectors, "vectors")
    index = build_index(vectors, k, recall)
    if index is None:
        return vectors.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )

    def place(batches):
        for batch in batches:
            x = np.array(batch["vector"].tolist(), dtype=float)
            long = index.lengthen(x)
            rotated = [v.tobytes() for v in long @ index.rotation]
            asked = batch["asked"].to_numpy()
            queries = index.as_queries(x[asked])
            turned = iter(queries @ index.rotation)
            probed = iter(index.probed(queries, k))
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"],
                    "asked": asked,
                    "list": index.home(long),
                    "probed": [next(probed).tolist() if a else [] for a in asked],
                    "vector": [v.tobytes() for v in x],
                    "rotated": rotated,
                    "turned": [next(turned).tobytes() if a else b"" for a in asked],
                }
            )

    asked = vectors.withColumn("asked", F.coalesce(F.expr(queries), F.lit(False)))
    placed = stage(
        asked.mapInPandas(place, "vec_id long, asked boolean, list int, probed array<int>, vector binary, rotated binary, turned binary"), "vectors-placed"
    )
    home = placed.select("vec_id", "list", "vector", "rotated")
    probing = placed.where("asked").select("vec_id", F.explode("probed").alias("list"), "vector", F.col("turned").alias("rotated"))
    # A row for each list: how many blocks its rows and its queries make. Bounded by MAX_LISTS.
    tally = home.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("row_blocks"))
    asking = probing.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("query_blocks"))
    sizes = F.broadcast(stage(tally.join(asking, "list"), "vectors-lists"))
    dealt = lambda own, other: (
        F.pmod(F.xxhash64("vec_id"), F.col(own)).alias(own),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
    )
    rows_dealt = home.join(sizes, "list").select("list", "vec_id", "vector", "rotated", *dealt("row_blocks", "query_blocks"))
    asked_dealt = probing.join(sizes, "list").select("list", "vec_id", "vector", "rotated", *dealt("query_blocks", "row_blocks"))
    asked_dealt = asked_dealt.select(*(F.col(c).alias(f"asked_{c}") for c in asked_dealt.columns))

    def compare(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        unpack = lambda column: np.frombuffer(b"".join(column), dtype=float).reshape(len(column), -1)
        ids, full, turned = held["vec_id"].to_numpy(), unpack(held["vector"]), unpack(held["rotated"])
        out = []
        for query, vector, rotated in zip(
            asking["asked_vec_id"], unpack(asking["asked_vector"]), unpack(asking["asked_rotated"]), strict=True
        ):
            # One more than k: the query itself may be in this list.
            alive = scan_list(rotated, turned, k + 1)
            alive = alive[ids[alive] != query]
            scores = (full[alive] * vector).sum(axis=1)
            best = np.lexsort((ids[alive], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[alive][best], "score": scores[best]}))
        return pd.concat(out)

    block = ("list", "row_blocks", "query_blocks")
    pairs = asked_dealt.groupBy(*(f"asked_{c}" for c in block)).cogroup(rows_dealt.groupBy(*block))
    found = pairs.applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
